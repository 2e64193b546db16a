"""Overlap counts against brute force; truncated texts on a small corpus of known cases."""

import itertools
import random

import pytest

from ledgerline.llm import overlap, truncation


def brute(rows):
    sets = {}
    for g, s, i in set(rows):
        if None not in (g, s, i):
            sets.setdefault((g, s), set()).add(i)
    out = {}
    for (g, a), x in sets.items():
        for (h, b), y in sets.items():
            if g == h and a <= b and x & y:
                out[g, a, b] = len(x & y)
    return out


@pytest.mark.parametrize("light", [0, 1, 3, 99])
def test_counts_are_exact_for_any_split(spark, light):
    rnd = random.Random(light)
    rows = [(rnd.choice("de"), f"m{rnd.randint(0, 11)}", f"{rnd.randint(0, 60):016x}") for _ in range(1500)]
    rows += [("d", f"m{k}", "hot") for k in range(12)] * 30 + [("d", None, "x"), (None, "m1", "x"), ("d", "m1", None)]
    got = overlap.overlap_counts(spark.createDataFrame(rows, "g string, s string, i string"), "g", "s", "i", light)
    assert {(r.g, r.a, r.b): r.n for r in got.collect()} == brute(rows)
    full = {(r.g, r.a, r.b): (r.shared, r.size_a, r.size_b, r.union) for r in overlap.overlaps(got).collect()}
    want = brute(rows)
    assert full == {(g, a, b): (n, want[g, a, a], want[g, b, b], want[g, a, a] + want[g, b, b] - n) for (g, a, b), n in want.items() if a < b}


def test_counts_of_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([("d", "m", "i", 1, 2)], "g string, s string, i string, n long, a long")
    assert overlap.overlap_counts(df.limit(0), "g", "s", "i").count() == 0
    assert [tuple(r) for r in overlap.overlap_counts(df, "g", "s", "i").collect()] == [("d", "m", "m", 1)]


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 3)
    rows = [(g, [f"s{k}" for k in ks]) for g in ("a", "b") for ks in itertools.combinations(range(8), 4)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"g": [r[0] for r in rows], "s": [r[1] for r in rows]})
    got = {}
    for b in overlap._products(iter([batch])):
        for r in b.to_pylist():
            got[r["g"], r["a"], r["b"]] = got.get((r["g"], r["a"], r["b"]), 0) + r["n"]
    assert got == brute([(g, s, str(k)) for k, (g, ss) in enumerate(rows) for s in ss])


def test_sketches_estimate_what_is_shared(spark):
    x = [f"{k:016x}" for k in range(64)]
    rows = [("d", "a", x), ("d", "b", x[32:]), ("d", "c", ["f" * 16]), ("d", "n", None), ("d", "e", []), ("d", "a", x[:3]), ("z", "a", x)]
    got = overlap.sketch_overlaps(spark.createDataFrame(rows, "g string, s string, k array<string>"), "g", "s", "k").collect()
    assert [(r.g, r.a, r.b, r.in_both, r.of, r.jaccard) for r in got] == [("d", "a", "b", 32, 64, 0.5)]
    few = overlap.sketch_overlaps(spark.createDataFrame([("d", "a", x[:9]), ("d", "b", x[4:20])], "g string, s string, k array<string>"), "g", "s", "k").collect()
    assert [(r.in_both, r.of, r.shared) for r in few] == [(5, 20, 5)]  # nothing was left out: exact


def test_the_number_shared_is_estimated_from_sketches(spark):
    rnd = random.Random(3)
    h = [f"{rnd.getrandbits(64):016x}" for _ in range(40_000)]
    sets = {"a": h[:30_000], "b": h[15_000:], "c": h[29_000:]}
    df = spark.createDataFrame([("d", s, sorted(v)[:64]) for s, v in sets.items()], "g string, s string, k array<string>")
    got = {(r.a, r.b): r.shared for r in overlap.sketch_overlaps(df, "g", "s", "k").collect()}
    assert abs(got["a", "b"] - 15_000) < 6_000 and abs(got["b", "c"] - 11_000) < 6_000


def test_fifty_thousand_sets_fit_into_a_worker():
    import subprocess
    import sys

    code = """
import random, resource, pyarrow as pa
from ledgerline.llm import overlap
rnd = random.Random(5)
rows = [rnd.sample(range(50_000), 400) for _ in range(40)]
batch = pa.RecordBatch.from_pydict({"g": ["d"] * 80, "s": [[f"set-{k:05}" for k in r] for r in rows] * 2})
pairs = total = 0
for b in overlap._products(iter([batch])):
    pairs, total = pairs + b.num_rows, total + sum(b.column("n").to_pylist())
assert total == 80 * 400 * 401 // 2, total
print(pairs, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(overlap.__file__).parents[2])
    assert not out.returncode, out.stderr
    pairs, mb = map(int, out.stdout.split())
    assert pairs <= 40 * 400 * 401 // 2 and mb < 1000


SUBJECTS = ["the ledger", "the watcher", "a second box", "the nightly export", "the retry loop", "the price table"]
VERBS = ["counted", "dropped", "merged", "reported", "skipped", "flagged"]
OBJECTS = ["the whole lane", "a partial day", "several records", "an unstamped record", "the reasoning tokens"]
TAILS = ["while the export was still running", "after the directory was synced", "although nothing had changed", "before the cut-off at 12:45", "in both the ledger and the record"]


def corpus(n=1500):
    rnd = random.Random(11)
    sentence = lambda: f"{rnd.choice(SUBJECTS).capitalize()} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)} {rnd.choice(TAILS)}."
    docs, cases = [], set()
    for i in range(n):
        text = " ".join(sentence() for _ in range(rnd.randint(2, 6)))
        source = ["notes", "alerts", "stopless"][i % 3]
        if source == "alerts" and len(text) > 200:
            docs.append((i, text[:200], source))
            if not text[:200].rstrip().endswith("."):
                cases.add(i)
        elif source == "stopless":
            docs.append((i, text[:-1], source))
        elif i % 30 == 0:
            end = rnd.randint(20, len(text) - 3)
            docs.append((i, text[:end] + rnd.choice(["", "...", "…"]), source))
            if not text[:end].rstrip().endswith("."):
                cases.add(i)
        else:
            docs.append((i, text + rnd.choice(["", "", "\nand so on...", "\nlgtm", "\n~12%"]), source))
    return docs, cases


def test_cut_texts_are_found_and_whole_ones_are_not(spark):
    docs, cases = corpus()
    odd = [(10_000, None, "notes"), (10_001, "", "notes"), (10_002, " \n\t ", None), (10_003, "x" * 200_000, "notes"), (10_004, "```\na = 1", "notes"), (10_005, "​", "notes"), (10_006, docs[0][1], None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, source string")
    found = {r.doc_id for r in truncation.truncated(df).filter("cut").collect()}
    ours = {i for i in found if i < 10_000}
    assert len(ours & cases) >= 0.97 * len(cases) and len(ours & cases) >= 0.97 * len(ours), (sorted(cases - ours), sorted(ours - cases))
    assert 10_004 in found and not found & {10_000, 10_001, 10_002, 10_005}
    assert (10_006 in found) == (0 in found)


def test_many_distinct_texts_cut_at_one_place_are_cut(spark):
    docs, _ = corpus(600)
    docs += [(1000 + k, f"The exporter of box {k} stood still.", "notes") for k in range(12)]
    hosts = ["ash", "birch", "cedar", "elm"]
    # one template, cut within a word: by a limit of its message, whatever came before
    inside = {2000 + k: f"Box {hosts[k % 4]}-{k} reported that the nightly expor" for k in range(60)}
    # cut behind a known word, at a limit that others show
    filled = lambda k, end: f"{hosts[k % 4]}{'x' * (6 - len(hosts[k % 4]))} {k:04} " + "m" * (150 - 12 - len(end)) + end
    behind = {3000 + k: filled(k, " and then it seemed that the") for k in range(60)}
    shown = {4000 + k: filled(k, f" {w} the whole lan") for k, w in enumerate(VERBS * 2)}
    # a greeting ends texts of any length and is no cut word, though longer words begin so
    thanks = {5000 + k: f"{docs[3 * k][1]}\n{end}" for k in range(80) if docs[3 * k][1].endswith(".") for end in [["tai", "and so says tai"][k % 2]]}
    docs += [(6000 + k, f"The tail of lane {k} was read.", "notes") for k in range(20)]
    assert len(set(map(len, behind.values())) | set(map(len, shown.values()))) == 1
    for d, source in ((inside, "notices"), (behind, "limited"), (shown, "limited"), (thanks, "notes")):
        docs += [(i, t, source) for i, t in d.items()]
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(docs, "doc_id long, text string, source string")).filter("cut").collect()}
    for d in (inside, behind, shown):
        assert set(d) <= found, (len(set(d) - found), len(d))
    assert not set(thanks) & found


def test_copies_of_a_text_are_no_more_evidence_than_the_text(spark):
    docs, _ = corpus(300)
    copies = [(10_000 + k, docs[i][1], docs[i][2]) for k, i in enumerate([1, 2, 30, 31] * 50)]
    results = []
    for rows in (docs, docs + copies):
        got = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("doc_id < 10000").collect()
        results.append({r.doc_id: tuple(r) for r in got})
    assert results[0] == results[1]


def test_nothing_is_found_in_an_empty_table(spark):
    assert truncation.truncated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_marks_and_parts():
    body = truncation.body
    assert body("so it was merged... (31 more)") == "so it was merged" and body("a b\n[+12 chars] ") == "a b" and body("a b [output cut]") == "a b" and body("a b\n<omitted>") == "a b"
    assert body("a " * 500 + "b\n[" + "very " * 100 + "long text omitted]") == ("a " * 500 + "b") and body("a (see b) c … (+1,204 chars cut (off)") == "a (see b) c" and body("wait....") == "wait" and body("x [1] > y") == "x [1] > y"
    assert body("[truncated] is what it prints") == "[truncated] is what it prints" and body(" \n") == ""
    assert truncation.parts("req_1b2c3d4e at 0xdeadbeef12, faceb00k facade 1234567 deadbeef0g 0abcdef") == ["req_# at #, faceb00k facade 0000000 deadbeef0g #"]
    assert truncation.parts("One. (Two.) 3.14 is\nit. これは。次") == ["One.", "(Two.)", "0.00 is", "it.", "これは。", "次"]


def test_sources_and_rules_add_up_to_what_was_found(spark):
    from ledgerline.llm import queries

    folder = "/root/testdata/sf0.001"
    found = {r.doc_id for r in queries.p8_found(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()
    want = {}
    for d in docs:
        n, k = want.get(d.source, (0, 0))
        want[d.source] = n + 1, k + (d.doc_id in found)
    assert {r.source: (r.documents, r.truncated) for r in queries.p8_sources(spark, folder).collect()} == want
    assert sum(r.documents for r in queries.p8_rules(spark, folder).collect()) == len(found) > 0
