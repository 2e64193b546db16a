"""The general problems against brute force, with every odd case: nulls, ties, repeats, empty tables, clashing columns, hot keys."""

import json
import random
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from ledgerline.functions import names, times
from ledgerline.operators import components, deliveries, late, rolling, schema_drift
from ledgerline.operators.components import connected_components
from ledgerline.operators.sequences import carry_last, prefix_sum


def values(df, *cols):
    return sorted(tuple(str(r[c]) if not isinstance(r[c], (int, bool)) else r[c] for c in cols) for r in df.collect())


def test_stamps_dates_and_names(spark):
    stamps = {"2026-01-05T17:55:49+01:00": 1767632149, "2026-01-05 16:55:49Z": 1767632149, "2026-01-05T16:55:49.000": 1767632149, " 2026-01-05T10:55:49.5-0600 ": 1767632149, "2026-01-05": 1767571200, "2026-13-40T00:00:00Z": None, "0000-00-00T00:00:00": None, "n/a": None, "": None, "2026": None, None: None, "yesterday": None}
    df = spark.createDataFrame([(k,) for k in stamps], "s string").select("s", F.floor(F.unix_micros(times.instant(F.col("s"))) / 1_000_000).alias("t"))
    assert {r.s: r.t for r in df.collect()} == stamps
    d = spark.createDataFrame([("2026/01/09",), (" 2026-01-06",), ("20260110",), ("2026-02-30",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in d.select(times.loose_date(F.col("d"))).collect()] == ["2026-01-09", "2026-01-06", "2026-01-10", "None", "None", "None"]
    n = spark.createDataFrame([("KILN.38",), ("trestle--16",), (" tamarack-17 ",), ("sorrel 26",), ("--",), (None,)], "n string")
    assert [r[0] for r in n.select(names.slug(F.col("n"))).collect()] == ["kiln-38", "trestle-16", "tamarack-17", "sorrel-26", "unknown-machine", "unknown-machine"]


def test_rolling_totals(spark):
    rnd = random.Random(1)
    first = date(2026, 1, 1)
    rows = [(rnd.choice("ab"), first + timedelta(days=rnd.choice([0, 1, 5, 40, 41, 80])), rnd.choice([None, 0, 3, 7])) for _ in range(200)]
    rows += [("solo", first, 5)] + [(None, first, 1), ("a", None, 1)] + [("hot", first, 1)] * 500
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "p string, d date, v long, sum7 long, _e long")
    got = {(r.p, r.d): (r.nth, r.v, r.sum7, r.sum30, r.avg7) for r in rolling.trailing_totals(df, "p", "d", "v").collect()}
    want = {}
    for p in ("a", "b", "solo", "hot"):
        days = {}
        for q, d, v in rows:
            if q == p and d:
                days[d] = days.get(d, 0) + (v or 0)
        d = min(days)
        while d <= max(days):
            s = lambda k: sum(days.get(d - timedelta(days=i), 0) for i in range(k))  # noqa: B023, E731
            want[p, d] = ((d - min(days)).days + 1, days.get(d, 0), s(7), s(30), s(7) / 7)
            d += timedelta(days=1)
    assert got == want
    assert rolling.trailing_totals(df.limit(0), "p", "d", "v").count() == 0


def brute_settle(rows, hours=72):
    out = {}
    for m, d in {(r[0], r[1]) for r in rows if r[1] and r[2]}:
        mine = sorted((r for r in rows if r[:2] == (m, d) and r[2]), key=lambda r: (r[2], r[4]))
        bound = datetime(d.year, d.month, d.day, tzinfo=timezone.utc) + timedelta(days=1, hours=hours)
        ok, no = [r for r in mine if r[2] <= bound], [r for r in mine if r[2] > bound]
        out[m, d] = (bool(ok) and ok[0][3] != ok[-1][3], not ok or any(r[3] != ok[-1][3] for r in no))
    return out


def test_late_records_against_replay(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(900):
        d = date(2026, 1, 1) + timedelta(days=rnd.randint(0, 6))
        at = datetime(d.year, d.month, d.day, tzinfo=timezone.utc) + timedelta(hours=rnd.choice([1, 24, 95, 96, 97, 300]), seconds=rnd.choice([0, 0, 1]))
        rows.append((rnd.choice(["a", "b", "hot", "hot", None]), d if k % 50 else None, at if k % 41 else None, rnd.choice([None, 1, 1, 1, 2]), k))
    df = spark.createDataFrame(rows, "m string, d date, t timestamp, v long, id long")
    for idle in (7 * late.DAY, late.HOUR, 0):  # the timeout closes days for all; it never turns a record in time away
        s = late.replay(df, "m", "d", "t", "v", "id", idle=idle).settled()
        assert {(r.source, r.day): (r.corrected, r.missed) for r in s.collect()} == brute_settle(rows)
    none = late.replay(df.limit(0), "m", "d", "t", "v", "id")
    assert none.settled().count() == none.closings().count() == 0


def test_a_day_closes_when_every_source_passed_or_idles(spark):
    at = lambda d, h=0: datetime(2026, 1, d, h, tzinfo=timezone.utc)
    rows = [("a", at(1)), ("a", at(3)), ("a", at(4)), ("a", at(30)), ("b", at(1, 5)), ("b", at(4, 7))]
    df = spark.createDataFrame([(*r, date(2026, 1, 1 + 2 * (i % 2)), i) for i, r in enumerate(rows)], "s string, t timestamp, d date, i long")
    replayed = late.replay(df, "s", "d", "t", "i", "i", 24 * late.HOUR, 5 * late.DAY)
    got = {str(r.day): (r.closed_at.replace(tzinfo=timezone.utc) if r.closed_at.tzinfo is None else r.closed_at, r.n_passed, r.n_idle) for r in replayed.closings().collect()}
    # day 1 is over at the 2nd, its bound is the 3rd: a passes on the 4th (not at the bound itself), b on the 4th at 7
    assert got["2026-01-01"] == (at(4, 7), 2, 0)
    # the bound of day 2 is the 4th: b passes at 7, a is silent from the 4th on and idles on the 9th
    assert got["2026-01-02"] == (at(9), 1, 1)
    assert got["2026-01-03"][1:] == (0, 2) and got["2026-01-03"][0] == at(9, 7)


def brute_messages(rows):
    group = {}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = lambda r: [(k, v) for k, v in (("r", (r[1] or "").strip()), ("u", (r[2] or "").strip().lower())) if v]
    for r in rows:
        for i in ids(r):
            group.setdefault(i, i)
        both = ids(r)
        if len(both) == 2:
            group[root(both[0])] = root(both[1])
    least = {}
    for r in sorted(rows):
        for i in ids(r)[:1]:
            least.setdefault(root(i), r[0])
    return {r[0] for r in rows if ids(r) and least[root(ids(r)[0])] != r[0]}


def test_messages_against_union_find(spark, tmp_path):
    rnd = random.Random(4)
    for hot in (0, 1):
        rows = []
        for k in range(1200):
            r = rnd.choice([None, "", " ", f"req{rnd.randint(0, 300)}", f" req{rnd.randint(0, 300)}\t"])
            u = rnd.choice([None, "", f"U{rnd.randint(0, 400)}", f"u{rnd.randint(0, 400)} "])
            rows.append((k, "hot" if hot and k % 3 == 0 else r, f"chain{k // 3}" if hot and k % 3 == 0 and k % 2 else u))
        # a chain through many ids, and repeated rows
        rows += [(2000 + k, f"c{k // 2}", f"d{(k + 1) // 2}") for k in range(90)] + [(3000 + k, "same", "same") for k in range(20)]
        df = spark.createDataFrame([(*r, "x" * 50, "a") for r in rows], "id long, q string, u string, _words string, file string")
        want = brute_messages(rows)
        path = str(tmp_path / f"t{hot}")
        df.repartition(5).write.parquet(path)
        vectors = deliveries.deletion_vectors(spark, path, F.col("q"), F.col("u"), "id")
        for budget in (deliveries.VECTOR_BYTES, 5_000, 1):
            assert {x.id for x in deliveries.read_dropped(spark, path, vectors, budget).collect()} == want
            kept = deliveries.read_kept(spark, path, vectors, budget)
            assert kept.columns == df.columns and sorted(x.id for x in kept.collect()) == sorted(r[0] for r in rows if r[0] not in want)
    # no rows; rows that tie in the order; rows that do not count
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert deliveries.deletion_vectors(spark, str(tmp_path / "none"), F.col("q"), F.col("u"), "id").count() == 0
    spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "a", "b"), (None, "b", None), (1, "b", None), (0, "a", "no")], "id long, q string, u string").write.parquet(str(tmp_path / "ties"))
    v = deliveries.deletion_vectors(spark, str(tmp_path / "ties"), F.col("q"), F.lit(None).cast("string"), "id", F.expr("u is null or u <> 'no'"))
    assert sorted((str(r.id), r.q, str(r.u)) for r in deliveries.read_dropped(spark, str(tmp_path / "ties"), v).collect()) in ([("1", "a", "None"), ("1", "a", "None"), ("1", "b", "None")], [("1", "a", "None"), ("1", "a", "b"), ("1", "b", "None")])


def test_deletion_vectors_over_many_buckets(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(0, 150_000, 1, 1).withColumn("k", F.when((F.col("id") % 7 == 0) | F.col("id").between(32_700, 32_900), "same").otherwise(F.col("id").cast("string"))).write.parquet(path)
    v = deliveries.deletion_vectors(spark, path, F.col("k"), F.lit(None).cast("string"), "id")
    kept = deliveries.read_kept(spark, path, v)
    gone = (F.col("k") == "same") & (F.col("id") > 0)
    assert kept.count() == spark.read.parquet(path).filter(~gone).count() and kept.filter(gone).count() == 0 and v.count() == 5


def test_files_are_packed_by_the_size_of_their_vectors():
    sizes = [(f"f{k:02}", k * 7 % 11) for k in range(30)]
    groups = deliveries._groups(sizes, 12)
    assert sorted(f for g in groups for f in g) == sorted(f for f, _ in sizes) and all(sum(dict(sizes)[f] for f in g) <= 12 for g in groups)
    assert deliveries._groups([("a", 50), ("b", 1)], 10) == [["a"], ["b"]] and deliveries._groups([], 10) == []


def test_components_of_chains_and_stars(spark, monkeypatch):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)] + [("s", f"s{k}") for k in range(50)] + [("x", "x"), (None, "y"), ("a1", "a2"), ("a2", "a1")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{k:03}": "n000" for k in range(41)}, "s": "s", **{f"s{k}": "s" for k in range(50)}, "a1": "a1", "a2": "a1"}
    monkeypatch.setattr(components, "HUB", 7)  # the star's middle is a hub then
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()} == got


def test_look_backs_in_chunks_equal_whole_windows(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["k", "k", "j", None]), i // 17, i, rnd.choice([None, None, rnd.randint(1, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, c long, o long, v long")
    got = {r.o: (r.p, r.s) for r in prefix_sum(carry_last(df, ["k"], "c", ["o"], "v", "p"), ["k"], "c", ["o"], "v", "s").collect()}
    for key in ("k", "j", None):
        last, total = None, 0
        for k, _, o, v in rows:
            if k == key:
                assert got[o] == (last, total)
                last, total = (v if v is not None else last), total + (v or 0)


T = {"input_tokens": 5, "output_tokens": 7, "cache_creation": 3, "cache_read": 90, "reasoning": 1}
BASE = {"schema": 3, "counter": "0fab183762be", "machine": "kiln-1", "date": "2026-01-05", "partial": False, "generated_by": "cron", "invocations": 95, "totals": T, "sources": {"A": T, "B": T}, "sketch": ["0" * 16]}


def changed(spark, bodies, machine="kiln-1"):
    t0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    rows = [(i, machine, t0 + timedelta(hours=7 * i), b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, m string, t timestamp, body string")
    return df, values(schema_drift.changes(schema_drift.reduced(df, "id", "m", "t", "body")), "id", "field", "change", "new_field")


def without(o, *keys, **more):
    return {k: v for k, v in o.items() if k not in keys} | more


def test_every_change_is_told_once_at_the_later_file(spark):
    bodies = [
        BASE, None, "", "[1]", "{broken", '{"a": NaN}', BASE,
        without(BASE, "counter", code_digest="1fab183762be"),  # 7: renamed
        without(BASE, "counter", code_digest=None, window={"from": "0"}),  # 8: null keeps its type; added, nothing below
        without(BASE, "counter", code_digest="2fab183762be", partial=0),  # 9: removed, retyped
        without(BASE, "counter", "sources", code_digest={"id": "x"}, lanes={"C": T}),  # 10
        without(BASE, "counter", "sources", "sketch", code_digest={"id": "x"}, lanes={"C": without(T, "reasoning", thinking=2), "D": without(T, "reasoning", thinking=4)}, invocations="95"),  # 11
        without(BASE, "counter", "sources", "sketch", "totals", code_digest={"id": "x"}, lanes={}, invocations=95.0, totals=without(T, "cache_read")),  # 12
    ]
    _, got = changed(spark, bodies)
    assert got == sorted([
        (7, "counter", "renamed", "code_digest"), (8, "window", "added", ""), (9, "window", "removed", ""), (9, "partial", "retyped", ""),
        (10, "code_digest", "retyped", ""), (10, "partial", "retyped", ""), (10, "sources", "renamed", "lanes"), (11, "sketch", "removed", ""),
        (11, "lanes.*.reasoning", "renamed", "lanes.*.thinking"), (11, "invocations", "retyped", ""), (12, "invocations", "retyped", ""), (12, "totals.cache_read", "removed", ""),
    ])


def test_no_change_and_no_files(spark):
    df, got = changed(spark, [BASE, BASE, dict(reversed(BASE.items())), json.dumps(BASE, indent=3)])
    assert got == []
    assert schema_drift.changes(schema_drift.reduced(df.limit(0), "id", "m", "t", "body")).count() == 0
    assert schema_drift.inferred(schema_drift.reduced(df.limit(0), "id", "m", "t", "body")).count() == 0


def test_the_union_keeps_every_type_and_names_its_first_file(spark):
    df, _ = changed(spark, [BASE, without(BASE, partial=None), without(BASE, partial=1), without(BASE, partial="true")])
    got = {(r.field, r.type): (r.files, r.first_id, r.alternatives) for r in schema_drift.inferred(schema_drift.reduced(df, "id", "m", "t", "body")).collect()}
    assert got["partial", "boolean"] == (1, 0, "boolean|integer|string") and got["partial", "null"][1] == 1 and got["partial", "string"] == (1, 3, "boolean|integer|string")
    assert got["sources.*.reasoning", "integer"] == (4, 0, "integer")


def test_one_table_with_branches(spark):
    fields = [("schema", "integer"), ("counter", "string"), ("partial", "boolean"), ("generated_at", "string"), ("invocations", "integer"), ("sketch", "array"), ("totals", "object"), ("sources", "object"), *((f"totals.{k}", "integer") for k in T), *((f"sources.*.{k}", "integer") for k in T)]
    odd = {"schema": "3", "code_digest": {"id": "x"}, "partial": "false", "generated_at": 1770999965, "invocations": 256.0, "sketch": "a,b", "totals": without(T, "reasoning", thinking=9), "lanes": [without(T, name="A", thinking="4")], "cost": 1.5}
    df, _ = changed(spark, [BASE, odd, "x", {"invocations": "many", "sources": [["A", 1]], "totals": 3}])
    names_ = {"code_digest": "counter", "lanes": "sources", "totals.thinking": "totals.reasoning"}
    got = {r._id: r for r in schema_drift.consistent(df, "id", "m", "t", "body", fields, names_).collect()}
    a, b, c = got[0], got[1], got[3]
    assert sorted(got) == [0, 1, 3] and a.totals.asDict() == T and a.sources["B"].asDict() == T and "machine:string" in a.branches
    assert (b.schema, b.counter, b.partial, b.generated_at, b.invocations, b.sketch) == (3, "x", False, "2026-02-13T16:26:05+00:00", 256, ["a", "b"])
    assert b.totals.reasoning == 9 and b.sources["A"].input_tokens == 5 and b.branches["cost:number"] == "1.5" and b.branches["invocations:number"] == "256.0"
    assert (c.invocations, c.sources, c.totals) == (None, None, None) and c.branches["invocations:string"] == '"many"' and c.branches["sources:array"] == '[["A", 1]]'


def test_what_the_one_table_does_not_take_is_in_branches(spark):
    fields = [("counter", "string"), ("totals", "object"), ("sources", "object"), *((f"totals.{k}", "integer") for k in T), *((f"sources.*.{k}", "integer") for k in T)]
    body = {"code_digest": "old", "counter": "new", "totals": dict(T, thinking=9, audio_tokens=7), "sources": {"A": dict(T, calls={"n": 2}, none=None), "B": 5, "C": None}}
    df, _ = changed(spark, [body])
    names_ = {"code_digest": "counter", "totals.thinking": "totals.reasoning"}
    [r] = schema_drift.consistent(df, "id", "m", "t", "body", fields, names_).collect()
    assert r.counter == "new" and r.totals.asDict() == T and {k: v.asDict() for k, v in r.sources.items()} == {"A": T}
    # the loser of a clash, fields below objects and maps, entries that are no objects
    want = {"code_digest:string": '"old"', "totals.thinking:integer": "9", "totals.audio_tokens:integer": "7", "sources.A.calls:object": '{"n": 2}', "sources.A.none:null": "null", "sources.B:integer": "5", "sources.C:null": "null"}
    assert want.items() <= r.branches.items(), r.branches


def test_no_body_stops_the_others(spark):
    odd = ['{"a":1e999,"t":"x"}', '{"a":-1e999,"t":["\\ud800", 1e999]}', '{"a":%s,"t":"\\udfff"}' % (10**19), '{"a":%s,"t":{"id":"\\ud800"}}' % ("9" * 5000), '{"\\ud800":1,"a":9223372036854775807,"t":null}', '{"a":"9223372036854775807","t":"1"}', '{"a":-9223372036854775809}', "[" * 100_000, '{"a":' + "[" * 100_000, '{"a":true}']
    df, got = changed(spark, odd)
    assert [(i, f, c) for i, f, c, _ in got if f == "a"] == [(2, "a", "retyped"), (5, "a", "retyped"), (6, "a", "retyped"), (9, "a", "retyped")]
    assert (1, "t", "retyped", "") in got and (4, "?", "added", "") in got
    r = {x._id: x for x in schema_drift.consistent(df, "id", "m", "t", "body", [("a", "integer"), ("t", "string")], {}).collect()}
    assert {i: x.a for i, x in r.items()} == {0: None, 1: None, 2: None, 3: None, 4: 2**63 - 1, 5: 2**63 - 1, 6: None, 9: 1}
    assert r[0].branches == {"a:number": "1e999"} and json.loads(r[1].branches["t:array"])[1] == float("inf") and r[2].branches == {"a:integer": str(10**19)} and r[2].t == "?"
    assert r[3].t == "?" and r[3].branches["a:integer"] == "9" * 5000
    many = {x._id: x for x in schema_drift.consistent(df, "id", "m", "t", "body", [("a", "number"), ("t", "array")], {}).collect()}
    assert many[1].t == ["?", "1e999"] and many[3].a is None and many[3].branches["a:integer"] == "9" * 5000
    assert schema_drift.inferred(schema_drift.reduced(df, "id", "m", "t", "body")).filter("field = 'a'").first().alternatives == "boolean|integer|number|string"


def test_nulls_keep_the_type_across_files_and_absence(spark):
    bodies = [{"a": 1, "b": None}, {"a": None, "b": 2}, {"b": None}, {"a": None, "b": None}, {"a": None, "b": "x"}, {"a": 2.5, "b": None}, {"a": None, "b": "y"}, {"a": 3.5, "b": None}, {"a": 4, "b": 1}]
    df, got = changed(spark, bodies)
    assert got == [(2, "a", "removed", ""), (3, "a", "added", ""), (4, "b", "retyped", ""), (5, "a", "retyped", ""), (8, "a", "retyped", ""), (8, "b", "retyped", "")]
    # ids without a machine or a time: of a source of their own, and first
    late_ = df.withColumn("m", F.lit(None).cast("string")).withColumn("t", F.when(F.col("id") > 4, F.col("t")))
    assert values(schema_drift.changes(schema_drift.reduced(late_, "id", "m", "t", "body")), "id", "field", "change", "new_field") == got


def test_more_names_than_a_worker_holds_give_the_same_table(spark, monkeypatch):
    from ledgerline.plans import problems

    tables = []
    for most in (problems.MOST_NAMES, 0):
        monkeypatch.setattr(problems, "MOST_NAMES", most)
        rows = problems.p4_table(spark, "/root/testdata/sf0.001").collect()
        tables.append({r.file_id: json.dumps(r.asDict(True), sort_keys=True) for r in rows})
    assert tables[0] == tables[1] and len(tables[0]) > 20
