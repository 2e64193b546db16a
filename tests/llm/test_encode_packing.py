"""Encoding against the tokenizer over whole texts; packing against best fit over items one by one."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ledgerline.llm import encode, packing  # noqa: E402

TEXTS = [
    None, "", " ", "  \n\n ", "a", "don't we'll !'s ''re x'Re l'l", "<|endoftext|> is text", "a\r\nb\r\n\tc", "à la carte à  à　x",
    "推定値にはその印を付けています。しきい値は当面そのままにします。" * 9, "👩‍💻 → 🤖é" * 30, "x" * 3000, "   a  ", "abc\x00\x01﻿\x85 \x1c \x1d",
    "0x8f21fca881eea26b" * 40, "'" * 200, "Ünïcödé'sà 'tà" * 30, "́́a", "１２３ 一二三 counts 四五", "word " * 5000, "\x1b[33mWARN\x1b[0m", "a'" + "b" * 100 + "'ll",
]


@pytest.fixture(scope="module")
def enc():
    return encode.Encoder(encode.vocabulary())


def test_fragments_encode_as_the_whole(enc):
    rnd = random.Random(3)
    alphabet = "ab zq'\"sltrevdm \n\t.,019é漢字　\xa0à👍-_{}" + "\x85 "
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300))) for _ in range(4000)]
    for t in texts:
        assert enc.encode(t) == enc._whole(t), repr(t)
        assert "".join(enc.fragments_of_bytes(t)) == t and "".join(enc.fragments(t)) == t
        assert [i for f in enc.fragments_of_bytes(t) for i in enc._whole(f)] == enc._whole(t), repr(t)


def test_ids_equal_the_other_public_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert enc.encode(x) == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_null_and_empty_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "one two", 7), (3, "one two", 7)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.encoded(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert encode.encoded(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in encode.counted(df).collect()) == [0, 0, 2, 2]


def best_fit(lengths, capacity):
    """Best fit, longest first, one item at a time: the space left in each container."""
    left = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= x
        else:
            left.append(capacity - x)
    return sorted(left)


def test_the_plan_is_best_fit_over_items():
    rnd = random.Random(5)
    for _ in range(300):
        capacity = rnd.choice([5, 17, 64])
        lengths = [rnd.randint(1, capacity) if rnd.random() < 0.7 else 3 for _ in range(rnd.randint(0, 120))]
        hist = {x: lengths.count(x) for x in set(lengths)}
        segments, containers = packing.plan(hist.items(), capacity)
        used, ranks = [0] * containers, {x: set() for x in hist}
        for length, rank0, n, first, each, at in segments:
            for j in range(n):
                used[first + j // each] += length
                assert rank0 + j not in ranks[length] and at + (j % each) * length + length <= capacity
                ranks[length].add(rank0 + j)
        assert all(ranks[x] == set(range(n)) for x, n in hist.items())
        assert sorted(capacity - u for u in used) == best_fit(lengths, capacity)


def test_items_take_disjoint_slots(spark):
    rows = [(i, n) for i, n in enumerate([0, 0, None, 1, 4, 4, 4, 4, 9, 10, 11, 25, 30, 7, 3, 3])] + [(7, 4), (7, 4)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", "size", 10).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.container, []).append((r.position, r.position + r.n_tokens))
    for spans in whole.values():
        spans = sorted(s for s in spans if s[0] < s[1])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(e <= 10 for _, e in spans)
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == 11) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert len(got) == 18 + 1 + 2 + 2
    empty = packing.packed(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, size long"), "doc_id", "size", 10).collect()
    assert {r.container for r in empty} <= {0, 1} and len(empty) == 2
    assert packing.packed(spark.createDataFrame([], "doc_id long, size long"), "doc_id", "size", 10).count() == 0
