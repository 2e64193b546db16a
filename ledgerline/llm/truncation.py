"""Texts that lost their end to a field limit or a broken transfer.

A trie of the corpus' words, rooted once for the corpus and once for each context of one, two or four
preceding words, says how often a text that stands where this one stops goes on: words that
pass through the node of the last token (the token is a proper prefix of them), tokens that end there but
are followed by more, and tokens that end there and end a line or a sentence. What decides, in this order:

* prefix: the last token is an unknown proper prefix of known words (by more than a stop), and texts are not
  known to end in it where they pass here. Where they are, as a greeting that no text goes on after, their
  lengths decide: a greeting ends texts of any length, a cut those of one.
* length: the texts of a source pile up at this length, those there are cut by their words, and this one ends without
  a stop and not as texts of other lengths do.
* block, sign: a block was opened and not closed; bytes of the last character are missing.
* context: texts practically always go on from here. Contexts are tried from the longest to the shortest
  that says anything, the bare trie last; at the limits of a source's lengths a doubt is enough.

All thresholds are bounds on shares, one standard error from them (Wilson), so what little evidence says counts less, and the
same shares in a larger corpus say the same with more confidence.

Digits count as one digit, hexadecimal ids as one sign, so that numbers, dates, stamps and ids have
words of their shape. Languages written without spaces are taken sign by sign, contexts twice as long. A
mark that something was left out is set aside first; it decides nothing, as complete texts end in one too.
Some sources leave off the last stop of complete texts: where texts that lack nothing but the stop are
common among those that no limit cut, they are whole; where they are rare, they were cut there.

Defined cases: null, empty and blank texts are not cut; equal texts count once as evidence and have
the same result; every text is read whole; a null source is a source of its own in the shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: Of the texts at a node, at most this share ends there: cut; at least this share: whole (bounds).
CUT, WHOLE = 0.17, 0.12
#: Of the words in a context, at least this share ends there whatever the word: whole; at most this share: cut (bounds).
PLACE, NEVER = 0.55, 0.033
#: A text that lacks only its last stop, by this share of its likes, is whole in a source in which such texts are at least this share (a bound) of those that seem cut.
LACKS, LEAVES_OFF = 0.15, 0.25
#: In such a source, the share of likes that have the stop from which a text is whole.
LACKS_THERE = 0.01
#: A length of a source is a limit if at least this share of its texts is cut by their words (not by a missing stop alone), and as many as this share of what would come there are seen (bounds).
LIMIT_SHARE, LIMIT_SEEN = 0.38, 0.82
#: Texts pile up at a length that holds at least this share of those up to so many longer or shorter.
PILED, NEAR = 0.5, 8
#: Of the other texts with one ending, at least this share has one length: a bound, and one for a word alone in its line or for lengths that are only near.
ONE, ONE_ALONE = 0.5, 0.79

#: Characters of sentences that a worker holds before it takes them apart and hands their counts on.
HELD = 12 << 20
#: Bits of the filter that says in which contexts some text stops: 16 MB, whatever the corpus.
FILTER_BITS = 1 << 27
#: Parts in which the words of a context that holds a large share of all words are joined.
SALTS = 16
#: So many ids of copies are broadcast at most.
COPIES = 1_000_000

_SIGNS = "\u3001-\u30ff\u3400-\u9fff\uff00-\uffef"
_SPACE = "\\s\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000"
_STOPS = "[.!?。！？]"
_TOKEN = re.compile(f"(?![。！？])[{_SIGNS}][。！？]*|[。！？]+|[^{_SPACE}{_SIGNS}]+")
_HEX = re.compile("[0a-f]{6,}+(?![a-z0-9])")
_IN_WORDS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_CLOSING = "[)\\]\"'”»`*_]"
#: Where a sentence is over: the next word begins a context of its own, as a line does.
_OVER = re.compile(f"([.!?]{_CLOSING}{{0,2}})[{_SPACE}]+")
_OVER_SIGN = re.compile("([。！？])")
_NUMBER = re.compile("0[0,.]*")
_RUN = re.compile(r"(.)\1{6,}", re.S)
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
#: Marks that something was left out, besides three dots or more and the sign for them: in brackets, and counts of what is left out.
_BRACKETED = re.compile(r"(?i)<(?:omitted|truncated|snip|snipped|cut|more)>|\[(?:\+?[0-9,]+ (?:more|chars|bytes|lines|characters)|[a-z ]*(?:cut|truncated|omitted)|\.{3}|…|snip)\]")
_COUNTED_OFF = re.compile(r"(?i)\(\+?[0-9,]+ (?:more|chars|bytes|lines)[^)]*\)$")
_BLANKS = " \t\r\n\x0b\x0c\x85\xa0\u2002\u2003\u2009\u200b\u3000"
#: What a character of which bytes are missing is read as.
_BROKEN = "\ufffd"


def _unmarked(t: str) -> str:
    """Without the mark at its end, if it ends in one. Only where the mark would have to begin is looked at, so long texts cost no more."""
    end = t[-1:]
    if end in ("…", "."):
        rest = t[:-1] if end == "…" else t.rstrip(".")
        return rest if end == "…" or len(t) - len(rest) >= 3 else t
    if end in (">", "]"):
        at = max(t.rfind("<" if end == ">" else "["), 0)
        return t[:at] if _BRACKETED.fullmatch(t, at) else t
    if end == ")" and (m := _COUNTED_OFF.search(t, t.rfind(")", 0, len(t) - 1) + 1)):
        rest = t[: m.start()].rstrip()
        before = _unmarked(rest) if rest.endswith(("…", "...")) else rest
        return before
    return t


def body(text: str) -> str:
    """The text without trailing white space and without a mark at its end."""
    t = text.rstrip(_BLANKS)
    return _unmarked(t).rstrip(_BLANKS)


def _id_sign(m: re.Match) -> str:
    """# for a hexadecimal id with letters and digits that is no part of a word, ``0x`` before it or not."""
    run, text, i = m[0], m.string, m.start()
    if "0" not in run or not run.strip("0"):
        return run
    if i and text[i - 1] in _IN_WORDS and not (text[i - 2 : i] == "0x" and (i < 3 or text[i - 3] not in _IN_WORDS)):
        return run
    return "#"


def parts(text: str) -> list[str]:
    """The sentences and lines of a text, digits and ids made alike."""
    # digits are single bytes, and bytes are translated much faster than text
    t = _HEX.sub(_id_sign, text.encode("utf-8", "replace").translate(_DIGITS).decode("utf-8")).replace("0x#", "#")
    t = _OVER.sub(r"\1\n", t)
    return [p for p in (t if t.isascii() else _OVER_SIGN.sub(r"\1\n", t)).split("\n") if p]


def _short(token: str) -> str:
    return _NUMBER.sub("0", token) if "0" in token else token


#: Words of context, the longest first; 0 is the bare trie, in parts by the first sign of a word.
LEVELS = (4, 2, 1, 0)


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little")


_START = _hash("^")
_MIX = 0x9E3779B97F4A7C15


class Laid:
    """Sentences taken apart: the tokens of all of them in a row, and the context of each as one number per level.

    The context is the up to four words (or eight signs) before a token, ^ where the sentence begins; numbers before other
    signs are alike. What costs is done once per distinct token; contexts are sums over shifted arrays.
    """

    def __init__(self, parts: list[str]):
        import numpy as np

        found = [_TOKEN.findall(p) for p in parts]
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = list(chain.from_iterable(found))
        place = {t: i for i, t in enumerate(dict.fromkeys(flat))}
        self.ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        self.tokens = [_RUN.sub(r"\1\1\1\1\1\1", t) if len(t) > 16 else t for t in place]
        self.ends = np.cumsum(self.lengths)
        self.at = np.arange(len(flat)) - np.repeat(self.ends - self.lengths, self.lengths)
        words = np.fromiter((_hash(_short(t)) for t in self.tokens), np.uint64, len(self.tokens))[self.ids]
        first = np.fromiter((_hash(t[0]) for t in self.tokens), np.uint64, len(self.tokens))[self.ids]
        signs = np.flatnonzero(np.fromiter((t[0] >= "\u3000" for t in self.tokens), bool, len(self.tokens))[self.ids])

        def before(some, k):
            there = self.at[some] >= k
            return np.where(there, words[np.where(there, some - k, 0)], np.uint64(_START)) if len(some) else words[:0]

        def longer(c, some, k):
            c = (c ^ before(some, k)) * np.uint64(_MIX)
            return c ^ (c >> np.uint64(29))

        every = np.arange(len(flat))
        self.contexts, c, c_signs = {0: first}, np.zeros(len(flat), np.uint64), np.zeros(len(signs), np.uint64)
        for k in (1, 2, 3, 4):
            c = longer(c, every, k)
            if k != 3:
                self.contexts[k] = c
        self.contexts = {w: x.copy() for w, x in self.contexts.items()}
        for k in range(1, 9):
            c_signs = longer(c_signs, signs, k)
            if k in (2, 4, 8):
                self.contexts[k // 2][signs] = c_signs


def _alone() -> list[int]:
    """The contexts of the first token of a sentence: where every line begins."""
    one = Laid(["a", "\u4e00"])
    return sorted({int(x) for w in (4, 2, 1) for x in one.contexts[w].view("int64")})


def endings(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """One row per text that is not blank: how it ends; tok is its last token, c4 to c0 are the contexts, ``starts`` whether it begins its sentence."""
    fields = "id long, source string, chars long, bytes long, hash long, open boolean, broken boolean, tok string, c4 long, c2 long, c1 long, c0 long, starts boolean"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bodies = [body(t or "") for t in batch.column("t").to_pylist()]
            last = [(parts(b[b.rfind("\n") + 1 :])[-1:] or [""])[0] for b in bodies]
            laid = Laid(last)
            # a last line of nothing but invisible signs has no token and no evidence
            none = laid.lengths == 0
            final = np.where(none, 0, laid.ends - 1)
            pick = lambda x: pa.array(x[final].view(np.int64) if len(x) else np.zeros(len(final), np.int64), pa.int64(), mask=none)
            toks = pa.array([None if n else laid.tokens[laid.ids[f]] for n, f in zip(none, final)], pa.string())
            starts = pa.array(laid.lengths == 1, pa.bool_(), mask=none)
            own = [pa.array([b.count("```") % 2 == 1 for b in bodies], pa.bool_()), pa.array([b.endswith(_BROKEN) for b in bodies], pa.bool_()), toks, *(pick(laid.contexts[w]) for w in LEVELS), starts]
            names = ["id", "source", "chars", "bytes", "hash"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *own], [*names, "open", "broken", "tok", "c4", "c2", "c1", "c0", "starts"]).filter(pa.array([bool(b) for b in bodies], pa.bool_()))

    d = docs.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("hash"), F.col(text).alias("t"))
    return d.mapInArrow(run, fields)


def _leveled(finals: DataFrame) -> DataFrame:
    """Each ending once for each length of context: (words, c, ...)."""
    return finals.select("*", F.inline(F.array(*[F.struct(F.lit(w).alias("words"), F.col(f"c{w}").alias("c")) for w in LEVELS])))


def _filter_place(words: int, contexts):
    """Where a context stands in the filter, for an array of them."""
    import numpy as np

    return (contexts >> np.uint64(8 * words)) & np.uint64(FILTER_BITS - 1)


def asked(finals: DataFrame) -> bytes:
    """A filter of the contexts in which some text stops: one bit each of a fixed number. What is asked for always passes."""
    place = F.expr(f"shiftrightunsigned(c, 8 * words) & {FILTER_BITS - 1}")
    bits = _leveled(finals.filter("tok is not null")).select((place + 1).alias("n"))
    rows = bits.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")).collect()  # as many as the filter has, whatever the corpus
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def goings_on(docs: DataFrame, text: str, filter_: bytes) -> DataFrame:
    """(words, c, tok, goes, ends): under each length of context, every token of the corpus but each text's last, followed by more, or ending a line or sentence.

    A worker counts before anything is shuffled, and drops what stands in a context in which no text stops.
    """
    told = docs.sparkSession.sparkContext.broadcast(filter_)
    ddl = "words int, c long, tok string, goes long, ends long"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(told.value, np.uint8)
        inner: dict[str, int] = {}  # equal sentences are taken apart once
        last: dict[str, int] = {}

        def taken_apart():
            laid = Laid([*inner, *last])
            times = np.repeat(np.fromiter(chain(inner.values(), last.values()), np.int64, len(inner) + len(last)), laid.lengths)
            final = np.zeros(len(laid.ids), bool)
            final[laid.ends[laid.lengths > 0] - 1] = True
            # what ends a text says nothing about going on
            counts = ~final
            counts[: laid.ends[len(inner) - 1] if inner else 0] = True
            toks = pa.array(laid.tokens, pa.string())
            for w in LEVELS:
                c = laid.contexts[w]
                place = _filter_place(w, c)
                some = np.flatnonzero(counts & ((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))
                order = some[np.lexsort((laid.ids[some], c[some]))]
                if not len(order):
                    continue
                own, ids = c[order], laid.ids[order]
                begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])])
                goes = np.add.reduceat(np.where(final[order], 0, times[order]), begins)
                ends = np.add.reduceat(np.where(final[order], times[order], 0), begins)
                n = len(begins)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, w, np.int32)), pa.array(own[begins].view(np.int64)), toks.take(pa.array(ids[begins])), pa.array(goes), pa.array(ends)], ["words", "c", "tok", "goes", "ends"])
            inner.clear()
            last.clear()

        held = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = parts(body(t or ""))
                if found:
                    end = found.pop()
                    last[end] = last.get(end, 0) + 1
                    held += len(end)
                for part in found:
                    inner[part] = inner.get(part, 0) + 1
                held += sum(map(len, found))
                if held >= HELD:
                    yield from taken_apart()
                    held = 0
        if inner or last:
            yield from taken_apart()

    return docs.select(text).mapInArrow(run, ddl)


def _nodes(grams: DataFrame, finals: DataFrame) -> DataFrame:
    """(words, c, tok, stops, below, stopped, goes, ends, ctx_goes, ctx_ends, ctx_stops): the node of each last token under each length of context."""
    key = ["words", "c", "tok"]
    stops = _leveled(finals).groupBy(*key).agg(F.sum("texts").alias("stops"))
    depths = stops.groupBy("words", "c").agg(F.collect_set(F.length("tok")).alias("depths"), F.sum("stops").alias("ctx_stops"))
    g = grams.groupBy(*key).agg(F.sum("goes").alias("goes"), F.sum("ends").alias("ends"))
    # the bare trie and the beginnings of lines hold a large share of all words: their words are joined in parts
    hot = (F.col("words") == 0) | F.col("c").isin(_alone())
    g = g.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("tok"), F.lit(SALTS)).cast("int")).otherwise(0))
    salted = depths.select("words", "c", "depths").withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    g = g.join(salted, ["words", "c", "salt"])  # contexts in which no text stops are not asked for
    # a word passes through its own node, and through those of its beginnings that some text stops at
    own = F.struct(F.col("tok").alias("t"), F.col("goes").alias("goes"), F.col("ends").alias("ends"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("stopped"))
    n = F.col("goes") + F.col("ends")
    zero = F.lit(0).cast("long")
    begun = F.transform(
        F.filter("depths", lambda x: x < F.length("tok")),
        lambda x: F.struct(F.substring("tok", F.lit(1), x).alias("t"), zero.alias("goes"), zero.alias("ends"), n.alias("below"), F.when(F.substring("tok", x + 1, F.length("tok")).rlike(f"^{_STOPS}+$"), n).otherwise(zero).alias("stopped")),
    )
    passed = g.select("words", "c", F.inline(F.concat(F.array(own), begun))).groupBy("words", "c", F.col("t").alias("tok")).agg(*[F.sum(x).alias(x) for x in ("goes", "ends", "below", "stopped")])
    whole = g.groupBy("words", "c").agg(F.sum("goes").alias("ctx_goes"), F.sum("ends").alias("ctx_ends"))
    out = stops.join(passed, key, "left").join(depths.select("words", "c", "ctx_stops"), ["words", "c"]).join(whole, ["words", "c"], "left")
    none = lambda x: F.coalesce(x, zero).alias(x)
    return out.select(*key, "stops", *[none(x) for x in ("below", "stopped", "goes", "ends", "ctx_goes", "ctx_ends", "ctx_stops")])


def _low(k: Column, n: Column) -> Column:
    """The lower bound of a share of k in n, one standard error from it; 0 of nothing."""
    return F.coalesce((k + 0.5 - F.sqrt(F.try_divide(k * (n - k), n) + 0.25)) / (n + 1), F.lit(0.0))


def _high(k: Column, n: Column) -> Column:
    """The upper bound; 1 of nothing."""
    return F.coalesce((k + 0.5 + F.sqrt(F.try_divide(k * (n - k), n) + 0.25)) / (n + 1), F.lit(1.0))


def judged(grams: DataFrame, finals: DataFrame) -> DataFrame:
    """(c4, tok, verdict, prefix, broken_word, recurs, share, words, lacks): of each distinct ending 'cut', 'whole' or 'unsure'.

    ``finals`` has each text once. ``prefix`` says that the trie alone decided, ``broken_word`` whether the token is an unknown prefix of words,
    ``recurs`` whether it is whole only by texts that stop there; ``share`` of the texts end there, by a context of so many words.
    """
    # distinct endings are read once for each use, so they are written
    finals = cut(finals.filter("tok is not null").groupBy("tok", *[f"c{w}" for w in LEVELS]).agg(F.count(F.lit(1)).alias("texts")))
    nodes = _nodes(grams, finals)
    keys = _leveled(finals.drop("texts"))
    stats = ("stops", "below", "stopped", "goes", "ends", "ctx_goes", "ctx_ends", "ctx_stops")
    at = lambda w: F.max(F.when(F.col("words") == w, F.struct(*stats))).alias(f"l{w}")
    d = keys.join(nodes, ["words", "c", "tok"]).groupBy("c4", "tok").agg(*[at(w) for w in LEVELS])
    said: list[Column] = []  # the first that applies decides
    lacks: list[Column] = []

    def say(when: Column, verdict: str, share: Column, words: int, recurs: Column | bool = False, by_prefix: bool = False) -> None:
        r = recurs if isinstance(recurs, Column) else F.lit(recurs)
        said.append(F.when(when, F.struct(F.lit(verdict).alias("verdict"), r.alias("recurs"), share.alias("share"), F.lit(words).alias("words"), F.lit(by_prefix).alias("prefix"))))

    x = lambda name, w: F.col(f"l{w}.{name}")
    known = x("goes", 0) + x("ends", 0) > 0
    prefix = ~known & (x("below", 0) > 1)
    broken = ~known & (x("below", 0) - x("stopped", 0) > 1)  # more than a stop is missing
    for w in LEVELS:
        goes, inner = x("below", w) + x("goes", w), x("ends", w)
        ends = inner + x("stops", w) - 1  # without itself
        n = goes + ends
        share = F.try_divide(ends.cast("double"), n)
        cut_, whole = _high(ends, n) < CUT, _low(ends, n) >= WHOLE
        lacks.append(F.when((n > 0) & (cut_ | whole), F.try_divide(x("stopped", w).cast("double"), n)))
        if w == 4:
            say(broken & ~whole, "cut", share, 0, by_prefix=True)
        # without any context only what is no word says that a text is cut
        say(prefix if w == 0 else cut_, "cut", share, w)
        say(whole, "whole", share, w, (inner == 0) | (inner < (goes + inner) * 0.2))
        if w in (4, 2):
            # the token says nothing here; the place does
            inner = x("ctx_ends", w)
            cends = inner + x("ctx_stops", w) - 1
            cn = x("ctx_goes", w) + cends
            cshare = F.try_divide(cends.cast("double"), cn)
            say(_low(cends, cn) >= PLACE, "whole", cshare, w, (inner == 0) | (inner < (x("ctx_goes", w) + inner) * 0.5))
            say(_high(cends, cn) < NEVER, "cut", cshare, w)
    first = F.get(F.filter(F.array(*said), lambda v: v.isNotNull()), F.lit(0))
    d = d.select("c4", "tok", first.alias("said"), broken.alias("broken_word"), F.coalesce(*lacks, F.lit(0.0)).alias("lacks"))
    no = F.lit(False)
    return d.select("c4", "tok", F.coalesce("said.verdict", F.lit("unsure")).alias("verdict"), F.coalesce("said.prefix", no).alias("prefix"), "broken_word", F.coalesce("said.recurs", no).alias("recurs"), "said.share", "said.words", "lacks")


def _one_length(seen: DataFrame) -> DataFrame:
    """(c4, tok, s): endings that recur in a source, not judged to be cut, and whose texts are of one length there."""
    texts = seen.filter("(broken_word or recurs) and verdict <> 'cut'").select("c4", "tok", "s", "starts", "hash", "chars", "bytes").distinct()
    quarters = [F.percentile_approx(m, [0.25, 0.75]).alias(f"q_{m}") for m in ("chars", "bytes")]
    # half of them within a band, or all at one length; a word alone in its line is no place in a text, so it needs the latter
    same = texts.groupBy("c4", "tok", "s").agg(F.count(F.lit(1)).alias("n"), F.bool_or("starts").alias("alone"), *[(F.max(m) - F.min(m)).alias(f"w_{m}") for m in ("chars", "bytes")], *quarters)
    band = F.least(*[F.col(f"q_{m}")[1] - F.col(f"q_{m}")[0] for m in ("chars", "bytes")]) <= 2 * NEAR
    others = _low(F.col("n") - 1, F.col("n") - 1)
    one = (F.least("w_chars", "w_bytes") == 0) & (others >= F.when(F.col("alone"), ONE_ALONE).otherwise(ONE))
    return same.filter(one | ((others >= ONE_ALONE) & band & ~F.col("alone"))).select("c4", "tok", "s", F.lit(True).alias("at_one"))


def truncated(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, cut, rule, verdict, at_limit, open, broken, share, words, lacks) of every text that is not blank; ``rule`` says what decided that it is cut."""
    docs = spread(docs.select(id, text, source))
    finals = cut(endings(docs, id, text, source))
    # equal texts are evidence once; texts are shuffled for that only if the copies are too many to broadcast
    same = ["hash", "chars", "bytes"]
    copies = finals.join(finals.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), same).filter("id > first").select(F.col("id").alias("copy"))
    copies = cut(copies)
    few = copies.count() <= COPIES
    without = lambda df, own: df.join(F.broadcast(copies) if few else copies, F.col(own) == F.col("copy"), "left_anti")
    grams = cut(goings_on(without(docs, id), text, asked(finals)))
    verdicts = judged(grams, without(finals, "id"))
    src = F.coalesce("source", F.lit(""))
    no = F.lit(False)
    seen = cut(finals.withColumn("s", src).join(verdicts, ["c4", "tok"], "left").withColumns({"verdict": F.coalesce("verdict", F.lit("unsure")), **{c: F.coalesce(c, no) for c in ("prefix", "broken_word", "recurs")}}))
    seen = seen.join(_one_length(seen), ["c4", "tok", "s"], "left")
    seen = cut(seen.withColumns({"verdict": F.when(F.col("at_one") & F.col("broken_word"), "cut").otherwise(F.col("verdict")), "recurs": F.col("recurs") & ~F.col("broken_word") & F.coalesce("at_one", no)}))
    once = seen.dropDuplicates(["s", *same])
    limits = None
    for measure in ("chars", "bytes"):
        by_length = once.groupBy("s", F.col(measure).alias("m")).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("recurs"), 1)).alias("told"), F.count(F.when((F.col("verdict") == "cut") & (F.coalesce("lacks", F.lit(0.0)) < LACKS), 1)).alias("cuts")
        )
        # one row per source and length
        near = Window.partitionBy("s").orderBy("m").rangeBetween(-NEAR, NEAR)
        by_length = by_length.withColumn("piled", F.col("n") >= F.sum("n").over(near) * PILED)
        most = lambda n: (_low(F.col("cuts"), F.col(n)) >= LIMIT_SHARE) & (_low(F.col(n), F.col(n)) >= LIMIT_SEEN)
        found = by_length.filter(most("n") | (F.col("piled") & most("told"))).select("s", "m", "piled", F.lit(measure).alias("measure"))
        limits = found if limits is None else limits.unionByName(found)
    marked = seen
    for measure in ("chars", "bytes"):
        own = limits.filter(F.col("measure") == measure).select("s", F.col("m").alias(measure), F.lit(True).alias(f"limit_{measure}"), F.col("piled").alias(f"piled_{measure}"))
        marked = marked.join(own, ["s", measure], "left")
    at_limit = F.coalesce("limit_chars", F.lit(False)) | F.coalesce("limit_bytes", F.lit(False))
    at_pile = F.coalesce("piled_chars", F.lit(False)) | F.coalesce("piled_bytes", F.lit(False))
    # sources that leave off the last stop of complete texts, told by texts that no limit cut
    free = marked.filter(~at_limit & ~F.col("open") & ~F.col("broken") & (F.col("verdict") == "cut")).dropDuplicates(["s", *same])
    off = _low(F.count(F.when(F.col("lacks") >= LACKS, 1)), F.count(F.lit(1)))
    habits = free.groupBy("s").agg(off.alias("off")).filter(F.col("off") >= LEAVES_OFF).select(F.col("s").alias("hs"))
    marked = marked.join(habits, F.col("s") == F.col("hs"), "left")
    stopped = F.coalesce(F.col("tok").rlike(f"{_STOPS}{_CLOSING}*$"), F.lit(False))  # may be whole and as long as a limit by chance
    stopless = F.col("hs").isNotNull() & (F.col("lacks") >= LACKS_THERE) & ~at_limit
    is_ = lambda v: F.col("verdict") == v
    by_prefix = (F.col("prefix") & ~stopless) | (F.coalesce("at_one", no) & F.col("broken_word"))
    by_length = at_pile & ~stopped & ~stopless & (~is_("whole") | F.col("recurs"))
    by_context = (is_("cut") & ~stopless) | (is_("unsure") & at_limit) | (F.col("recurs") & ~stopped & at_pile)
    rule = F.when(by_prefix, "prefix").when(by_length, "length").when(F.col("open"), "block").when(F.col("broken"), "sign").when(by_context, "context")
    return marked.withColumn("rule", rule).select(F.col("id").alias(id), F.col("source").alias(source), F.col("rule").isNotNull().alias("cut"), "rule", "verdict", at_limit.alias("at_limit"), "open", "broken", "share", "words", "lacks")
