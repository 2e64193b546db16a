"""Distribution of document lengths in tokens, and pattern scans over texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes that must never stand in a published record (fixed values).
PRIVATE = {
    "drive_path": r"[A-Za-z]:\\\\|[A-Za-z]:/",
    "home_path": r"/Users/|/home/|/root/",
    "session_id": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}",
    "credential": r"(?i)sk-[A-Za-z0-9]|Bearer\s+[A-Za-z0-9]|api[_-]?key\s*[:=]",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "transcript": r"(?i)\.jsonl|transcript",
}
#: Secrets by the form their issuers give them (fixed values).
SECRET = r"sk-[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{20,}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|xox[baprs]-[A-Za-z0-9-]{10,}"


def batch_counter(counts: Callable[[list[str]], list[int]], batch: int = 256) -> Callable[[Column], Column]:
    """A counter of tokens for ``length_stats`` and ``length_state`` from a function that takes many texts at once.

    Texts go to it in Arrow batches, ``batch`` at a time; where it fails on some, they are counted one by one, and one that
    still fails counts 0. Null texts are not sent to it.
    """
    def one(text: str) -> int:
        try:
            return int(counts([text])[0])
        except Exception:  # noqa: BLE001
            return 0

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        there = texts.dropna()
        out: list[int] = []
        for k in range(0, len(there), batch):
            some = there.iloc[k : k + batch].tolist()
            try:
                got = [int(n) for n in counts(some)]
                if len(got) != len(some):
                    raise ValueError("as many counts as texts")
            except Exception:  # noqa: BLE001
                got = [one(t) for t in some]
            out += got
        return pd.Series(out, index=there.index, dtype="Int64").reindex(texts.index)

    return run


def whitespace_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).cast("long")


def chars_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def length_stats(docs: DataFrame, text: str, by: list[str] | None = None, counter: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Documents, null and empty ones, tokens, mean, median, IQR, P95, P99 (linear between neighbours) and sample deviation.

    A null text counts as null and as empty, with 0 tokens. Percentiles are exact: they merge counts per
    distinct length, not texts. The deviation of a single document is null.
    """
    by = by or []
    n = F.coalesce(counter(F.col(text)), F.lit(0).cast("long"))
    d = docs.select(*by, F.col(text).isNull().alias("_null"), (F.coalesce(F.col(text), F.lit("")) == "").alias("_empty"), n.alias("n"))
    p = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95, 0.99)]))
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("_null"), 1)).alias("nulls"), F.count(F.when(F.col("_empty"), 1)).alias("empties"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("tokens"), F.avg("n").alias("mean"), p.alias("p"), F.stddev_samp("n").alias("sd"))
    at = lambda i: F.get("p", F.lit(i))
    r = lambda c: F.round(c, 4)
    return a.select(*by, "docs", "nulls", "empties", "tokens", r("mean").alias("mean"), r(at(1)).alias("median"), r(at(2) - at(0)).alias("iqr"), r(at(3)).alias("p95"), r(at(4)).alias("p99"), r("sd").alias("stddev"))


def length_state(docs: DataFrame, text: str, counter: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """(n, docs, nulls, empties): counts by length, which can be written, united and finished later."""
    n = F.coalesce(counter(F.col(text)), F.lit(0).cast("long"))
    return docs.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col(text).isNull(), 1)).alias("nulls"), F.count(F.when(F.coalesce(F.col(text), F.lit("")) == "", 1)).alias("empties"))


def finished(states: DataFrame) -> DataFrame:
    """What ``length_stats`` says, from one state or several united."""
    p = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95, 0.99)]), F.col("docs"))
    s = states.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("docs", "nulls", "empties")])
    zero = F.lit(0).cast("long")
    w = F.col("n").cast("double") * F.col("docs")
    a = s.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("docs", "nulls", "empties")], F.coalesce(F.sum(F.col("n") * F.col("docs")), zero).alias("tokens"), p.alias("p"), F.sum(w).alias("s1"), F.sum(w * F.col("n")).alias("s2"))
    mean = F.try_divide("s1", F.col("docs").cast("double"))
    sd = F.when(F.col("docs") > 1, F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("docs")) / (F.col("docs") - 1)))
    at = lambda i: F.get("p", F.lit(i))
    r = lambda c: F.round(c, 4)
    return a.select("docs", "nulls", "empties", "tokens", r(mean).alias("mean"), r(at(1)).alias("median"), r(at(2) - at(0)).alias("iqr"), r(at(3)).alias("p95"), r(at(4)).alias("p99"), r(sd).alias("stddev"))


def distribution_report(stats: DataFrame, title: str) -> str:
    """The row of ``length_stats`` as lines of text; what is null is left out."""
    row = stats.first().asDict()
    width = max(map(len, row))
    return "\n".join([title, *(f"  {k.ljust(width)}  {v:,}" for k, v in row.items() if v is not None)])


def pattern_counts(docs: DataFrame, text: str, patterns: dict[str, str] = PRIVATE) -> DataFrame:
    """(pattern, docs): in how many texts each pattern occurs, all in one pass; 0 where in none."""
    hits = [F.count(F.when(F.col(text).rlike(p), 1)).alias(n) for n, p in patterns.items()]
    one = docs.agg(*hits)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("docs")) for n in patterns])))
