"""Streams against their batch equivalents, with the trigger that ends."""

import json
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from ledgerline.operators import late
from ledgerline.streaming import daily, messages
from ledgerline.streaming.late import LateTotals

DAY0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_the_ledger_stream_equals_the_batch(spark, tmp_path):
    row = lambda n, p, t: {"timestamp": (DAY0 + timedelta(hours=n)).isoformat(), "provider": p, "input_tokens": t, "output_tokens": None}
    rows = [row(n % 50, ["A", " a ", None, "b"][n % 4], n) for n in range(200)]
    (tmp_path / "in").mkdir()
    for k in range(4):
        # every file repeats some rows of the one before, and the ledger counts them again
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(r) for r in rows[max(0, 50 * k - 9) : 50 * k + 50] + [row(0, "x", None) | {"timestamp": "unknown"}]))
    schema = "timestamp string, provider string, input_tokens long, output_tokens long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    daily.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.day, r.provider): (r.calls, r.tokens) for r in daily.totals(spark, str(tmp_path / "out")).collect()}
    want = {}
    for r in rows + [x for k in (50, 100, 150) for x in rows[k - 9 : k]]:
        k = (r["timestamp"][:10], (r["provider"] or "fleet").strip().lower())
        c, t = want.get(k, (0, 0))
        want[k] = (c + 1, t + r["input_tokens"])
    assert got == want


def test_rows_of_long_ago_count_as_often_as_they_come(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    for k, days in enumerate([1000, 1001, 0, 0, 1001]):
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"timestamp": (DAY0 + timedelta(days=days)).isoformat(), "provider": "a", "input_tokens": 5, "output_tokens": 1}))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("timestamp string, provider string, input_tokens long, output_tokens long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    daily.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.calls, r.tokens) for r in daily.totals(spark, str(tmp_path / "out")).collect()) == [(1, 6), (2, 12), (2, 12)]


def test_the_first_delivery_of_each_message_is_passed_on(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    stamps = ["2026-01-01T00:00:00Z", "2030-01-01T00:00:00Z", "1999-01-01T00:00:00Z"]  # none is too late to be passed on
    for k in range(3):
        rows = [{"id": f" m{n}", "t": stamps[k], "n": k} for n in range(3 * k, 3 * k + 5)] + [{"id": x, "t": None, "n": k} for x in (None, " ", " ")]
        (tmp_path / f"in/{k}.json").write_text("\n".join(map(json.dumps, rows + rows[:2])))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("id string, t string, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = messages.first_deliveries(stream, F.col("id"), "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.id or "").strip() for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(x for x in got if x) == sorted(f"m{n}" for n in range(11)) and got.count("") == 9


def records(spark, rows):
    return spark.createDataFrame([(s, date(2026, 1, d), DAY0 + timedelta(days=d - 1, hours=h), v, o) for s, d, h, v, o in rows], "source string, period date, stamp timestamp, value long, `order` long")


def test_periods_close_by_the_slowest_source_and_later_records_are_diverted(spark, tmp_path):
    t = LateTotals(spark, str(tmp_path), "long", lateness=24 * late.HOUR, idle=4 * late.DAY)
    batches = [
        [("a", 1, 1, 10, 1), ("b", 1, 2, 5, 2)],
        [("a", 1, 30, 11, 3), ("a", 1, 20, 99, 4)],  # out of order: 30 h after is the last in time
        [("a", 3, 5, 7, 5)],  # a passes day 1, b does not
        [("b", 3, 6, 7, 6), ("b", 1, 3, 8, 7)],  # b passes too: day 1 closes with this batch, its early record included
        [("a", 1, 40, 12, 8), ("b", 1, 90, 1, 9)],  # in time by its stamp but closed; too late by its stamp
        [("a", 20, 1, 1, 10)],  # b idles: all that is older closes
    ]
    for n, b in enumerate(batches):
        t.merge(records(spark, b), n)
        if n == 2:
            assert t.closed(n).count() == 0
        t.merge(records(spark, b), n)  # a batch that runs again changes nothing
    final = {(r.source, str(r.period)): (r.f, r.l, r.n) for r in t.final().collect()}
    assert final["a", "2026-01-01"] == (10, 11, 3) and final["b", "2026-01-01"] == (5, 8, 2)
    assert final["a", "2026-01-03"] == (7, 7, 1) and final["b", "2026-01-03"] == (7, 7, 1)
    assert sorted(r.order for r in t.diverted().collect()) == [8, 9]
    assert {(str(r.period), r.batch) for r in t.closed(5).collect()} == {("2026-01-01", 3), ("2026-01-03", 5)}
    assert [(r.source, str(r.period)) for r in t.open(5).collect()] == [("a", "2026-01-20")]


def test_a_stream_without_closing_stands_as_the_batch(spark, tmp_path):
    rows = [(("a", "b")[n % 2], 1 + n % 3, n % 110, n % 4, n) for n in range(120)]
    r = records(spark, rows)
    r.repartition(6).write.parquet(str(tmp_path / "in"))
    t = LateTotals(spark, str(tmp_path / "state"), "long", lateness=72 * late.HOUR)
    t.start(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 50).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    batch = late.replay(r, "source", "period", "stamp", "value", "order").settled().filter("n_in_time > 0")
    want = {(x.source, x.day): (x.first_value, x.last_value, x.n_in_time) for x in batch.collect()}
    got = {(x.source, x.period): (x.f, x.l, x.n) for x in t.open(0).unionByName(t.final()).collect()}
    assert got == want
