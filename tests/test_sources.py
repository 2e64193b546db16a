"""Readers of raw logs on small files, in the shapes that agents write."""

import json

from pyspark.sql import functions as F

from ledgerline.operators import fleet
from ledgerline.sources import dailies, logs

USAGE = {"input_tokens": 10, "output_tokens": 100, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 50_000}


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def said(uuid, request, **more):
    return {"uuid": uuid, "timestamp": "2026-08-01T10:00:00Z", "requestId": request, "message": {"model": "m", "usage": USAGE}} | more


def test_transcripts_count_each_request_once(spark, tmp_path):
    put(tmp_path / "p/a.jsonl", said("a", "r1"), said("b", "r1"), "", "{broken", said("c", "r1"), said("lonely", None), {"timestamp": "2026-08-01", "usage": {}})
    put(tmp_path / "p/b.jsonl", said("same", None), said("same", None), said("d", "r1"), said("e", "r2", timestamp="2020-01-01T00:00:00Z"), {"timestamp": "2026-08-01T00:00:00Z", "message": {"usage": USAGE}})
    got = logs.transcripts(spark, str(tmp_path), "2026-01-01", "2027-01-01").collect()
    assert sum(r.cache_read for r in got) == 4 * 50_000 and {r.session_id for r in got} == {"p"}
    assert sorted(r.model for r in got) == ["m", "m", "m", "unknown"]


def test_lines_keep_their_numbers_in_any_split(spark, tmp_path):
    texts = {f: [json.dumps({"n": k}) if k % 5 else "" for k in range(n)] for f, n in (("a", 700), ("b", 3), ("c", 0), ("d", 1500))}
    for f, ls in texts.items():
        (tmp_path / f"{f}.jsonl").write_bytes(("\r\n" if f == "b" else "\n").join(ls).encode() + (b"\n" if f == "a" else b""))
    want = {(f, k, k) for f, ls in texts.items() for k, x in enumerate(ls) if x}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "2k", "777"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = logs.lines(spark, str(tmp_path), "*.jsonl").select(F.regexp_extract("file", "([a-d])[.]jsonl$", 1).alias("f"), "nth", logs.long_of("v", "$.n").alias("n"))
            assert {tuple(r) for r in d.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_snapshots_take_the_first_name_that_has_a_count(spark, tmp_path):
    put(tmp_path / "s1.json", {"generatorMetadata": [{"chatModel": {"model": "models/MODEL_PLACEHOLDER_M18", "usage": {"inputTokens": "7", "output_tokens": 3, "thinkingOutputTokens": 0, "reasoning": 2}, "chatStartMetadata": {"createdAt": "2026-08-01T00:00:00Z"}}}, {"chatModel": {"usage": {}}}]})
    put(tmp_path / "bad.json", "{")
    got = logs.snapshots(spark, str(tmp_path)).collect()
    assert [(r.model, r.input_tokens, r.output_tokens, r.reasoning, r.session_id) for r in got] == [("gemini-m18", 7, 3, 2, "s1")]


def test_rollouts_join_threads_by_path(spark, tmp_path):
    f = tmp_path / "x/rollout-1.jsonl"
    put(f, {"type": "event_msg", "timestamp": "2026-08-01T00:00:00Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 100, "cached_input_tokens": 60, "output_tokens": 5, "reasoning_output_tokens": 1}}}}, {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, {"type": "other"})
    threads = spark.createDataFrame([("big", str(f), 50, 500), ("none", None, 50, None), ("gone", "/no/such", 99, 1)], "model string, rollout_path string, updated_at long, tokens_used long")
    got = logs.rollouts(spark, threads, str(tmp_path)).collect()
    assert [(r.model, r.input_tokens, r.cache_read, r.output_tokens, r.reasoning) for r in got] == [("big", 40, 60, 5, 1)]
    assert tuple(logs.native_total(threads, 49, 50).first()) == (2, 500) and tuple(logs.native_total(threads, 100, 200).first()) == (0, 0)


def test_sessions_mix_measured_and_estimated(spark, tmp_path):
    at = lambda n: f"2026-08-01T00:00:0{n}Z"
    put(tmp_path / "session-2026-08-01a.json", {"startTime": at(0), "messages": [
        {"id": "1", "type": "user", "content": "x" * 400, "timestamp": at(1)},
        {"id": "2", "type": "gemini", "content": [{"text": "y" * 40}, "z" * 40], "timestamp": at(2)},
        {"id": "3", "type": "user", "content": {"content": "w" * 80}, "timestamp": at(3)},
        {"id": "4", "type": "gemini", "content": "old", "model": "g-1", "timestamp": at(4)},
        {"id": "4", "type": "gemini", "content": "new", "model": "g-1", "timestamp": at(4), "tokens": {"input": 50, "output": 6, "cached": 20, "thoughts": 2}},
    ]})
    put(tmp_path / "session-2026-08-01b.jsonl", {"id": "1", "role": "assistant", "content": "a", "timestamp": at(1)}, "{broken")
    m = logs.sessions(spark, str(tmp_path))
    assert m.count() == 4
    got = [(r.model, r.input_tokens, r.cache_read, r.output_tokens, r.exact) for r in logs.session_calls(m).orderBy("timestamp").collect()]
    assert got == [("g-1", 6100, 0, 20, False), ("g-1", 30, 20, 6, True)]


def test_sessions_of_other_days_are_not_opened(spark, tmp_path):
    for d in ("2026-08-01", "2026-08-02", "2026-08-05"):
        put(tmp_path / f"session-{d}x.jsonl", {"id": "1", "role": "user", "content": "a", "timestamp": f"{d}T00:00:00Z"})
    assert logs.sessions(spark, str(tmp_path), "2026-08-03", "2026-08-03").count() == 1
    assert logs.sessions(spark, str(tmp_path)).count() == 3


def test_the_last_usage_printed(spark):
    rows = [("a", 1, '{"usage": {"input": 1}}'), ("a", 2, '{"usage": {"input": 2}}'), ("a", 3, "noise {"), ("a", 4, '{"usage": {}}'), ("b", 1, "x")]
    got = logs.last_usage(spark.createDataFrame(rows, "k string, o int, line string"), "k", "line", "o").collect()
    assert [tuple(r) for r in got] == [("a", '{"input":2}')]


def test_steps_carry_the_model_and_what_was_sent(spark, tmp_path):
    step = lambda **k: {"created_at": "2026-08-01T00:00:00Z"} | k
    rows = [step(source="USER", type="X", content="<USER_SETTINGS_CHANGE>\nThe user changed setting `Model Selection` from A to Big 3.5 Model (High). No need to say so.\n</USER_SETTINGS_CHANGE>", created_at="2020-01-01T00:00:00Z"), step(source="USER", type="X", content="q" * 400), step(source="MODEL", type="PLANNER_RESPONSE", content="p" * 40), step(source="USER", type="X", content="q" * 80), step(source="MODEL", type="PLANNER_RESPONSE", content="p" * 8)]
    put(tmp_path / "one/c1/transcript.jsonl", *rows)
    put(tmp_path / "two/c1/transcript.jsonl", *rows)
    put(tmp_path / "two/live/transcript.jsonl", *rows)
    live = spark.createDataFrame([("live",)], "conversation string")
    s = logs.steps(spark, [str(tmp_path / "one"), str(tmp_path / "two")], live)
    assert s.count() == 5
    got = [(r.model, r.input_tokens, r.cache_read, r.output_tokens) for r in logs.step_calls(s, "2026-01-01").orderBy("input_tokens").collect()]
    assert got == [("Big 3.5 Model (High) (estimated)", 20, 6110, 2), ("Big 3.5 Model (High) (estimated)", 6100, 0, 10)]


def test_the_model_chosen_is_read_whole(spark):
    change = lambda rest, what="Model Selection": f"<USER_SETTINGS_CHANGE>\nThe user changed setting `{what}` from None to {rest}"
    texts = {change("Tern 3.5 Swift (High). ok"): "Tern 3.5 Swift (High)", change("Tern 3.5."): "Tern 3.5", change("gpt-x 5.6 sol"): "sol-5.6", change("Dark. ok", "Theme"): None, "from A to B.": None, "": None, None: None}
    df = spark.createDataFrame([(k, k) for k in texts], "t string, k string").select("k", logs.chosen_model(F.col("t"), [("5.6 sol", "sol-5.6"), ("5.6", "other")]).alias("m"))
    assert {r.k: r.m for r in df.collect()} == texts


def test_documents_of_each_kind(spark, tmp_path):
    put(tmp_path / "d.jsonl", {"text": "a b"}, "", "not json", {"text": 5}, {"other": 1}, {"text": None})
    got = sorted((r.text, r.coerced) for r in logs.documents(spark, str(tmp_path / "d.jsonl")).collect())
    assert got == [("", False), ("5", True), ("None", True), ("a b", False), ("not json", False)]
    assert logs.documents(spark, str(tmp_path / "d.jsonl"), kind="text").count() == 6
    spark.createDataFrame([("x",), (None,)], "text string").write.parquet(str(tmp_path / "p"))
    assert sorted(r.text for r in logs.documents(spark, str(tmp_path / "p"), kind="parquet").collect()) == ["None", "x"]
    assert logs.documents(spark, str(tmp_path / "p"), kind="parquet", limit=1).count() == 1


def test_the_ledger_is_appended_to_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("2026-08-01T00:00:00Z", "Brindle", "3", None), ("2026-08-01T00:00:01Z", None, "x", "4"), ("2026-08-01T00:00:02Z", "P", None, None)], "timestamp string, provider string, input_tokens string, output_tokens string")
    for _ in range(2):
        logs.append(rows, str(tmp_path / "l"))
    got = sorted((r.source, r.input_tokens, r.output_tokens, r.session_id) for r in logs.ledger(spark, str(tmp_path / "l")).collect())
    assert got == [("Fleet:Brindle", 3, 0, "fleet")] * 2 + [("Fleet:Fleet", 0, 4, "fleet")] * 2


def test_daily_files_are_replaced_and_read_by_folder(spark, tmp_path):
    inv = spark.createDataFrame([("boxa", "2026-08-01 10:00:00", "s", "m", 1, None, "00" * 8), ("boxa", "2026-08-01 11:00:00", "s", None, 2, True, "11" * 8), ("box b", "2026-08-02 11:00:00", "s", "m", 4, True, "11" * 8)], "machine string, timestamp string, source string, model string, input_tokens long, exact boolean, fingerprint string")
    inv = inv.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumns({c: F.lit(0).cast("long") for c in ("output_tokens", "cache_creation", "cache_read", "reasoning")})
    r = fleet.daily_records(inv, today=F.lit("2026-08-02"))
    for _ in range(2):
        dailies.export(r, str(tmp_path / "out"), "v1")
    dailies.export(r.filter("machine = 'boxa'"), str(tmp_path / "out"), "v2")
    got = {(x.machine, str(x.date)): x for x in dailies.load(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {("boxa", "2026-08-01"), ("box b", "2026-08-02")} and got["boxa", "2026-08-01"].counter == "v2" and got["box b", "2026-08-02"].counter == "v1"
    a = got["boxa", "2026-08-01"]
    assert a.invocations == 2 and a.exact.input_tokens == 2 and a.estimated.input_tokens == 1 and a.models["unknown"].input_tokens == 2 and not a.partial and got["box b", "2026-08-02"].partial
    assert [x.machine for x in dailies.known_machines(spark, str(tmp_path / "out")).collect()] == ["box b", "boxa"]
    for name, body in {"m1/2026-01-01.json": {"schema": 3, "machine": "liar", "date": "2026-01-01"}, "m1/2026-01-02.json": "{", "m2/2026-01-01.json": {"schema": 999, "machine": "m2", "date": "2026-01-01"}, "m2/2026-01-03.json": [1]}.items():
        put(tmp_path / "files" / name, body)
    by_folder = dailies.load_files(spark, str(tmp_path / "files/*/*.json")).collect()
    assert [(x.machine, x.date) for x in by_folder] == [("m1", "2026-01-01")]
    assert sorted(x.machine for x in dailies.load_files(spark, str(tmp_path / "files/*/*.json"), None, True).collect()) == ["liar", "m2"]
