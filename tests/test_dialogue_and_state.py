import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.operators import answers, dialogue, evals, history, rollups
from sagewell.streaming import ingest, state


def test_previous_rows_equals_plain_windows(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.random() < 0.4) for k in (1, 2) for t in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k int, t int, ok boolean")
    for n in (1, 3):
        got = history.previous_rows(df, ["k"], "t", F.col("t"), n, qualify=F.col("ok"), bucket=F.floor(F.col("t") / 8))
        for r in got.collect():
            assert r["previous"] == [t for k, t, ok in rows if k == r["k"] and ok and t < r["t"]][-n:]
    plain = F.collect_list("t").over(W.partitionBy("k").orderBy("t").rowsBetween(-4, -1))
    every = history.previous_rows(df, ["k"], "t", F.col("t"), 4, bucket=F.floor(F.col("t") / 8)).withColumn("plain", plain)
    assert every.filter("previous <> plain").count() == 0


def test_gap_segments_cut_exactly_at_the_gap(spark):
    df = spark.createDataFrame([("a", s) for s in (0, 5, 14, 24, 33, 43)], "k string, s long")
    got = {r["s"]: r["segment"] for r in history.gap_segments(df, ["k"], "s", 10).collect()}
    assert got == {0: 1, 5: 1, 14: 1, 24: 2, 33: 2, 43: 3}


def test_chained_rewriting_and_expiry(spark):
    marker = vocab.FOLLOW_UP_MARKERS[0]
    asked = [(1, 0, 1, "first topic"), (1, 10, 2, f"{marker} b"), (1, 20, 3, f"{marker} c"), (1, 1820, 4, f"{marker} d"),
             (1, 1821, 5, f"{marker} {vocab.ANCHORS[0]}"), (2, 0, 1, f"{marker} alone")]
    df = spark.createDataFrame(asked, "conversation_id long, seconds long, request_no long, text string")
    got = {(r["conversation_id"], r["request_no"]): r for r in dialogue.rewrite_with_memory(df).collect()}
    chain = f"first topic{vocab.CONNECTOR}{marker} b"
    assert got[1, 2]["search_query"] == chain
    assert got[1, 3]["search_query"] == f"{chain}{vocab.CONNECTOR}{marker} c"
    assert got[1, 4]["rewrite_source"] == "original"  # the memory expired exactly at its age limit
    assert got[1, 5]["rewrite_source"] == "original" and got[2, 1]["search_query"] == f"{marker} alone"


def test_intent_order(spark):
    cases = {
        "hello there": ("small_talk", "direct_response"),
        "weather tomorrow": ("out_of_scope", "direct_response"),
        f"weather at {vocab.ANCHORS[0]}": ("stable", "knowledge"),
        "any voucher": ("time_sensitive", "knowledge"),
        "my budget": ("stable", "knowledge"),
    }
    rows = dialogue.label_intent(spark.createDataFrame([(k,) for k in cases], "text string")).collect()
    assert {r["text"]: (r["intent"], r["route"]) for r in rows} == cases
    assert {r["text"]: r["confidence"] for r in rows}["my budget"] == 0.0


def test_follow_up_needs_a_short_question(spark):
    df = spark.createDataFrame([("is it far?",), ("is it far",), ("a b c d e f g h i j?",)], "t string")
    assert [r[0] for r in df.select(dialogue.is_follow_up(F.col("t"))).collect()] == [True, False, False]


def test_model_outputs(spark):
    raws = [
        '```json\n{"primary_intent":"general","is_time_sensitive":true,"confidence":0.5,"suggested_route":"direct_handoff"}\n```',
        '{"intent":"small_talk","confidence":0.9}', "not json", '{"primary_intent":"general","is_time_sensitive":false,"confidence":7,"suggested_route":"knowledge"}',
    ]
    rows = dialogue.parse_model_outputs(spark.createDataFrame([(r,) for r in raws], "raw string")).collect()
    assert [(r["valid"], r["route"]) for r in rows] == [(True, "knowledge"), (True, "direct_response"), (False, None), (False, None)]
    texts = dialogue.parse_rewrites(spark.createDataFrame([('{"search_query":" a "}',), ("plain",)], "raw string")).collect()
    assert [r["search_query"] for r in texts] == ["a", "plain"]


def test_claims_and_grounding(spark):
    a = spark.createDataFrame([(1, "Open 9:00, costs 12.000 VNĐ"), (2, "Open 8:00"), (3, "no numbers")], "answer_id long, answer string")
    h = spark.createDataFrame([(1, "from 9:00; 12.000vnđ"), (2, "from 9:00")], "answer_id long, content string")
    got = {r["answer_id"]: r["grounded"] for r in answers.check_grounding(a, h).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_transcript_scoring(spark):
    cases = spark.createDataFrame(
        [(1, "what are the opening hours", ["nine"], ["never"], True, "search_kb"), (2, "something else entirely", [], [], False, None)],
        "case_id long, expected string, required array<string>, forbidden array<string>, requires_tool_call boolean, expected_tool string",
    )
    turns = spark.createDataFrame(
        [(7, 0, "user", "What are  the opening hour"), (7, 1, "agent", "We open at"), (7, 2, "agent", "NINE."), (7, 3, "user", "bye")],
        "conv_id long, turn long, role string, message string",
    )
    tools = spark.createDataFrame([(7, "search_kb", "call", None, False)], "conv_id long, tool_name string, kind string, latency double, is_error boolean")
    rows = {r["case_id"]: r for r in evals.score_transcripts(cases, turns, tools).collect()}
    assert rows[1]["passed"] and rows[1]["similarity"] == 1.0 and rows[1]["tool_calls"] == 1
    assert rows[2]["errors"] == ["missing user turn"] and rows[2]["similarity"] is None


def calls(n=600, keys=3):
    rng = random.Random(9)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([1, 3, 20, 200])
        rows.append((i, rng.randrange(keys), at))
    return rows


def as_events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long")
    return df.select("event_id", "user_id", F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("ts"))


def brute_rate(rows, limit, window):
    kept, out = {}, {}
    for i, k, s in rows:
        live = [x for x in kept.get(k, []) if x > s - window]
        out[i] = len(live) < limit
        kept[k] = live + [s] if out[i] else live
    return out


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The calls as several files in time order, so a stream sees several batches."""
    folder = tmp_path_factory.mktemp("events")
    rows = calls()
    for part in range(4):
        as_events(spark, rows[part * 150 : (part + 1) * 150]).coalesce(1).write.parquet(f"{folder}/part{part}")
    return str(folder), rows


def stream_of(spark, folder):
    schema = spark.read.parquet(f"{folder}/part0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_rate_limit_batch_stream_and_brute_force_agree(spark, event_files):
    folder, rows = event_files
    expected = brute_rate(rows, 3, 60)
    batch = state.rate_limit(as_events(spark, rows), ["user_id"], limit=3, window_s=60)
    assert {r["event_id"]: r["accepted"] for r in batch.collect()} == expected
    stream = ingest.drain_to_files(state.stream_rate_limit(stream_of(spark, folder), "user_id", limit=3, window_s=60), "t1")
    assert {r["event_id"]: r["accepted"] for r in stream.collect()} == expected
    free = state.rate_limit(as_events(spark, rows), ["user_id"], limit=0, window_s=60)
    assert free.filter("NOT accepted").count() == 0


def test_answer_memo_batch_and_stream_agree(spark, event_files):
    folder, rows = event_files
    written, expected = {}, {}
    for i, k, s in rows:
        expected[i] = k in written and s - written[k] < 50
        if not expected[i]:
            written[k] = s
    batch = state.label_memo(as_events(spark, rows), ["user_id"], ttl_s=50)
    assert {r["event_id"]: r["memo_hit"] for r in batch.collect()} == expected
    stream = ingest.drain_to_files(state.stream_memo(stream_of(spark, folder), {"user_id": "long"}, ttl_s=50), "t3")
    assert {r["event_id"]: r["memo_hit"] for r in stream.collect()} == expected


EVENT = "job_id long, ts timestamp_ntz, event_id long, kind string, status string, key string, value string"


def test_job_state_stream_equals_the_fold(spark, tmp_path):
    """Events out of order within a file, an update ahead of its job, jobs created anew, and one never created."""
    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(240):
        kind = "create" if rng.random() < 0.1 else "update"
        job = rng.randrange(6)
        rows.append((job, start + timedelta(minutes=i + rng.randrange(-20, 20)), i, "update" if job == 5 else kind,
                     rng.choice(["queued", "running", "done"]), rng.choice("abc"), rng.choice(["1", "2", None])))
    for part in range(3):
        spark.createDataFrame(rows[part * 80: part * 80 + 80], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    jobs = ingest.drain_updates(state.stream_jobs(stream, "job_id", idle_s=86_400), ["job_id"], "jobs-test")
    as_rows = lambda frame: {r.job_id: (r.status, r.updated_at, r.fields) for r in frame.collect()}
    expected = as_rows(rollups.fold_jobs(spark.createDataFrame(rows, EVENT)))
    assert as_rows(jobs) == expected and sorted(expected) == [0, 1, 2, 3, 4]


def test_idle_jobs_are_forgotten(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(1, start, 0, "create", "queued", "a", "1"), (2, start + timedelta(days=3), 1, "create", "queued", "a", "1"),
            (2, start + timedelta(days=3, minutes=1), 2, "update", "running", "a", "2"),
            (1, start + timedelta(days=3, minutes=2), 3, "update", "done", "b", "2")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = ingest.drain_updates(state.stream_jobs(stream, "job_id", idle_s=3600), ["job_id"], "jobs-test").collect()
    # The second job's events move the clock on, so the update of the first meets an unknown job.
    assert {r.job_id: (r.status, r.fields) for r in found} == {1: ("queued", {"a": "1"}), 2: ("running", {"a": "2"})}
