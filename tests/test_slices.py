import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest

from sagewell.operators import dialogue, slices
from sagewell.streaming import state

START = datetime(2026, 1, 1)
CALLS = "user_id long, kind string, event_id long, ts timestamp_ntz"


def busy(n, step, seed=1):
    """One key has nine tenths of the rows; steps of a few seconds, some calls at the same time."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += step(rng)
        key = (1, "a") if rng.random() < 0.9 else (rng.randrange(2, 6), rng.choice("ab"))
        rows.append((*key, i, START + timedelta(seconds=at)))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    found = {}
    for user, kind, event, ts in rows:
        found.setdefault((user, kind), []).append((int((ts - START).total_seconds()), event))
    return {key: sorted(items) for key, items in found.items()}


@pytest.mark.parametrize("step", [lambda r: r.choice([0, 1, 1, 2]), lambda r: r.choice([0, 1, 400]), lambda r: 1])
def test_memo_of_a_busy_key(spark, step):
    rows = busy(900, step)
    calls = spark.createDataFrame(rows, CALLS)
    cut = slices.sliced(calls.withColumn("at", state.micros()), ["user_id", "kind"], ["at", "event_id"], 60)
    assert cut.where("user_id = 1 AND kind = 'a'").select("_slice").distinct().count() >= 10
    found = {r.event_id: r.memo_hit for r in state.label_memo(calls, ["user_id", "kind"], ttl_s=50, slice_rows=60).collect()}
    expected = {}
    for items in by_key(rows).values():
        written: list = []
        expected |= {event: state.memo_step(written, at, 50) for at, event in items}
    assert found == expected and 0 < sum(found.values()) < 900


@pytest.mark.parametrize("rounds", [12, 1])
@pytest.mark.parametrize("step", [lambda r: r.choice([0, 1, 2]), lambda r: r.choice([0, 1, 1, 1, 90])])
def test_rate_limit_of_a_busy_key(spark, monkeypatch, step, rounds):
    # With one round of correction the busy key does not settle and takes the sequential way.
    monkeypatch.setattr(slices, "ROUNDS", rounds)
    rows = busy(700, step, 2)
    calls = spark.createDataFrame(rows, CALLS)
    found = {r.event_id: r.accepted for r in state.rate_limit(
        calls, ["user_id", "kind"], limit=3, window_s=20, slice_rows=90).collect()}
    expected = {}
    for items in by_key(rows).values():
        accepted: deque = deque()
        expected |= {event: state.rate_step(accepted, at, 3, 20) for at, event in items}
    assert found == expected and 0 < sum(found.values()) < 700


def test_memory_of_a_long_conversation(spark):
    rng = random.Random(3)
    texts = ["and what about prices?", "", "  ", "tell me about opening hours of the museum in the old town", "is it open?", "why?"]
    rows, at = [], 0
    for i in range(500):
        at += rng.choice([1, 5, 100])
        rows.append((1 if rng.random() < 0.9 else rng.randrange(2, 5), at, i, rng.choice(texts)))
    asked = spark.createDataFrame(rows, "conversation_id long, seconds long, request_no long, text string")
    one = dialogue.rewrite_with_memory(asked, ttl=300).collect()
    many = dialogue.rewrite_with_memory(asked, ttl=300, slice_rows=40).collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in many} and len(one) == 500
    assert sum(r.rewrite_source == "memory_heuristic" for r in many) > 50


def test_steps_compose_like_the_calls_they_stand_for():
    rng = np.random.default_rng(4)
    for ttl in (1, 7, 60):
        at = np.sort(rng.integers(0, 300, 80))
        whole = slices.Steps.of_calls(at, ttl)
        for cut in (1, 13, 40, 79):
            parts = slices.Steps.of_calls(at[:cut], ttl).then(slices.Steps.of_calls(at[cut:], ttl))
            for written in (-10 ** 9, *rng.integers(-100, 400, 20)):
                live = [written]
                for now in at:
                    state.memo_step(live, int(now), ttl)
                assert whole.after(np.array([written]))[0] == parts.after(np.array([written]))[0] == live[0]


def test_no_rows_and_one_slice(spark):
    none = spark.createDataFrame([], CALLS)
    assert state.label_memo(none, ["user_id"], ttl_s=5).count() == 0
    assert state.rate_limit(none, ["user_id"], limit=1, window_s=5).count() == 0
