"""Per-key state on event time: rate limiting, conversation memory and answer memo.

Each job exists twice over the same step function: a batch fold (in slices that carry their state, so a
busy key is spread over tasks) and a stream on ``transformWithStateInPandas``. Streams process the rows of
a micro-batch in event order; rows later than the watermark are dropped by the engine, rows that are
late but inside the watermark are judged when they arrive.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sagewell.functions import vocab
from sagewell.functions.text import contains_any
from sagewell.operators.dialogue import KEEP_TURNS, MEMORY_TTL, MemoryState, is_follow_up, memory_step
from sagewell.operators.slices import SLICE_ROWS, Fold, expiry_begins, fold_slices

MICROS = 1_000_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(column: str = "ts"):
    """Microseconds since 1970 of a time stamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


# --- steps -----------------------------------------------------------------------------------


def rate_step(accepted: deque, now: int, limit: int, window: int) -> bool:
    """Accept a call when fewer than ``limit`` accepted calls lie within the window before it."""
    if limit <= 0 or window <= 0:
        return True
    while accepted and accepted[0] <= now - window:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(now)
    return True


def memo_step(written: list, now: int, ttl: int) -> bool:
    """True when an unexpired answer exists; otherwise this call writes one. Reads do not extend it."""
    if ttl > 0 and written and now - written[0] < ttl:
        return True
    written[:] = [now]
    return False


# --- batch -----------------------------------------------------------------------------------


def rate_limit(
    calls: DataFrame, keys: list[str], *, limit: int, window_s: int, order: str = "event_id", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``calls`` (with ``ts`` and a unique ``order`` column) plus ``accepted``."""
    timed = calls.withColumn("at", micros())
    if limit <= 0 or window_s <= 0:
        return timed.drop("at").withColumn("accepted", F.lit(True))
    window = window_s * MICROS
    fold = Fold(deque, lambda state, row: (rate_step(state, row.at, limit, window),), list, deque)
    return fold_slices(timed, keys, ["at", order], fold, "accepted boolean", slice_rows=slice_rows).drop("at")


def label_memo(
    calls: DataFrame, keys: list[str], *, ttl_s: int, order: str = "event_id", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``calls`` plus ``memo_hit``: whether an earlier, unexpired answer of the same key exists."""
    ttl = ttl_s * MICROS
    timed = calls.withColumn("at", micros())
    if ttl <= 0:
        return timed.drop("at").withColumn("memo_hit", F.lit(False))
    fold = Fold(list, lambda state, row: (memo_step(state, row.at, ttl),), list, list)
    return fold_slices(
        timed, keys, ["at", order], fold, "memo_hit boolean", slice_rows=slice_rows,
        begins=lambda rows: expiry_begins(rows, keys, "at", ttl)).drop("at")


# --- streams ---------------------------------------------------------------------------------


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def set_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer for each key: the one before is taken away."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class RateLimiter(StatefulProcessor):
    """List state: times of the accepted calls still inside the window."""

    def __init__(self, limit: int, window: int, key_names: list[str]):
        self.limit, self.window, self.key_names = limit, window, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = deque(row[0] for row in self.accepted.get())
        calls = _rows(rows, ["at", "event_id"])
        verdicts = [rate_step(state, int(at), self.limit, self.window) for at in calls["at"]]
        if state:
            self.accepted.put([(at,) for at in state])
            set_timer(self.handle, (state[-1] + self.window) // 1000 + 1)
        yield pd.DataFrame(
            {**{n: k for n, k in zip(self.key_names, key)}, "event_id": calls["event_id"], "accepted": verdicts}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = [(row[0],) for row in self.accepted.get() if row[0] > now - self.window]
        if left:
            self.accepted.put(left)
        else:
            self.accepted.clear()
        return iter([])

    def close(self) -> None:
        pass


class AnswerMemo(StatefulProcessor):
    """Value state: when the live answer of a key was written."""

    def __init__(self, ttl: int, key_names: list[str]):
        self.ttl, self.key_names = ttl, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = [self.written.get()[0]] if self.written.exists() else []
        calls = _rows(rows, ["at", "event_id"])
        verdicts = [memo_step(state, int(at), self.ttl) for at in calls["at"]]
        self.written.update((state[0],))
        set_timer(self.handle, (state[0] + self.ttl) // 1000 + 1)
        yield pd.DataFrame(
            {**{n: k for n, k in zip(self.key_names, key)}, "event_id": calls["event_id"], "memo_hit": verdicts}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.written.exists() and now - self.written.get()[0] >= self.ttl:
            self.written.clear()
        return iter([])

    def close(self) -> None:
        pass


class ConversationMemory(StatefulProcessor):
    """List state: the last turns of a conversation as (seconds, rewritten query)."""

    def __init__(self, ttl: int, keep: int):
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "seconds double, query string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = MemoryState()
        state.turns.extend((row[0], row[1]) for row in self.turns.get())
        asked = _rows(rows, ["seconds", "request_no"])
        out = [
            memory_step(state, float(r.seconds), r.text, r.follows, r.anchored, self.ttl, self.keep)
            for r in asked.itertuples(index=False)
        ]
        self.turns.put([(float(s), q) for s, q in state.turns])
        set_timer(self.handle, int(state.turns[-1][0] + self.ttl) * 1000 + 1)
        result = pd.DataFrame(out, columns=["search_query", "rewrite_source", "remembered"])
        result.insert(0, "request_no", asked["request_no"])
        result.insert(0, "conversation_id", key[0])
        yield result

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        left = [(s, q) for s, q in ((row[0], row[1]) for row in self.turns.get()) if s > now - self.ttl]
        if left:
            self.turns.put(left)
        else:
            self.turns.clear()
        return iter([])

    def close(self) -> None:
        pass


class JobState(StatefulProcessor):
    """Map state: the latest value of each field of a job, and when the job was last created.

    Merging takes the later of two events, so the order of arrival inside the watermark does not matter. Fields of a job
    nobody created are held back until the job shows up or the state expires, which it does ``idle`` after the latest
    event; updates after that meet an unknown job and are ignored.
    """

    def __init__(self, idle: int, key_names: list[str]):
        self.idle, self.key_names = idle, key_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "at long, event_id long, value string, status string")
        self.created = handle.getValueState("created", "at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest: dict = {}
        created = tuple(self.created.get()) if self.created.exists() else None
        before = created
        for frame in rows:
            for row in frame.itertuples(index=False):
                at = (int(row.at), int(row.event_id))
                if row.key not in latest or at > latest[row.key][:2]:
                    latest[row.key] = (*at, row.value, row.status)
                if row.kind == "create" and (created is None or at > created):
                    created = at
        for field, found in latest.items():
            if not self.fields.containsKey((field,)) or found[:2] > tuple(self.fields.getValue((field,)))[:2]:
                self.fields.updateValue((field,), found)
        if created != before:
            self.created.update(created)
        held = {field[0]: tuple(value) for field, value in self.fields.iterator()}
        set_timer(self.handle, (max(value[0] for value in held.values()) + self.idle) // 1000 + 1)
        live = {field: value for field, value in held.items() if created and value[:2] >= created}
        if live:
            names = sorted(live)
            last = max(live.values(), key=lambda value: value[:2])
            yield pd.DataFrame({
                **{n: [k] for n, k in zip(self.key_names, key)}, "status": [last[3]], "updated": [last[0]],
                "names": [names], "held": [[live[n][2] for n in names]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fields.clear()
        self.created.clear()
        return iter([])

    def close(self) -> None:
        pass


def _ready(stream: DataFrame, delay: str) -> DataFrame:
    """Event time with zone (UTC) for the watermark, and microseconds for the steps."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream.withColumn("at", micros()).withColumn("event_time", F.timestamp_micros("at")).withWatermark(
        "event_time", delay
    )


def stream_rate_limit(calls: DataFrame, key: str, *, limit: int, window_s: int, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``rate_limit`` for one bigint key column."""
    return (
        _ready(calls, delay)
        .groupBy(key)
        .transformWithStateInPandas(
            RateLimiter(limit, window_s * MICROS, [key]),
            outputStructType=f"{key} long, event_id long, accepted boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_jobs(events: DataFrame, key: str, *, idle_s: int, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``rollups.fold_jobs`` (update mode): the current state of each job that an event changed."""
    return (
        _ready(events, delay)
        .groupBy(key)
        .transformWithStateInPandas(
            JobState(idle_s * MICROS, [key]),
            outputStructType=f"{key} long, status string, updated long, names array<string>, held array<string>",
            outputMode="Update",
            timeMode="EventTime",
        )
        .select(key, "status", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, updated / 1000000.0BD)").alias("updated_at"),
                F.map_from_arrays("names", "held").alias("fields"))
    )


def stream_memo(calls: DataFrame, keys: dict[str, str], *, ttl_s: int, delay: str = "1 hour") -> DataFrame:
    """Streaming twin of ``label_memo``; ``keys`` maps key columns to their types."""
    columns = ", ".join(f"{name} {kind}" for name, kind in keys.items())
    return (
        _ready(calls, delay)
        .groupBy(*keys)
        .transformWithStateInPandas(
            AnswerMemo(ttl_s * MICROS, list(keys)),
            outputStructType=f"{columns}, event_id long, memo_hit boolean",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_memory(
    requests: DataFrame, *, ttl: int = MEMORY_TTL, keep: int = KEEP_TURNS, delay: str = "1 hour"
) -> DataFrame:
    """Streaming twin of ``dialogue.rewrite_with_memory``; needs ``ts`` next to its columns."""
    flagged = requests.withColumn("follows", is_follow_up(F.col("text"))).withColumn(
        "anchored", contains_any(F.lower("text"), vocab.ANCHORS)
    )
    return (
        _ready(flagged, delay)
        .groupBy("conversation_id")
        .transformWithStateInPandas(
            ConversationMemory(ttl, keep),
            outputStructType="conversation_id long, request_no long, search_query string, rewrite_source string, remembered long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
