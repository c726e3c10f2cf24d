"""Question and dialogue jobs over turn tables."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.functions.text import collapse, contains_any, first_rule, strip, words
from sagewell.operators.history import previous_rows
from sagewell.operators.slices import SLICE_ROWS, Fold, fold_slices

KEEP_TURNS = 4
MEMORY_TTL = 1800
MEMORY_CHARS = 1000
RETRY_CHARS = 500


# --- turn tables -----------------------------------------------------------------------------


def normalized_role(role: Column) -> Column:
    known = F.lower(strip(role))
    return F.when(known == "user", "user").when(known.isin("agent", "assistant", "ai"), "agent")


def without_repeats(turns: DataFrame) -> DataFrame:
    """Drop a turn equal to the one right before it (same role and text)."""
    seen = previous_rows(turns, ["conv_id"], "turn", F.struct("role", "text"), 1)
    last = F.get("previous", 0)
    same = F.coalesce((last["role"] == F.col("role")) & (last["text"] == F.col("text")), F.lit(False))
    return seen.filter(~same).drop("previous")


def thread_turns(turns: DataFrame) -> DataFrame:
    """One row per user turn with all agent replies up to the next user turn."""
    spoken = turns.withColumn("who", normalized_role(F.col("role"))).filter("who IS NOT NULL")
    seen = previous_rows(spoken, ["conv_id"], "turn", F.col("turn"), 1, qualify=F.col("who") == "user")
    owner = F.when(F.col("who") == "user", F.col("turn")).otherwise(F.get("previous", 0))
    replies = F.sort_array(F.collect_list(F.when(F.col("who") == "agent", F.struct("turn", "text"))))
    return (
        seen.withColumn("user_turn", owner)
        .filter("user_turn IS NOT NULL")
        .groupBy(F.col("conv_id").alias("thread_id"), F.col("user_turn").alias("turn"))
        .agg(
            F.max(F.when(F.col("who") == "user", F.col("text"))).alias("transcript"),
            strip(F.array_join(F.transform(replies, lambda r: r["text"]), "\n")).alias("answer"),
        )
    )


def with_history(threads: DataFrame, keep: int = KEEP_TURNS) -> DataFrame:
    """Add ``history``: the last ``keep`` earlier turns of the thread, oldest first."""
    return previous_rows(
        threads, ["thread_id"], "turn", F.struct("turn", "transcript", "answer"), keep, name="history"
    )


def latest_transcript(history: Column) -> Column:
    spoken = F.filter(F.transform(history, lambda h: strip(F.coalesce(h["transcript"], F.lit("")))), lambda x: x != "")
    return F.get(spoken, F.size(spoken) - 1)


def history_text(history: Column, turns: int = 3, answer_chars: int = 500) -> Column:
    """Last turns as labelled lines for a prompt."""
    keep = F.least(F.size(history), F.lit(turns))
    recent = F.slice(history, F.size(history) - keep + 1, keep)

    def lines(turn: Column, at: Column) -> Column:
        number = (at + 1).cast("string")
        asked = strip(F.coalesce(turn["transcript"], F.lit("")))
        told = strip(F.coalesce(turn["answer"], F.lit("")))
        return F.concat_ws(
            "\n",
            F.when(asked != "", F.concat(F.lit("Turn "), number, F.lit(" - user: "), asked)),
            F.when(told != "", F.concat(F.lit("Turn "), number, F.lit(" - assistant: "), F.substring(told, 1, answer_chars))),
        )

    text = F.array_join(F.filter(F.transform(recent, lines), lambda x: x != ""), "\n")
    return F.when(text == "", "No history.").otherwise(text)


# --- rules -----------------------------------------------------------------------------------


def _matched(text: Column, keywords) -> Column:
    flags = F.array(*[F.when(text.contains(k), F.lit(k)) for k in sorted(set(keywords))])
    return F.filter(flags, lambda k: k.isNotNull())


def is_greeting(lowered: Column) -> Column:
    bare = F.regexp_replace(lowered, "^[ !?.]+|[ !?.]+$", "")
    found = F.lit(False)
    for keyword in vocab.GREETINGS:
        found = found | (bare == keyword) | bare.startswith(keyword + " ")
    return found


def label_intent(turns: DataFrame, text: str = "text") -> DataFrame:
    """Intent, route, confidence and entities by rules, in the fixed order of the checks."""
    low = F.lower(text)
    greeting = is_greeting(low)
    outside = ~contains_any(low, vocab.ANCHORS) & contains_any(low, vocab.OUT_OF_SCOPE)
    urgent = contains_any(low, vocab.TIME_SENSITIVE)
    hinted = contains_any(low, vocab.CLASSIFIER_HINTS)
    primary = first_rule(low, vocab.INTENT_RULES, "general")
    checked = turns.withColumn(
        "primary_intent",
        F.when(greeting, "small_talk").when(outside, "out_of_scope").when(urgent | ~hinted, primary).otherwise("general"),
    )
    direct = F.col("primary_intent").isin("small_talk", "out_of_scope")
    undecided = ~direct & ~urgent & hinted
    return (
        checked.withColumn("is_time_sensitive", ~direct & urgent)
        .withColumn(
            "intent",
            F.when(direct, F.col("primary_intent")).when(F.col("is_time_sensitive"), "time_sensitive").otherwise("stable"),
        )
        .withColumn("route", F.when(direct, "direct_response").otherwise("knowledge"))
        .withColumn("confidence", F.when(undecided, 0.0).otherwise(1.0))
        .withColumn("source", F.when(undecided, "rules_fallback").otherwise("rules"))
        .withColumn(
            "entities",
            F.when(greeting, F.array(F.lit("greeting")))
            .when(outside, _matched(low, vocab.OUT_OF_SCOPE))
            .when(urgent, _matched(low, vocab.TIME_SENSITIVE))
            .otherwise(_matched(low, vocab.ENTITY_KEYWORDS)),
        )
    )


def is_follow_up(text: Column) -> Column:
    low = strip(F.lower(text))
    short_question = low.contains("?") & (F.size(words(low)) <= 8) & ~contains_any(low, vocab.ANCHORS)
    return contains_any(low, vocab.FOLLOW_UP_MARKERS) | short_question


def rewrite_followups(threads: DataFrame) -> DataFrame:
    """Prefix a follow-up with the latest earlier transcript of the last turns; ``history`` is given."""
    previous = latest_transcript(F.col("history"))
    joined = F.concat(previous, F.lit(vocab.CONNECTOR), F.col("transcript"))
    rewrite = (
        (F.size("history") > 0)
        & is_follow_up(F.col("transcript"))
        & previous.isNotNull()
        & ~contains_any(F.lower("transcript"), vocab.ANCHORS)
    )
    return threads.withColumn("search_query", F.when(rewrite, joined).otherwise(F.col("transcript"))).withColumn(
        "rewrite_source", F.when(rewrite, "heuristic").otherwise("original")
    )


class MemoryState:
    """Kept turns of a conversation: (seconds, search query), oldest first."""

    def __init__(self):
        self.turns: deque = deque()


def memory_step(state: MemoryState, now: float, text: str, follows: bool, anchored: bool, ttl: int, keep: int):
    """One request against the conversation memory: ``(search_query, rewrite_source, remembered)``."""
    while state.turns and state.turns[0][0] <= now - ttl:
        state.turns.popleft()
    query = text
    if follows and not anchored:
        earlier = next((t.strip() for _, t in reversed(state.turns) if t.strip()), None)
        if earlier:
            query = f"{earlier}{vocab.CONNECTOR}{text}".strip()[:MEMORY_CHARS]
    source = "memory_heuristic" if query != text else "original"
    remembered = len(state.turns)
    state.turns.append((now, query))
    while len(state.turns) > keep:
        state.turns.popleft()
    return query, source, remembered


def _remembered(kept: list) -> MemoryState:
    state = MemoryState()
    state.turns.extend((seconds, query) for seconds, query in kept)
    return state


def rewrite_with_memory(
    requests: DataFrame, *, ttl: int = MEMORY_TTL, keep: int = KEEP_TURNS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Chained rewriting: a follow-up extends the already rewritten query of the turn before.

    ``requests``: ``conversation_id, seconds, request_no, text``. A long conversation is folded in slices; a slice is
    folded again only if the turns remembered at its start were not what it assumed.
    """
    flagged = requests.withColumn("follows", is_follow_up(F.col("text"))).withColumn(
        "anchored", contains_any(F.lower("text"), vocab.ANCHORS)
    )
    fold = Fold(
        MemoryState,
        lambda state, row: memory_step(state, row.seconds, row.text, row.follows, row.anchored, ttl, keep),
        lambda state: [list(turn) for turn in state.turns],
        _remembered,
    )
    folded = fold_slices(
        flagged, ["conversation_id"], ["seconds", "request_no"], fold,
        "search_query string, rewrite_source string, remembered long", slice_rows=slice_rows)
    return folded.drop("follows", "anchored")


def expand_retry(df: DataFrame, *, brand: str = vocab.BRAND_PHRASE) -> DataFrame:
    """Wider second query: query, transcript, brand, entities and intent phrase, each once."""
    phrases = F.create_map(*[F.lit(x) for pair in sorted(vocab.RETRY_PHRASES.items()) for x in pair])
    phrase = F.coalesce(F.try_element_at(phrases, F.col("primary_intent")), F.lit(vocab.RETRY_DEFAULT))
    first = F.when(F.coalesce("search_query", F.lit("")) != "", F.col("search_query")).otherwise(F.col("transcript"))
    parts = F.concat(F.array(first, F.col("transcript"), F.lit(brand)), F.col("entities"), F.array(phrase))
    clean = F.filter(F.transform(parts, collapse), lambda p: p != "")
    lowered = F.transform(clean, F.lower)
    once = F.filter(clean, lambda p, at: F.array_position(lowered, F.lower(p)) == at + 1)
    return df.withColumn("retry_query", F.substring(F.array_join(once, " "), 1, RETRY_CHARS))


# --- stored payloads -------------------------------------------------------------------------

FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
INTENTS = [
    "ticket_price", "opening_hours", "animal_info", "show_schedule", "time_sensitive", "general", "small_talk",
    "out_of_scope",
]
ROUTES = ["knowledge", "direct_response", "direct_handoff"]
MODEL_OUTPUT = (
    "intent string, primary_intent string, is_time_sensitive boolean, entities array<string>, confidence double, "
    "suggested_route string, search_query string, _broken string"
)


def unfenced(raw: Column) -> Column:
    bare = strip(raw)
    return F.when(bare.startswith("```"), F.regexp_replace(bare, FENCE, "")).otherwise(bare)


def parse_model_outputs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Stored classifier outputs to decision columns.

    Accepts the current and the older JSON shape, with or without code fences. A row that is not
    valid (broken JSON, unknown value, confidence outside 0..1) has ``valid = false`` and nulls.
    """
    parsed = F.from_json(unfenced(F.col(raw)), MODEL_OUTPUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    p = df.withColumn("_p", parsed)
    older = F.col("_p.intent").isNotNull() & F.col("_p.primary_intent").isNull()
    primary = F.when(older, F.col("_p.intent")).otherwise(F.col("_p.primary_intent"))
    urgent = F.when(older, F.col("_p.intent") == "time_sensitive").otherwise(F.col("_p.is_time_sensitive"))
    route = F.when(
        older, F.when(primary.isin("small_talk", "out_of_scope"), "direct_response").otherwise("knowledge")
    ).otherwise(F.col("_p.suggested_route"))
    score = F.when(older, F.coalesce("_p.confidence", F.lit(0.0))).otherwise(F.col("_p.confidence"))
    valid = F.coalesce(
        F.col("_p._broken").isNull() & primary.isin(INTENTS) & route.isin(ROUTES) & score.between(0, 1) & urgent.isNotNull(),
        F.lit(False),
    )
    coerced = F.when(urgent & (route == "direct_handoff"), "knowledge").otherwise(route)
    entities = F.coalesce("_p.entities", F.array().cast("array<string>"))
    return p.select(
        *df.columns,
        valid.alias("valid"),
        F.when(valid, primary).alias("primary_intent"),
        F.when(valid, urgent).alias("is_time_sensitive"),
        F.when(valid, entities).alias("entities"),
        F.when(valid, score).alias("confidence"),
        F.when(valid, coerced).alias("route"),
    )


def parse_rewrites(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Stored rewrite outputs: the ``search_query`` of JSON, else the plain text."""
    bare = unfenced(F.col(raw))
    parsed = F.from_json(bare, MODEL_OUTPUT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    query = F.when(parsed["_broken"].isNotNull(), bare).otherwise(strip(F.coalesce(parsed["search_query"], F.lit(""))))
    return df.withColumn("search_query", query)


IDS = ["conversation_id", "turn_id", "request_id", "tool_call_id", "correlation_id"]
_FIELDS = "query string, site_id string, `limit` int, " + ", ".join(f"{i} string" for i in IDS)
PAYLOAD = f"{_FIELDS}, parameters struct<{_FIELDS.replace('`limit` int', '`limit`: int').replace(' string', ': string')}>"


def unwrap_payloads(df: DataFrame, payload: str = "payload", max_limit: int = 3) -> DataFrame:
    """Request payloads with or without a ``parameters`` wrapper to flat request columns."""
    p = df.withColumn("_p", F.from_json(payload, PAYLOAD))
    wrapped = F.col("_p.parameters").isNotNull()

    def pick(name: str) -> Column:
        inner, outer = F.col(f"_p.parameters.{name}"), F.col(f"_p.{name}")
        if name in IDS:
            return F.when(wrapped, F.coalesce(inner, F.nullif(outer, F.lit("")))).otherwise(outer)
        return F.when(wrapped, inner).otherwise(outer)

    flat = p.select(*df.columns, *[pick(n).alias(n) for n in ["query", "site_id", "limit", *IDS]])
    site = strip(F.col("site_id"))
    made = F.sha2(F.col(payload), 256)  # stands in for a random id, equal for equal payloads
    chain = [F.nullif(F.col(i), F.lit("")) for i in ("correlation_id", "request_id", "tool_call_id", "conversation_id")]
    return (
        flat.withColumn("site_id", F.when((site != "") & (F.lower(site) != "default"), site))
        .withColumn("correlation_id", F.coalesce(*chain, made))
        .withColumn(
            "turn_id",
            F.coalesce(
                F.nullif("turn_id", F.lit("")), F.nullif("tool_call_id", F.lit("")), F.nullif("request_id", F.lit("")),
                F.col("correlation_id"),
            ),
        )
        .withColumn("limit", F.least(F.coalesce("limit", F.lit(3)), F.lit(max_limit)))
    )
