"""Registered queries over conversations and questions: history, intents, rewriting, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.operators import answers as ans
from sagewell.operators import chunks as ch
from sagewell.operators import dialogue as ops
from sagewell.operators import pages as pg
from sagewell.operators import search as se
from sagewell.operators.rank import first_per, top_k
from sagewell.plans import dialogue_flow
from sagewell.plans import twins as t
from sagewell.plans.chunk_jobs import document_pieces
from sagewell.plans.page_jobs import TITLE_SQL, strip_sql
from sagewell.plans.registry import query
from sagewell.plans.retrieval_jobs import HOME, PROFILES, questions, search_sql, site_table, stored_chunks
from sagewell.session import materialized, scratch_folder
from sagewell.sources import sinks
from sagewell.sources.tables import spread, table


def talk(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns; every second user turn is put as a question."""
    asks = (F.col("role") == "user") & (F.col("turn") % 4 == 0)
    return table(spark, folder, "conversations").withColumn(
        "text", F.when(asks, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    )


TALK = """
talk AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 0 THEN text || '?' ELSE text END AS text FROM conversations),
spoken AS (SELECT *, CASE WHEN lower(role) = 'user' THEN 'user' WHEN lower(role) IN ('agent', 'assistant', 'ai') THEN 'agent' END AS who FROM talk),
owned AS (SELECT *, max(CASE WHEN who = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM spoken WHERE who IS NOT NULL),
threads AS (SELECT conv_id AS thread_id, user_turn AS turn, max(CASE WHEN who = 'user' THEN text END) AS transcript,
  """ + strip_sql("coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE who = 'agent'), '')") + """ AS answer
  FROM owned WHERE user_turn IS NOT NULL GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS n FROM threads),
earlier AS (SELECT a.thread_id, a.turn, b.turn AS old_turn, b.transcript, b.answer, a.n - b.n AS back
  FROM numbered a JOIN numbered b ON b.thread_id = a.thread_id AND b.n < a.n AND b.n >= a.n - 4)"""


def threads(spark, folder):
    return ops.thread_turns(talk(spark, folder))


@query("w7_agent_replies", f"WITH {TALK} SELECT thread_id, turn, transcript, answer FROM threads")
def w7(spark, folder):
    return threads(spark, folder)


@query(
    "w8_suppress_repeats",
    """WITH twice AS (SELECT conv_id, turn * 2 AS turn, role, text FROM conversations UNION ALL
         SELECT conv_id, turn * 2 + 1, role, CASE WHEN turn % 3 = 0 THEN text ELSE text || '.' END FROM conversations)
       SELECT conv_id, turn, role, text FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS x FROM twice WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       WHERE r IS DISTINCT FROM role OR x IS DISTINCT FROM text""",
)
def w8(spark, folder):
    """Every turn sent twice, some copies changed by a full stop."""
    turns = table(spark, folder, "conversations")
    copy = turns.withColumn(
        "text", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    ).withColumn("turn", F.col("turn") * 2 + 1)
    return ops.without_repeats(turns.withColumn("turn", F.col("turn") * 2).unionByName(copy)).select(
        "conv_id", "turn", "role", "text"
    )


_H = strip_sql("e.transcript")
_A = strip_sql("e.answer")


@query(
    "w4_history_context",
    f"""WITH {TALK}, recent AS (SELECT *, row_number() OVER (PARTITION BY thread_id, turn ORDER BY old_turn) AS i FROM earlier WHERE back <= 3),
        lines AS (SELECT e.thread_id, e.turn, e.i, concat_ws(chr(10),
            CASE WHEN {_H} <> '' THEN 'Turn ' || i || ' - user: ' || {_H} END,
            CASE WHEN {_A} <> '' THEN 'Turn ' || i || ' - assistant: ' || substring({_A}, 1, 500) END) AS line FROM recent e)
        SELECT n.thread_id, n.turn, count(l.i) AS turns, coalesce(nullif(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE l.line <> ''), ''), 'No history.') AS context
        FROM threads n LEFT JOIN lines l ON l.thread_id = n.thread_id AND l.turn = n.turn GROUP BY 1, 2""",
)
def w4(spark, folder):
    seen = ops.with_history(threads(spark, folder))
    return seen.select(
        "thread_id", "turn", F.least(F.size("history"), F.lit(3)).cast("long").alias("turns"),
        ops.history_text(F.col("history")).alias("context"),
    )


@query("w5_thread_order", f"WITH {TALK} SELECT thread_id, turn, transcript FROM threads ORDER BY thread_id, turn")
def w5(spark, folder):
    return threads(spark, folder).select("thread_id", "turn", "transcript").orderBy("thread_id", "turn")


@query(
    "w6_latest_transcript",
    f"""WITH {TALK} SELECT n.thread_id, n.turn, (SELECT max_by({_H}, e.old_turn) FROM earlier e WHERE e.thread_id = n.thread_id AND e.turn = n.turn
        AND {_H} <> '') AS previous FROM threads n""",
)
def w6(spark, folder):
    seen = ops.with_history(threads(spark, folder))
    return seen.select("thread_id", "turn", ops.latest_transcript(F.col("history")).alias("previous"))


@query("s11_turn_append", f"WITH {TALK} SELECT thread_id, 'default' AS site_id, turn, transcript, answer FROM threads")
def s11(spark, folder):
    """Finished turns appended to the thread table in two batches and read back."""
    path = scratch_folder(spark, "turns")
    done = threads(spark, folder).select("thread_id", F.lit("default").alias("site_id"), "turn", "transcript", "answer")
    early = F.col("turn") % 4 < 2
    sinks.append_turns(done.where(early), path)
    sinks.append_turns(done.where(~early), path)
    return spark.read.schema(done.schema).parquet(path).select(*done.columns)


@query(
    "e5_turn_extraction",
    f"""SELECT conv_id, turn - 1 AS at, CASE WHEN role = 'user' THEN 'user' ELSE 'agent' END AS role, {strip_sql('text')} AS message
        FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, text FROM conversations)
        WHERE role IN ('user', 'assistant')""",
)
def e5(spark, folder):
    """Transcripts stored as one JSON document per conversation, back to turn rows."""
    return dialogue_flow.extract_turns(dialogue_flow.transcripts(table(spark, folder, "conversations"))).select(
        "conv_id", F.col("at").cast("long"), "role", "message"
    )


# --- intents ---------------------------------------------------------------------------------


def intents_sql(source: str) -> str:
    """CTE ``decided`` over a relation (id, text)."""
    bare = "regexp_replace(low, '^[ !?.]+|[ !?.]+$', '', 'g')"
    greeting = " OR ".join(f"{bare} = {t.text(k)} OR starts_with({bare}, {t.text(k + ' ')})" for k in vocab.GREETINGS)

    def matched(keywords):
        parts = ", ".join(f"CASE WHEN contains(low, {t.text(k)}) THEN {t.text(k)} END" for k in sorted(set(keywords)))
        return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '|')"

    return f"""
flags AS (SELECT id, text, low, ({greeting}) AS greeting, (NOT {t.any_of('low', vocab.ANCHORS)} AND {t.any_of('low', vocab.OUT_OF_SCOPE)}) AS outside,
   {t.any_of('low', vocab.TIME_SENSITIVE)} AS urgent, {t.any_of('low', vocab.CLASSIFIER_HINTS)} AS hinted,
   {t.first_rule('low', vocab.INTENT_RULES, 'general')} AS ruled FROM (SELECT id, text, lower(text) AS low FROM {source})),
named AS (SELECT *, CASE WHEN greeting THEN 'small_talk' WHEN outside THEN 'out_of_scope' WHEN urgent OR NOT hinted THEN ruled ELSE 'general' END AS primary_intent,
   NOT greeting AND NOT outside AND urgent AS is_time_sensitive FROM flags),
decided AS (SELECT id, text, primary_intent, is_time_sensitive,
   CASE WHEN greeting OR outside THEN primary_intent WHEN is_time_sensitive THEN 'time_sensitive' ELSE 'stable' END AS intent,
   CASE WHEN greeting OR outside THEN 'direct_response' ELSE 'knowledge' END AS route,
   CASE WHEN NOT greeting AND NOT outside AND NOT urgent AND hinted THEN 0.0::DOUBLE ELSE 1.0 END AS sure,
   CASE WHEN greeting THEN 'greeting' WHEN outside THEN {matched(vocab.OUT_OF_SCOPE)} WHEN urgent THEN {matched(vocab.TIME_SENSITIVE)}
        ELSE {matched(vocab.ENTITY_KEYWORDS)} END AS entities FROM named)"""


_USER_TEXT = "(SELECT conv_id * 1000 + turn AS id, text FROM talk WHERE role = 'user')"


def user_turns(spark, folder):
    return spread(talk(spark, folder)).filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )


@query(
    "q1_intent",
    f"WITH {TALK}, {intents_sql(_USER_TEXT)} SELECT id, intent, primary_intent, is_time_sensitive, route, sure AS confidence FROM decided",
)
def q1(spark, folder):
    return ops.label_intent(user_turns(spark, folder)).select(
        "id", "intent", "primary_intent", "is_time_sensitive", "route", "confidence"
    )


@query("q2_entities", f"WITH {TALK}, {intents_sql(_USER_TEXT)} SELECT id, entities FROM decided")
def q2(spark, folder):
    return ops.label_intent(user_turns(spark, folder)).select("id", F.array_join("entities", "|").alias("entities"))


def follow_sql(text: str) -> str:
    low = strip_sql(f"lower({text})")
    count = f"len(list_filter(string_split({t.collapse(low)}, ' '), lambda w: w <> ''))"
    return (
        f"({t.any_of(low, vocab.FOLLOW_UP_MARKERS)} OR (contains({low}, '?') AND {count} <= 8 AND NOT {t.any_of(low, vocab.ANCHORS)}))"
    )


@query("q3_follow_up", f"WITH {TALK} SELECT id, {follow_sql('text')} AS follows FROM {_USER_TEXT}")
def q3(spark, folder):
    return user_turns(spark, folder).select("id", ops.is_follow_up(F.col("text")).alias("follows"))


@query(
    "q4_rewrite",
    f"""WITH {TALK}, p AS (SELECT n.thread_id, n.turn, n.transcript, (SELECT max_by({_H}, e.old_turn) FROM earlier e WHERE e.thread_id = n.thread_id AND e.turn = n.turn
        AND {_H} <> '') AS previous FROM threads n)
        SELECT thread_id, turn, CASE WHEN go THEN previous || {t.text(vocab.CONNECTOR)} || transcript ELSE transcript END AS search_query,
          CASE WHEN go THEN 'heuristic' ELSE 'original' END AS rewrite_source
        FROM (SELECT *, previous IS NOT NULL AND {follow_sql('transcript')} AND NOT {t.any_of('lower(transcript)', vocab.ANCHORS)} AS go FROM p)""",
)
def q4(spark, folder):
    return ops.rewrite_followups(ops.with_history(threads(spark, folder))).select(
        "thread_id", "turn", "search_query", "rewrite_source"
    )


_RETRY_PHRASE = "CASE primary_intent " + " ".join(
    f"WHEN {t.text(k)} THEN {t.text(v)}" for k, v in sorted(vocab.RETRY_PHRASES.items())
) + f" ELSE {t.text(vocab.RETRY_DEFAULT)} END"


def retry_sql(name: str, source: str) -> str:
    """CTE ``name`` with ``retry_query`` over (id, text, entities, primary_intent)."""
    parts = f"list_concat([text, text, {t.text(vocab.BRAND_PHRASE)}], list_concat(CASE WHEN entities = '' THEN [] ELSE string_split(entities, '|') END, [{_RETRY_PHRASE}]))"
    flat = t.collapse("x")
    return f"""
{name} AS (SELECT *, substring(array_to_string(list_filter(parts, lambda x, i: list_position(lows, lower(x)) = i), ' '), 1, 500) AS retry_query
  FROM (SELECT *, list_transform(parts, lambda x: lower(x)) AS lows FROM
    (SELECT *, list_filter(list_transform({parts}, lambda x: {flat}), lambda x: x <> '') AS parts FROM {source})))"""


@query(
    "q6_retry_query",
    f"WITH {TALK}, {intents_sql(_USER_TEXT)}, {retry_sql('retries', 'decided')} SELECT id, retry_query FROM retries",
)
def q6(spark, folder):
    labelled = ops.label_intent(user_turns(spark, folder))
    ready = labelled.withColumn("search_query", F.col("text")).withColumn("transcript", F.col("text"))
    return ops.expand_retry(ready).select("id", "retry_query")


# --- stored payloads -------------------------------------------------------------------------


@query(
    "q14_model_outputs",
    f"""WITH {TALK}, {intents_sql(_USER_TEXT)}
        SELECT id, id % 5 <> 3 AS valid, CASE WHEN id % 5 <> 3 THEN CASE WHEN id % 5 = 2 AND is_time_sensitive THEN 'time_sensitive' ELSE primary_intent END END AS primary_intent,
          CASE WHEN id % 5 <> 3 THEN is_time_sensitive END AS is_time_sensitive, CASE WHEN id % 5 <> 3 THEN sure END AS confidence,
          CASE WHEN id % 5 = 3 THEN NULL WHEN id % 5 = 4 AND is_time_sensitive THEN 'knowledge' WHEN id % 5 = 4 THEN 'direct_handoff' ELSE route END AS route
        FROM decided""",
)
def q14(spark, folder):
    """Decisions written as the JSON a model returns: plain, fenced, older shape, broken, handed over."""
    d = ops.label_intent(user_turns(spark, folder))
    kind = F.col("id") % 5
    sent_route = F.when(kind == 4, "direct_handoff").otherwise(F.col("route"))
    now = F.to_json(F.struct("primary_intent", "is_time_sensitive", "entities", "confidence", sent_route.alias("suggested_route")))
    older_name = F.when(F.col("is_time_sensitive"), "time_sensitive").otherwise(F.col("primary_intent"))
    older = F.to_json(F.struct(older_name.alias("intent"), "entities", "confidence"))
    raw = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), now, F.lit("\n```")))
        .when(kind == 2, older)
        .when(kind == 3, F.concat(F.lit("Sorry: "), now))
        .otherwise(now)
    )
    return ops.parse_model_outputs(d.select("id", raw.alias("raw"))).select(
        "id", "valid", "primary_intent", "is_time_sensitive", "confidence", "route"
    )


@query(
    "q16_payloads",
    """SELECT conv_id, turn, text AS query, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'site-' || conv_id % 7 END AS site_id,
       CAST(CASE WHEN turn % 2 = 0 THEN 3 ELSE least(3, 1 + turn % 5) END AS BIGINT) AS "limit",
       CASE WHEN turn % 2 = 0 THEN 'c' || conv_id ELSE 'r' || turn END AS correlation_id,
       CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE 'r' || turn END AS turn_id FROM conversations""",
)
def q16(spark, folder):
    """Turns sent as tool payloads: wrapped ones carry the ids outside ``parameters``."""
    turns = table(spark, folder, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    site = F.when(turn % 3 == 0, "Default").when(turn % 3 == 1, F.concat(F.lit("site-"), (conv % 7).cast("string")))
    wrapped = F.to_json(
        F.struct(
            F.concat(F.lit("c"), conv.cast("string")).alias("conversation_id"),
            F.concat(F.lit("t"), turn.cast("string")).alias("turn_id"),
            F.struct(F.col("text").alias("query"), site.alias("site_id")).alias("parameters"),
        )
    )
    flat = F.to_json(
        F.struct(
            F.col("text").alias("query"), site.alias("site_id"), (1 + turn % 5).alias("limit"),
            F.concat(F.lit("r"), turn.cast("string")).alias("request_id"),
        )
    )
    sent = turns.select("conv_id", "turn", F.when(turn % 2 == 0, wrapped).otherwise(flat).alias("payload"))
    return ops.unwrap_payloads(sent).select(
        "conv_id", "turn", "query", "site_id", F.col("limit").cast("long"), "correlation_id", "turn_id"
    )


# --- hit texts -------------------------------------------------------------------------------


@query(
    "p28_described_content",
    """SELECT doc_id, CASE WHEN contains(text, lang) THEN 'Page description: From ' || source || chr(10) || chr(10) || text
         ELSE 'Page description: ' || lang || chr(10) || chr(10) || text END AS content FROM documents""",
)
def p28(spark, folder):
    docs = table(spark, folder, "documents")
    described = ans.described_content(F.col("text"), F.array("lang", F.concat(F.lit("From "), F.col("source"))))
    return docs.select("doc_id", described.alias("content"))


_bad = t.any_of("lower(section)", vocab.BAD_LABEL_FRAGMENTS + ["redirecturi"])


def _label_sql(expr: str) -> str:
    parts = f"list_transform(string_split({expr}, '|'), lambda x: {strip_sql('x')})"
    return f"array_to_string(list_filter({parts}, lambda x: x <> ''), ' - ')"


@query(
    "p29_citation_label",
    f"""WITH s AS (SELECT page_id, url, {TITLE_SQL} AS title FROM pages),
        l AS (SELECT page_id, url, title, {strip_sql("CASE page_id % 3 WHEN 0 THEN title || ' | Part ' || page_id WHEN 1 THEN url ELSE '' END")} AS section FROM s)
        SELECT page_id, CASE WHEN length(section) >= 12 AND NOT (substring(section, 1, 1) = lower(substring(section, 1, 1)) AND substring(section, 1, 1) <> upper(substring(section, 1, 1)))
          AND NOT contains(section, '=') AND NOT contains(section, '&') AND NOT {_bad} THEN {_label_sql('section')}
          WHEN {strip_sql('title')} <> '' THEN {_label_sql(strip_sql('title'))} ELSE url END AS label FROM l""",
)
def p29(spark, folder):
    titled = spread(table(spark, folder, "pages")).select("page_id", "url", pg.html_title(F.col("html")).alias("title"))
    section = (
        F.when(F.col("page_id") % 3 == 0, F.concat("title", F.lit(" | Part "), F.col("page_id").cast("string")))
        .when(F.col("page_id") % 3 == 1, F.col("url"))
        .otherwise("")
    )
    return titled.select("page_id", ans.citation_label(section, F.col("title"), F.col("url")).alias("label"))


_noisy = t.any_of("lower(line)", ans.NOISY)
_noisy_lines = ", ".join(t.text(x) for x in ans.NOISY_LINES)


@query(
    "p30_context_noise",
    f"""WITH l AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS pos FROM (
          SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(10) || 'EN' || chr(10)), {t.text(pg.LINE_BREAK)}) AS a FROM documents)),
        k AS (SELECT doc_id, pos, line FROM (SELECT doc_id, pos, {strip_sql('raw')} AS line FROM l) WHERE line <> '' AND lower(line) NOT IN ({_noisy_lines}) AND NOT {_noisy})
        SELECT d.doc_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '') AS content FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def p30(spark, folder):
    """Documents with a language switch line after every sentence; those lines go away again."""
    noisy = F.replace(F.col("text"), F.lit(". "), F.lit(".\nEN\n"))
    return spread(table(spark, folder, "documents")).select("doc_id", ans.clean_content(noisy).alias("content"))


# --- gates and answers over the search hits --------------------------------------------------

AS_OF_SQL = "TIMESTAMP '2026-01-20'"
THRESHOLD = 1.5


def as_of():
    return F.expr("TIMESTAMP_NTZ'2026-01-20 00:00:00'")


def decided_questions(spark, folder):
    return ops.label_intent(questions(spark, folder)).drop("confidence").withColumn("transcript", F.col("text"))


def searcher(spark, folder):
    """A search function over one stored chunk table."""
    chunks, sites = stored_chunks(spark, folder), site_table(spark, folder)
    return lambda asked: se.hybrid_search(asked, chunks, sites, profiles=PROFILES, home=HOME)


def hits_of(spark, folder):
    return searcher(spark, folder)(questions(spark, folder))


def in_context(spark, folder):
    return ans.with_context(decided_questions(spark, folder), hits_of(spark, folder))


GATES = f"""
, {intents_sql('q')},
full_hits AS (SELECT h.qid, h.rank, h.score, k.* EXCLUDE (id, text, category, source_url), h.category, h.source_url FROM hits h JOIN kc k ON k.id = h.cid),
best AS (SELECT d.*, coalesce(b.confidence, 0) AS confidence, coalesce(b.fresh, FALSE) AS fresh, coalesce(b.n, 0) AS n_hits FROM decided d LEFT JOIN (
   SELECT qid, max(score) AS confidence, count(*) AS n, bool_or(category IN ('offer', 'price', 'booking', 'membership') AND coalesce(valid_until > {AS_OF_SQL}, FALSE)) AS fresh FROM full_hits GROUP BY qid) b ON b.qid = d.id),
gated AS (SELECT *, CASE WHEN confidence < {THRESHOLD} THEN 'low_confidence' WHEN intent = 'time_sensitive' AND NOT fresh THEN 'stale_or_missing_time_sensitive_data' END AS reason FROM best)"""
_actions = " ".join(f"WHEN {t.text(k)} THEN {t.text(v)}" for k, v in sorted(vocab.ACTIONS.items()))


@query(
    "q8_freshness_gate",
    search_sql("SELECT id AS query_id, confidence, reason AS handoff_reason, reason IS NOT NULL AS handoff_required FROM gated", after=GATES),
)
def q8(spark, folder):
    return ans.freshness_gate(in_context(spark, folder), as_of(), THRESHOLD).select(
        "query_id", "confidence", "handoff_reason", "handoff_required"
    )


@query(
    "q9_route",
    search_sql(
        f"""SELECT id AS query_id, CASE WHEN route = 'knowledge' AND intent <> 'time_sensitive' AND coalesce(reason, '') = 'low_confidence' THEN 'retry'
            WHEN reason IS NOT NULL THEN 'escalate' ELSE 'answer' END AS next_step, CASE reason {_actions} END AS recommended_action FROM gated""",
        after=GATES,
    ),
)
def q9(spark, folder):
    gated = ans.freshness_gate(in_context(spark, folder), as_of(), THRESHOLD).withColumn("retries", F.lit(0))
    return ans.route(gated, THRESHOLD).select("query_id", "next_step", "recommended_action")


def _line_clean(expr: str) -> str:
    s = strip_sql(expr)
    return f"CASE WHEN lower({s}) IN ({_noisy_lines}) OR {t.any_of(f'lower({s})', ans.NOISY)} THEN '' ELSE {s} END"


def _group_sql(name: str, labels: dict, items: int, chars: int) -> str:
    label = "CASE category " + " ".join(f"WHEN {t.text(k)} THEN {t.text(v)}" for k, v in labels.items()) + " END"
    cats = ", ".join(t.text(k) for k in labels)
    return f"""
{name} AS (SELECT qid, string_agg({label} || ': ' || {strip_sql('substring(clean, 1, ' + str(chars) + ')')}, ' ' ORDER BY rank) AS body FROM (
   SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM (
     SELECT *, row_number() OVER (PARTITION BY qid, category, section ORDER BY rank) AS rn FROM cleaned WHERE category IN ({cats})) WHERE rn = 1)
   WHERE i <= {items} GROUP BY qid)"""


_C = {k: t.text(v) for k, v in ans.CANNED.items()}
EXTRACTED = GATES + f""",
cleaned AS (SELECT *, {_line_clean('content')} AS clean FROM full_hits),
{_group_sql('products', ans.PRODUCT_LABELS, 4, 260)},
{_group_sql('offers', ans.OFFER_LABELS, 3, 360)},
extracted AS (SELECT d.*, CASE WHEN top.qid IS NULL THEN {_C['none']}
   WHEN {t.any_of('lower(d.text)', ans.PRODUCT_TRIGGER)} AND p.body IS NOT NULL THEN {_C['product_lead']} || p.body
   WHEN {t.any_of('lower(d.text)', ans.OFFER_TRIGGER)} AND o.body IS NOT NULL THEN {_C['offer_lead']} || o.body || {_C['offer_tail']}
   WHEN top.category = 'schedule' THEN {_C['schedule']} WHEN top.category = 'contact' THEN {_C['contact']} ELSE top.clean END AS answer
   FROM gated d LEFT JOIN cleaned top ON top.qid = d.id AND top.rank = 1 LEFT JOIN products p ON p.qid = d.id LEFT JOIN offers o ON o.qid = d.id)"""


@query("q12_extract_answers", search_sql("SELECT id AS query_id, answer FROM extracted", after=EXTRACTED))
def q12(spark, folder):
    return ans.extract_answers(in_context(spark, folder)).select("query_id", "answer")


@query(
    "w10_first_per_section",
    search_sql(
        """SELECT qid AS query_id, rank, category, section FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM (
           SELECT *, row_number() OVER (PARTITION BY qid, category, section ORDER BY rank) AS rn FROM full_hits) WHERE rn = 1) WHERE i <= 3""",
        after=GATES,
    ),
)
def w10(spark, folder):
    once = first_per(hits_of(spark, folder), ["query_id", "category", "section"], [F.asc("rank")])
    return top_k(once, ["query_id"], [F.asc("rank")], 3, "i").select(
        "query_id", F.col("rank").cast("long"), "category", "section"
    )


@query(
    "q13_escalation",
    search_sql(
        f"""SELECT d.id AS query_id, coalesce((SELECT min_by({strip_sql('content')}, rank) FROM full_hits h WHERE h.qid = d.id
              AND category NOT IN ('offer', 'price', 'booking', 'membership', 'contact') AND content <> ''),
            CASE WHEN n_hits > 0 THEN {_C['volatile']} ELSE {_C['missing']} END) || {_C['escalation']} AS answer FROM gated d""",
        after=GATES,
    ),
)
def q13(spark, folder):
    answer = ans.escalation_answer(F.col("context"))
    return in_context(spark, folder).select("query_id", answer.alias("answer"))


# --- grounding -------------------------------------------------------------------------------


def _offer(number, price):
    return F.concat(
        F.lit(" Open 9:00 to 18:30 until "), (1 + number % 28).cast("string"), F.lit("/5/2026. Costs "), price.cast("string"),
        F.lit(".000 VND"),
    )


def answered_documents(spark, folder):
    """Documents as answers with an offer sentence; a third of their sources state another price."""
    number = F.col("doc_id")
    answers = spread(table(spark, folder, "documents")).select(
        number.alias("answer_id"), F.concat("text", _offer(number, 1 + number % 900)).alias("answer")
    )
    shift = F.when(number % 3 == 0, 1).otherwise(0)
    stated = table(spark, folder, "documents").select(
        number.alias("answer_id"), _offer(number, 1 + number % 900 + shift).alias("content")
    )
    pieces = document_pieces(spark, folder).select(number.alias("answer_id"), "content")
    return answers, pieces.unionByName(stated)


_W = r"[\pL\pN_]+"


def claims_sql(expr: str) -> str:
    """Distinct claims; word edges are marked first because RE2 knows only ASCII word edges."""
    marked = f"regexp_replace({expr}, '({_W})', '‹\\1›', 'g')"
    patterns = [
        r"‹\d{1,2}›:‹\d{2}›",
        r"‹\d{1,2}›/‹\d{1,2}(?:›/‹\d{2,4})?›",
        r"(?i)‹\d{1,3}(?:›[.,]‹\d{3})+(?:›\s‹(?:VNĐ|VND|đ|đồng)|(?:VNĐ|VND|đ|đồng))?›",
        r"‹\d{1,3}›\s?%‹",
    ]
    found = " || ".join(f"regexp_extract_all({marked}, {t.text(p)})" for p in patterns)
    plain = r"regexp_replace(replace(replace(lower(regexp_replace(c, '[‹›]', '', 'g')), 'vnđ', 'vnd'), 'đồng', 'vnd'), '\s+', '', 'g')"
    return f"list_distinct(list_transform({found}, lambda c: {plain}))"


def _offer_sql(price: str) -> str:
    return f"' Open 9:00 to 18:30 until ' || (1 + doc_id % 28) || '/5/2026. Costs ' || ({price}) || '.000 VND'"


@query(
    "q10_grounding",
    t.with_pieces(
        f""", asked AS (SELECT doc_id AS id, unnest({claims_sql("text || " + _offer_sql('1 + doc_id % 900'))}) AS c FROM documents),
        told AS (SELECT DISTINCT id, c FROM (
          SELECT doc_id AS id, unnest({claims_sql('content')}) AS c FROM pieces UNION ALL
          SELECT doc_id, unnest({claims_sql(_offer_sql('1 + doc_id % 900 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END'))}) FROM documents)),
        missing AS (SELECT a.id, count(*) AS n FROM asked a WHERE NOT EXISTS (SELECT 1 FROM told k WHERE k.id = a.id AND k.c = a.c) GROUP BY a.id)
        SELECT d.doc_id AS answer_id, coalesce(m.n, 0) AS unsupported, coalesce(m.n, 0) = 0 AS grounded FROM documents d LEFT JOIN missing m ON m.id = d.doc_id"""
    ),
)
def q10(spark, folder):
    answers, context = answered_documents(spark, folder)
    return ans.check_grounding(answers, context).select("answer_id", "unsupported", "grounded")


_stop = ", ".join(t.text(w) for w in vocab.STOPWORDS)


def tokens_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({expr}), '[\\pL\\pN_À-ỹ]+'), lambda w: length(w) >= 3 AND w NOT IN ({_stop})))"


_item = "title || ' ' || section || ' ' || content || ' ' || source_url"
SUPPORT = EXTRACTED + f""",
pairs2 AS (SELECT e.id, e.answer, h.*, {claims_sql('e.answer')} AS cl, len(list_intersect({claims_sql('e.answer')}, {claims_sql('h.content')})) AS co,
   len(list_intersect({tokens_sql('e.answer')}, {tokens_sql('h.' + _item.replace("|| ' ' || ", "|| ' ' || h."))})) AS tk
   FROM extracted e JOIN full_hits h ON h.qid = e.id),
judged AS (SELECT *, NOT ((len(cl) > 0 AND co = 0) OR (category IN ('offer', 'price', 'booking', 'membership') AND NOT {t.any_of('lower(answer)', ans.PRICE_WORDS)} AND co = 0)
   OR (len(cl) = 0 AND tk < 2)) AS ok FROM pairs2),
supported AS (SELECT *, round(CASE WHEN ok THEN co * 2.0::DOUBLE + tk * 0.1::DOUBLE + greatest(0, score) * 0.05 ELSE score END, 6) AS support FROM (
   SELECT *, bool_or(ok) OVER (PARTITION BY id) AS any_ok FROM judged) WHERE ok OR (NOT any_ok AND rank <= 3)),
by_url AS (SELECT *, row_number() OVER (PARTITION BY id, source_url ORDER BY support DESC, rank) AS rn FROM supported),
cited AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY support DESC, rank) AS citation_no FROM by_url WHERE rn = 1)"""


def _cited(spark, folder):
    hits = materialized(hits_of(spark, folder), "hits")
    answered = ans.extract_answers(ans.with_context(decided_questions(spark, folder), hits)).select(
        F.col("query_id").alias("answer_id"), "answer"
    )
    return ans.support_citations(answered.join(hits.withColumnRenamed("query_id", "answer_id"), "answer_id"), 3)


@query(
    "q11_citations",
    search_sql("SELECT id AS answer_id, citation_no, source_url, support FROM cited WHERE citation_no <= 3", after=SUPPORT),
)
def q11(spark, folder):
    return _cited(spark, folder).select("answer_id", F.col("citation_no").cast("long"), "source_url", "support")


@query(
    "w9_first_per_url",
    search_sql(
        """SELECT qid AS query_id, source_url, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_url ORDER BY score DESC, rank) AS rn FROM full_hits) WHERE rn = 1""",
        after=GATES,
    ),
)
def w9(spark, folder):
    once = first_per(hits_of(spark, folder), ["query_id", "source_url"], [F.desc("score"), F.asc("rank")])
    return once.select("query_id", "source_url", F.col("rank").cast("long"))


@query(
    "a7_claim_and_token_sets",
    f"SELECT doc_id, len({claims_sql('text')}) AS claims, len({tokens_sql('text')}) AS tokens FROM documents",
)
def a7(spark, folder):
    return spread(table(spark, folder, "documents")).select(
        "doc_id",
        F.size(ans.claims(F.col("text"))).cast("long").alias("claims"),
        F.size(ans.meaningful_tokens(F.col("text"))).cast("long").alias("tokens"),
    )


@query(
    "o8_set_operations",
    f"""WITH {TALK}, k AS (SELECT thread_id, turn, {tokens_sql('transcript')} AS a, {tokens_sql('answer')} AS b FROM threads)
        SELECT thread_id, turn, len(list_intersect(a, b)) AS shared, len(a) - len(list_intersect(a, b)) AS only_asked,
          len(a) = len(list_intersect(a, b)) AS contained FROM k""",
)
def o8(spark, folder):
    a, b = ans.meaningful_tokens(F.col("transcript")), ans.meaningful_tokens(F.col("answer"))
    return threads(spark, folder).select(
        "thread_id", "turn",
        F.size(F.array_intersect(a, b)).cast("long").alias("shared"),
        F.size(F.array_except(a, b)).cast("long").alias("only_asked"),
        (F.size(F.array_except(a, b)) == 0).alias("contained"),
    )


# --- whole flows -----------------------------------------------------------------------------

_first_pass = search_sql(
    f"""SELECT id, CASE WHEN route = 'knowledge' AND intent <> 'time_sensitive' AND coalesce(reason, '') = 'low_confidence' THEN retry_query ELSE text END AS text FROM retried""",
    after=GATES + ", " + retry_sql("retried", "gated"),
)


@query(
    "q7_two_pass",
    search_sql(
        "SELECT qid AS query_id, rank, cid AS chunk_id, score FROM hits",
        source="final_q",
        before=f", final_q AS MATERIALIZED (SELECT * FROM ({_first_pass}))",
    ),
)
def q7(spark, folder):
    """Low-confidence questions are searched once more with a wider query; the second hits replace the first."""
    hits = dialogue_flow.two_pass(
        decided_questions(spark, folder), searcher(spark, folder), as_of(), THRESHOLD
    )
    return hits.select("query_id", F.col("rank").cast("long"), "chunk_id", "score")


@query("q17_dialogue_batch")
def q17(spark, folder):
    """Every user turn through intent, rewriting, search, gate, retry, answer, grounding and citations."""
    turns = threads(spark, folder)
    return dialogue_flow.dialogue_batch(turns, searcher(spark, folder), as_of(), THRESHOLD)
