"""Registered queries: evaluation reports, crawl summaries and the link frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagewell.functions import urls as u
from sagewell.functions import vocab
from sagewell.functions.text import normalized
from sagewell.operators import dialogue as dl
from sagewell.operators import evals as ops
from sagewell.operators import frontier, rollups
from sagewell.operators import pages as pg
from sagewell.operators import search as se
from sagewell.operators.scan import scan_topk
from sagewell.plans import dialogue_flow
from sagewell.plans import twins as t
from sagewell.plans.dialogue_jobs import SUPPORT, TALK, _cited, hits_of, intents_sql, talk
from sagewell.plans.page_jobs import (
    LINKS, PAGE_URLS, POLICY, SEED, _rank, category_sql, raw_pages, reason_sql, strip_sql,
)
from sagewell.plans.registry import query
from sagewell.plans.retrieval_jobs import HOME, PROFILES, keyed_chunks, questions, search_sql, site_table, stored_chunks
from sagewell.plans.state_jobs import memory_sql, requests
from sagewell.session import materialized, scratch_folder
from sagewell.sources import crawl, sinks
from sagewell.sources.tables import spread, table

# --- cases over the labels -------------------------------------------------------------------


def case_table(spark, folder):
    """Labels as golden cases: the expected outcome of each labelled document."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "time_sensitive").otherwise("stable").alias("expected_intent"),
        (F.col("quality") == 0).alias("expected_handoff"),
        F.array(F.lit("TION"), F.lit("en")).alias("required_substrings"),
        (F.col("toxic") == 0).alias("requires_citations"),
    )


def result_table(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return dl.label_intent(docs).select(
        F.col("doc_id").alias("id"), "intent", (F.col("n_chars") < 500).alias("handoff_required"),
        F.col("text").alias("answer"), (F.col("n_chars") % 4).alias("citation_count"),
        F.col("lang").alias("graph_version"), (F.col("n_chars") / 1000.0).alias("latency"),
    )


_DOCS = "(SELECT doc_id AS id, text FROM documents)"
SCORED_SQL = f"""{intents_sql(_DOCS)},
scored AS (SELECT l.doc_id AS id, d.lang AS graph_version, d.n_chars / 1000.0::DOUBLE AS latency, list_filter([
   CASE WHEN i.intent <> (CASE WHEN l.toxic = 1 THEN 'time_sensitive' ELSE 'stable' END) THEN 'intent=''' || i.intent || '''' END,
   CASE WHEN (d.n_chars < 500) <> (l.quality = 0) THEN 'handoff_required=' || CASE WHEN d.n_chars < 500 THEN 'True' ELSE 'False' END END,
   CASE WHEN NOT contains(lower(d.text), 'tion') THEN 'missing substring=''TION''' END,
   CASE WHEN NOT contains(lower(d.text), 'en') THEN 'missing substring=''en''' END,
   CASE WHEN l.toxic = 0 AND d.n_chars % 4 = 0 THEN 'missing citations' END], lambda x: x IS NOT NULL) AS errors
   FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN decided i ON i.id = l.doc_id)"""


@query("e1_case_scoring", f"WITH {SCORED_SQL} SELECT id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS passed FROM scored")
def e1(spark, folder):
    return ops.score_cases(case_table(spark, folder), result_table(spark, folder)).select(
        "id", F.array_join("errors", "; ").alias("errors"), "passed"
    )


@query("j6_case_results", f"WITH {SCORED_SQL} SELECT id, graph_version FROM scored")
def j6(spark, folder):
    results = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("graph_version"))
    return case_table(spark, folder).join(results, "id").select("id", "graph_version")


_REPORT = """SELECT graph_version, count(*) AS cases, count(*) FILTER (len(errors) = 0) AS passed_cases, avg(CASE WHEN len(errors) = 0 THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate,
  round(avg(latency), 6) AS mean_latency, list_sort(list(latency))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT)] AS p95, bool_and(len(errors) = 0) AS passed
  FROM scored GROUP BY graph_version"""


@query("e2_run_report", f"WITH {SCORED_SQL} {_REPORT}")
def e2(spark, folder):
    scores = ops.score_cases(case_table(spark, folder), result_table(spark, folder))
    report = ops.run_report(scores, ["graph_version"], "latency")
    return report.withColumn("mean_latency", F.round("mean_latency", 6))


@query("s12_report_sink", f"WITH {SCORED_SQL} SELECT graph_version, cases, pass_rate, '20260120T000000Z-eval' AS run_id FROM ({_REPORT})")
def s12(spark, folder):
    """The run report written as JSON under its run id and read back."""
    path = scratch_folder(spark, "report")
    sinks.write_report(e2(spark, folder), path, "20260120T000000Z-eval")
    return spark.read.schema("graph_version string, cases long, pass_rate double, run_id string").json(path)


@query(
    "s6_case_sets",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'time_sensitive' ELSE 'stable' END AS expected_intent, quality = 0 AS expected_handoff,
       CASE WHEN toxic = 0 THEN CAST(2 AS BIGINT) ELSE 0 END AS turns FROM labels""",
)
def s6(spark, folder):
    """Case sets of both shapes (one transcript, or a list of turns) as JSON files, read with the declared schema."""
    single = F.struct(F.col("id").cast("string").alias("id"), F.lit("hello").alias("transcript"), "expected_intent", "expected_handoff")
    many = F.struct(
        F.col("id").cast("string").alias("id"), F.array(F.lit("hello"), F.lit("and then?")).alias("turns"), "expected_intent", "expected_handoff"
    )
    stored = case_table(spark, folder).select(
        F.when(F.col("requires_citations"), F.to_json(many)).otherwise(F.to_json(single)).alias("value")
    )
    path = scratch_folder(spark, "cases")
    stored.write.text(path)
    return crawl.read_cases(spark, path, lines=True).select(
        "id", "expected_intent", "expected_handoff", F.coalesce(F.size("turns"), F.lit(0)).cast("long").alias("turns")
    ).withColumn("turns", F.greatest("turns", F.lit(0)))


# --- retrieval cases over the conversations --------------------------------------------------


def final_calls(spark, folder):
    """The last user turn of each conversation after rewriting with memory."""
    folded = dl.rewrite_with_memory(requests(talk(spark, folder)))
    last = F.max_by(F.struct("search_query", "rewrite_source"), "request_no")
    return folded.groupBy("conversation_id").agg(last.alias("l"), F.count("*").alias("turns")).select(
        F.col("conversation_id").alias("id"), "turns", "l.*"
    )


@query(
    "e3_retrieval_scoring",
    search_sql(
        """SELECT f.id, CASE WHEN f.turns < 2 THEN 'skipped' WHEN len(errors) = 0 THEN 'passed' ELSE 'failed' END AS status, array_to_string(errors, '; ') AS errors FROM (
             SELECT f.*, CASE WHEN f.turns < 2 THEN [] ELSE list_filter([
               CASE WHEN NOT contains(lower(coalesce(c.context, '')), 'eneau') THEN 'missing context substring=''eneau''' END,
               CASE WHEN f.source <> 'memory_heuristic' THEN 'rewrite_source=''' || f.source || '''' END,
               CASE WHEN NOT contains(lower(f.text), 'follow-up') THEN 'missing resolved query substring=''Follow-up''' END,
               CASE WHEN length(f.text) > 400 THEN 'latency_ms=' || length(f.text) || ' > 400' END], lambda x: x IS NOT NULL) END AS errors
             FROM finals f LEFT JOIN (SELECT h.qid, string_agg(k.content, chr(10) ORDER BY h.rank) AS context FROM hits h JOIN kc k ON k.id = h.cid GROUP BY h.qid) c ON c.qid = f.id) f""",
        source="(SELECT id, text FROM finals)",
        before=f""", {memory_sql(1800, 4)},
finals AS MATERIALIZED (SELECT conversation_id AS id, max(n) AS turns, max_by(search_query, n) AS text,
   max_by(CASE WHEN search_query <> text THEN 'memory_heuristic' ELSE 'original' END, n) AS source FROM memory WHERE n > 0 GROUP BY conversation_id)""",
    ),
)
def e3(spark, folder):
    """Conversations as retrieval cases; the query length stands in for a measured latency."""
    finals = materialized(final_calls(spark, folder), "finals")
    asked = finals.select(F.col("id").alias("query_id"), F.col("search_query").alias("text"))
    found = se.hybrid_search(asked, stored_chunks(spark, folder), site_table(spark, folder), profiles=PROFILES, home=HOME)
    texts = found.groupBy(F.col("query_id").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda h: h["content"]), "\n").alias("context_text")
    )
    calls = finals.join(texts, "id", "left").select(
        "id", "context_text", "rewrite_source", F.col("search_query").alias("resolved_query"), F.length("search_query").alias("latency_ms")
    )
    cases = finals.select(
        "id", (F.col("turns") >= 2).alias("requires_tool_call"), F.array(F.lit("eneau")).alias("expected_context_substrings"),
        F.lit("memory_heuristic").alias("expected_rewrite_source"), F.array(F.lit("Follow-up")).alias("expected_resolved_query_substrings"),
        F.lit(400).alias("max_tool_latency_ms"),
    )
    return ops.score_retrieval(cases, calls).select("id", "status", F.array_join("errors", "; ").alias("errors"))


# --- transcripts -----------------------------------------------------------------------------


def spoken_turns(spark, folder):
    return table(spark, folder, "conversations").withColumn("role", dl.normalized_role(F.col("role"))).filter(
        "role IS NOT NULL"
    ).select("conv_id", F.col("turn").cast("long"), "role", F.col("text").alias("message"))


def transcript_cases(spark, folder):
    """One case per length class of user turns: its smallest text with a few letters changed."""
    users = table(spark, folder, "conversations").filter("role = 'user'")
    size_class = F.floor(F.log2(F.length("text")))
    return users.groupBy(size_class.alias("case_id")).agg(F.min("text").alias("text")).select(
        "case_id", F.replace(F.col("text"), F.lit("en"), F.lit("em")).alias("expected"),
        F.array(F.lit("e")).alias("required"), F.array(F.lit("zzz")).alias("forbidden"),
        (F.col("case_id") % 2 == 0).alias("requires_tool_call"),
        F.when(F.col("case_id") % 3 == 0, "search_kb").alias("expected_tool"),
    )


def stored_transcripts(spark, folder):
    """Conversations as JSON transcripts; assistant turns carry a tool call and its result."""
    talking = F.col("role") == "assistant"
    tool = F.when(F.col("turn") % 4 == 1, "search_kb").otherwise("handoff")
    seconds = F.round(F.length("text") / 1000.0, 3)
    entry = F.struct(
        "turn", "role", F.col("text").alias("message"),
        F.when(talking, F.array(F.struct(tool.alias("tool_name")))).alias("tool_calls"),
        F.when(
            talking,
            F.array(F.struct(tool.alias("tool_name"), seconds.alias("tool_latency_secs"), (F.length("text") % 50 == 0).alias("is_error"))),
        ).alias("tool_results"),
    )
    packed = table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("transcript"))
    return packed.select("conv_id", F.to_json(F.struct("transcript")).alias("value"))


@query(
    "e6_tool_calls",
    """SELECT conv_id, tool_name, kind, count(*) AS n, round(coalesce(sum(latency), 0), 6) AS latency, count(*) FILTER (bad) AS failed FROM (
         SELECT conv_id, CASE WHEN turn % 4 = 1 THEN 'search_kb' ELSE 'handoff' END AS tool_name, 'call' AS kind, CAST(NULL AS DOUBLE) AS latency, FALSE AS bad FROM conversations WHERE role = 'assistant'
         UNION ALL SELECT conv_id, CASE WHEN turn % 4 = 1 THEN 'search_kb' ELSE 'handoff' END, 'result', round(length(text) / 1000.0::DOUBLE, 3), length(text) % 50 = 0 FROM conversations WHERE role = 'assistant')
       GROUP BY 1, 2, 3""",
)
def e6(spark, folder):
    tools = ops.tool_rows(stored_transcripts(spark, folder), dialogue_flow.TRANSCRIPT)
    return tools.groupBy("conv_id", "tool_name", "kind").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("latency"), F.lit(0.0)), 6).alias("latency"), F.count_if("is_error").alias("failed")
    )


_CASES_SQL = """cases AS (SELECT CAST(floor(log2(length(text))) AS BIGINT) AS case_id FROM conversations WHERE role = 'user' GROUP BY 1)"""


@query(
    "j10_tool_cases",
    f"""WITH {_CASES_SQL}, tools AS (SELECT conv_id, CASE WHEN turn % 4 = 1 THEN 'search_kb' ELSE 'handoff' END AS tool_name, length(text) % 50 = 0 AS bad FROM conversations WHERE role = 'assistant')
        SELECT t.conv_id, c.case_id, count(*) AS calls, count(*) AS results, count(*) FILTER (bad) AS failed
        FROM tools t JOIN cases c ON c.case_id % 3 <> 0 OR t.tool_name = 'search_kb' GROUP BY 1, 2""",
)
def j10(spark, folder):
    tools = ops.tool_rows(stored_transcripts(spark, folder), dialogue_flow.TRANSCRIPT)
    return ops.matched_tools(transcript_cases(spark, folder), tools)


@query("j7_best_user_turn")
def j7(spark, folder):
    """The best user turn for every case by matching blocks, with its Levenshtein ratio beside."""
    found = ops.best_user_turns(spoken_cases(spark, folder), spoken_turns(spark, folder))
    return found.withColumn("similarity", F.round("similarity", 3)).withColumn("edit_ratio", F.round("edit_ratio", 3))


def spoken_cases(spark, folder):
    """One case a conversation: its first user turn with a few letters changed."""
    users = table(spark, folder, "conversations").filter("role = 'user'")
    return users.groupBy(F.col("conv_id").alias("case_id")).agg(F.min_by("text", "turn").alias("text")).select(
        "case_id", F.replace(F.col("text"), F.lit("en"), F.lit("em")).alias("expected"))


def _plain(frame, column):
    """Accent-free words: letters that every engine counts alike."""
    return frame.withColumn(column, normalized(F.col(column)))


def _match_sql(golden: str, plain: str, ratio: str, floor: str) -> str:
    """CTE ``best(conv_id, case_id, turn, similarity, edit_ratio)``: every case against every user turn."""
    return f"""
golden AS ({golden}),
heard AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {plain} AS said FROM (SELECT *, text AS raw FROM conversations WHERE lower(trim(role)) = 'user')),
asked AS (SELECT case_id, {plain} AS said FROM (SELECT *, expected AS raw FROM golden)),
scored AS (SELECT h.conv_id, a.case_id, h.turn, {ratio} AS edit_ratio,
  CASE WHEN contains(h.said, a.said) OR contains(a.said, h.said) THEN 1.0::DOUBLE ELSE {ratio} END AS similarity FROM heard h, asked a),
best AS (SELECT * FROM scored WHERE similarity >= {floor} QUALIFY row_number() OVER (PARTITION BY conv_id, case_id ORDER BY similarity DESC, turn) = 1)"""


_PER_CONVERSATION = "SELECT conv_id AS case_id, replace(min_by(text, turn), 'en', 'em') AS expected FROM conversations WHERE role = 'user' GROUP BY 1"
_PER_LENGTH = """SELECT CAST(floor(log2(length(text))) AS BIGINT) AS case_id, replace(min(text), 'en', 'em') AS expected
  FROM conversations WHERE role = 'user' GROUP BY 1"""
_LONGER = "greatest(length(h.said), length(a.said))"
_EDIT_RATIO = f"CASE WHEN {_LONGER} = 0 THEN 1.0::DOUBLE ELSE 1 - levenshtein(h.said, a.said)::DOUBLE / {_LONGER} END"


@query(
    "j7_contained_turns",
    f"WITH {_match_sql(_PER_CONVERSATION, t.collapse('lower(raw)'), '0', '1')} SELECT conv_id, case_id, turn FROM best",
)
def j7_contained(spark, folder):
    """The first user turn that holds a case's text or is held by it."""
    found = ops.best_user_turns(spoken_cases(spark, folder), spoken_turns(spark, folder), floor=1.0)
    return found.select("conv_id", "case_id", "turn")


@query(
    "j7_levenshtein_turns",
    f"""WITH {_match_sql(_PER_CONVERSATION, t.normalized('raw'), _EDIT_RATIO, '0.72')}
SELECT conv_id, case_id, round(similarity, 6) AS similarity, turn, round(edit_ratio, 6) AS edit_ratio FROM best""",
)
def j7_edits(spark, folder):
    """The best user turn by Levenshtein ratio, through the same candidates as the matching-blocks ratio."""
    cases, turns = _plain(spoken_cases(spark, folder), "expected"), _plain(spoken_turns(spark, folder), "message")
    found = ops.best_user_turns(cases, turns, measure="edits")
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("edit_ratio", F.round("edit_ratio", 6))


_QUOTE = "chr(39)"


@query(
    "e4_transcript_scoring_edits",
    f"""WITH {_match_sql(_PER_LENGTH, t.normalized('raw'), _EDIT_RATIO, '0.72')},
said_by AS (SELECT conv_id, turn, CASE WHEN lower(trim(role)) = 'user' THEN 'user' ELSE 'agent' END AS who, {t.normalized('text')} AS message
  FROM conversations WHERE lower(trim(role)) IN ('user', 'agent', 'assistant', 'ai')),
until AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM said_by WHERE who = 'user'),
told AS (SELECT u.conv_id, u.turn, string_agg(s.message, chr(10) ORDER BY s.turn) AS answer FROM until u JOIN said_by s
  ON s.conv_id = u.conv_id AND s.who = 'agent' AND s.turn > u.turn AND (u.next IS NULL OR s.turn < u.next) GROUP BY 1, 2),
used AS (SELECT c.conv_id, g.case_id, count(*) AS calls, count(*) FILTER (length(c.text) % 50 = 0) AS failed FROM conversations c JOIN golden g
  ON c.role = 'assistant' AND (g.case_id % 3 <> 0 OR c.turn % 4 = 1) GROUP BY 1, 2),
judged AS (
  SELECT v.conv_id, g.case_id, b.similarity, b.edit_ratio, b.turn AS matched_turn, coalesce(o.answer, '') AS answer,
    coalesce(u.calls, 0) AS calls, coalesce(u.failed, 0) AS failed
  FROM (SELECT DISTINCT conv_id FROM said_by) v CROSS JOIN golden g LEFT JOIN best b ON b.conv_id = v.conv_id AND b.case_id = g.case_id
    LEFT JOIN told o ON o.conv_id = b.conv_id AND o.turn = b.turn LEFT JOIN used u ON u.conv_id = v.conv_id AND u.case_id = g.case_id),
listed AS (SELECT *, list_filter([
    CASE WHEN similarity IS NULL THEN 'missing user turn' END, CASE WHEN similarity IS NOT NULL AND answer = '' THEN 'missing agent answer' END,
    CASE WHEN NOT contains(lower(answer), 'e') THEN 'missing substring=' || {_QUOTE} || 'e' || {_QUOTE} END,
    CASE WHEN contains(lower(answer), 'zzz') THEN 'forbidden substring=' || {_QUOTE} || 'zzz' || {_QUOTE} END,
    CASE WHEN case_id % 2 = 0 AND calls = 0 THEN 'missing tool call=' || CASE WHEN case_id % 3 = 0 THEN {_QUOTE} || 'search_kb' || {_QUOTE} ELSE 'None' END END,
    CASE WHEN failed > 0 THEN 'tool result error' END], lambda e: e IS NOT NULL) AS wrong FROM judged)
SELECT conv_id, case_id, round(similarity, 3) AS similarity, round(edit_ratio, 3) AS edit_ratio, matched_turn, calls AS tool_calls, calls AS tool_results,
  array_to_string(wrong, '; ') AS errors, len(wrong) = 0 AS passed FROM listed""",
)
def e4_edits(spark, folder):
    """Transcript scoring with the Levenshtein ratio in place of matching blocks."""
    cases, turns = _plain(transcript_cases(spark, folder), "expected"), _plain(spoken_turns(spark, folder), "message")
    tools = ops.tool_rows(stored_transcripts(spark, folder), dialogue_flow.TRANSCRIPT)
    scored = ops.score_transcripts(cases, turns, tools, measure="edits")
    return scored.withColumn("errors", F.array_join("errors", "; "))


@query("e4_transcript_scoring")
def e4(spark, folder):
    tools = ops.tool_rows(stored_transcripts(spark, folder), dialogue_flow.TRANSCRIPT)
    scored = ops.score_transcripts(transcript_cases(spark, folder), spoken_turns(spark, folder), tools)
    return scored.withColumn("errors", F.array_join("errors", "; "))


@query(
    "e7_test_runs",
    """WITH r AS (SELECT 'inv-' || conv_id % 7 AS invocation_id, conv_id, bool_or(turn >= 3) AS ok FROM conversations GROUP BY 1, 2),
       l AS (SELECT 'inv-' || conv_id % 7 AS invocation_id, length(text) / 1000.0::DOUBLE AS latency FROM conversations WHERE role = 'assistant'),
       p AS (SELECT invocation_id, list_sort(list(latency))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT)] AS p95 FROM l GROUP BY 1)
       SELECT r.invocation_id, count(*) AS test_runs, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS pass_rate, bool_and(ok) AS passed, coalesce(any_value(p.p95), 0) AS p95
       FROM r LEFT JOIN p ON p.invocation_id = r.invocation_id GROUP BY 1""",
)
def e7(spark, folder):
    """Stored test-run results: one run per conversation, its assistant turns as tool results."""
    turns = table(spark, folder, "conversations")
    reply = F.when(
        F.col("role") == "assistant",
        F.struct(
            F.array(F.struct(F.lit("search_kb").alias("tool_name"))).alias("tool_calls"),
            F.array(F.struct(F.lit("search_kb").alias("tool_name"), (F.length("text") / 1000.0).alias("tool_latency_secs"))).alias("tool_results"),
        ),
    )
    run = F.struct(
        F.col("conv_id").cast("string").alias("test_run_id"),
        F.struct(F.when(F.bool_or(F.col("turn") >= 3), "success").otherwise("failure").alias("result")).alias("condition_result"),
        F.collect_list(reply).alias("agent_responses"),
    )
    runs = turns.groupBy(F.concat(F.lit("inv-"), (F.col("conv_id") % 7).cast("string")).alias("id"), "conv_id").agg(run.alias("run"))
    stored = runs.select(F.to_json(F.struct("id", F.array("run").alias("test_runs"))).alias("value"))
    return ops.test_run_report(ops.test_run_rows(stored))


# --- crawl jobs ------------------------------------------------------------------------------


@query(
    "a9_crawl_summary",
    f"""WITH {LINKS}, hosts AS (SELECT page_id, {t.slug('host')} AS crawl_id, source, row_number() OVER (PARTITION BY source ORDER BY page_id) AS rn FROM page_urls),
        seen AS (SELECT crawl_id, count(*) AS pages_seen, count(*) FILTER (rn = 1) AS pages_crawled, count(*) FILTER (rn > 1) AS pages_failed,
          count(*) FILTER (rn = 1 AND page_id % 4 = 3) + CAST(sum(CASE WHEN page_id % 4 <> 3 THEN 1 + page_id % 3 ELSE 0 END) AS BIGINT) AS credits_used FROM hosts GROUP BY 1),
        reasons AS (SELECT {t.slug(t.host('url'))} AS crawl_id, {reason_sql('url', POLICY['allowed_domains'], POLICY['exclude_patterns'])} AS reason, count(*) AS n FROM first_links GROUP BY 1, 2)
        SELECT s.*, r.candidate_urls, r.selected_urls, r.skip_reasons FROM seen s LEFT JOIN (
          SELECT crawl_id, CAST(sum(n) AS BIGINT) AS candidate_urls, CAST(coalesce(sum(n) FILTER (reason IS NULL), 0) AS BIGINT) AS selected_urls,
            coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS skip_reasons FROM reasons GROUP BY 1) r ON r.crawl_id = s.crawl_id""",
)
def a9(spark, folder):
    """One crawl per host; a page whose canonical URL was seen before counts as failed.

    Every fourth page was read one by one after the crawl; the crawl results of the others state one to three credits.
    """
    pages = raw_pages(spark, folder)
    keyed = pages.select("page_id", u.site_key(F.col("url")).alias("crawl_id"), u.canonical_url(F.col("url")).alias("canonical_url"))
    first = pg.canonical_pages(pages.select("page_id", "url")).select("page_id", F.lit(False).alias("failed"))
    scraped = F.col("page_id") % 4 == 3
    seen = keyed.join(first, "page_id", "left").withColumn("failed", F.coalesce("failed", F.lit(True))).withColumn("scraped", scraped)
    credits = keyed.where(~scraped).select("crawl_id", (1 + F.col("page_id") % 3).alias("credits_used"))
    chosen = pg.admit_urls(pg.page_links(pages), **POLICY).withColumn("crawl_id", u.site_key(F.col("url")))
    summary = rollups.crawl_summary(seen, chosen, credits)
    pairs = F.transform(F.map_entries("skip_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return summary.withColumn("skip_reasons", F.array_join(pairs, ","))


#: Pages that each host's crawl job may read beyond its first one.
PAGES_PER_JOB = 12


def frontier_log(spark, folder):
    """Every host is a crawl job with a budget of its own: from its first page on, all page URLs known from the site map."""
    pages = raw_pages(spark, folder)
    entry = pages.groupBy(u.site_key(F.col("url")).alias("site_id")).agg(F.min("page_id").alias("page_id")).select("page_id")
    start = pages.join(entry, "page_id", "left_semi")
    found = pg.merge_candidates(pg.page_links(start), pages.select("url"), SEED)
    visited = start.select(u.canonical_url(F.col("url")).alias("url"))
    return frontier.expand_frontier(found, pages, visited, budget=PAGES_PER_JOB, job=u.site_key, **POLICY)


_WAVE = f"""{LINKS},
entry AS (SELECT min(page_id) AS page_id FROM page_urls GROUP BY {t.slug('host')}),
open_urls AS (SELECT DISTINCT url FROM (SELECT l.url FROM link_rows l JOIN entry e ON e.page_id = l.page_id UNION ALL SELECT source FROM page_urls WHERE source IS NOT NULL)
  WHERE url NOT IN (SELECT source FROM page_urls p JOIN entry e ON e.page_id = p.page_id WHERE source IS NOT NULL)
    AND {reason_sql('url', POLICY['allowed_domains'], POLICY['exclude_patterns'])} IS NULL),
ordered AS (SELECT url, category, CASE category {_rank} ELSE 99 END AS r, url IN (SELECT source FROM page_urls WHERE source IS NOT NULL) AS scraped FROM (SELECT url, {category_sql('url')} AS category FROM open_urls)),
counted AS (SELECT *, sum(CAST(scraped AS INTEGER)) OVER (PARTITION BY job ORDER BY r, url) AS paid FROM (SELECT *, {t.slug(t.host('url'))} AS job FROM ordered)),
first_wave AS (SELECT url, category, scraped, job FROM counted WHERE paid < {PAGES_PER_JOB} OR (paid = {PAGES_PER_JOB} AND scraped)),
spent AS (SELECT job FROM first_wave GROUP BY job HAVING count(*) FILTER (scraped) >= {PAGES_PER_JOB}),
fresh AS (SELECT DISTINCT l.url FROM link_rows l JOIN page_urls p ON p.page_id = l.page_id JOIN first_wave g ON g.url = p.source AND g.scraped
  WHERE l.pos > 0 AND l.url NOT IN (SELECT url FROM open_urls)
    AND l.url NOT IN (SELECT source FROM page_urls p2 JOIN entry e ON e.page_id = p2.page_id WHERE source IS NOT NULL)
    AND {reason_sql('l.url', POLICY['allowed_domains'], POLICY['exclude_patterns'])} IS NULL
    AND {t.slug(t.host('l.url'))} NOT IN (SELECT job FROM spent)),
log AS (SELECT CAST(0 AS BIGINT) AS wave, url, category, scraped FROM first_wave
  -- every stored page is listed, so links found later lead nowhere: all of them fail in a second wave
  UNION ALL SELECT 1, url, {category_sql('url')}, FALSE FROM fresh)"""


@query("g2_frontier", f"WITH {_WAVE} SELECT url, category, wave, scraped FROM log")
def g2(spark, folder):
    return frontier_log(spark, folder).select("url", "category", F.col("wave").cast("long"), "scraped")


@query(
    "g3_visit_accounting",
    f"WITH {_WAVE} SELECT wave, category, count(*) FILTER (scraped) AS scraped, count(*) FILTER (NOT scraped) AS failed FROM log GROUP BY wave, category",
)
def g3(spark, folder):
    return frontier.visit_summary(frontier_log(spark, folder)).withColumn("wave", F.col("wave").cast("long"))


# --- orders and joins of the search ----------------------------------------------------------


@query("j2_all_pairs_best", search_sql("SELECT qid AS query_id, cid AS chunk_id, base FROM found WHERE channel = 'vector' AND rn <= 3"))
def j2(spark, folder):
    """Every query against every chunk; only the three best per query leave the scan."""
    asked = se.prepare_queries(questions(spark, folder)).withColumn("vector_text", F.col("raw"))
    return scan_topk(se.chunk_vectors(keyed_chunks(spark, folder)), asked, 3).select("query_id", "chunk_id", "base")


@query(
    "j8_channel_overlap",
    search_sql("""SELECT qid AS query_id, count(*) FILTER (n = 2) AS in_both, count(*) FILTER (n = 1 AND c = 'vector') AS vector_only,
        count(*) FILTER (n = 1 AND c = 'lexical') AS lexical_only FROM (SELECT qid, cid, count(*) AS n, min(channel) AS c FROM found GROUP BY 1, 2) GROUP BY 1"""),
)
def j8(spark, folder):
    asked = se.prepare_queries(questions(spark, folder)).withColumn("vector_text", F.col("raw"))
    found = scan_topk(se.chunk_vectors(keyed_chunks(spark, folder)), asked, 30, lexical="overlap")
    pairs = found.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.min("channel").alias("c"))
    one = F.col("n") == 1
    return pairs.groupBy("query_id").agg(
        F.count_if(F.col("n") == 2).alias("in_both"),
        F.count_if(one & (F.col("c") == "vector")).alias("vector_only"),
        F.count_if(one & (F.col("c") == "lexical")).alias("lexical_only"),
    )


@query("o2_fused_order", search_sql("SELECT qid AS query_id, cid AS chunk_id, score, fusion_score FROM fused WHERE fused_rank <= 10 ORDER BY qid, score DESC, fusion_score DESC, cid"))
def o2(spark, folder):
    from sagewell.plans.retrieval_jobs import confident_pairs

    fused = se.rrf(se.channel_ranks(confident_pairs(spark, folder)), 10)
    return fused.orderBy("query_id", F.desc("score"), F.desc("fusion_score"), "chunk_id").select(
        "query_id", "chunk_id", "score", "fusion_score"
    )


@query("o3_citation_order", search_sql("SELECT id AS answer_id, citation_no, rank FROM cited WHERE citation_no <= 3 ORDER BY id, support DESC, rank", after=SUPPORT))
def o3(spark, folder):
    return _cited(spark, folder).orderBy("answer_id", F.desc("support"), "rank").select(
        "answer_id", F.col("citation_no").cast("long"), F.col("rank").cast("long")
    )
