"""Registered queries: documents to chunks, and roll-ups over the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.functions.text import compact
from sagewell.operators import chunks as ops
from sagewell.operators import frontier, rollups
from sagewell.operators.search import scoped
from sagewell.plans import twins as t
from sagewell.plans.registry import query
from sagewell.sources import sinks
from sagewell.sources.tables import document_pages, table


def pieces_of(pages: DataFrame) -> DataFrame:
    return ops.chunk(pages, "text").withColumn(
        "section", F.concat(F.lit("Part "), (F.col("chunk_no") + 1).cast("string"))
    )


def document_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces_of(document_pages(spark, folder))


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The enriched chunk table of the documents; a map-only pipeline."""
    return ops.enrich_chunks(
        pieces_of(ops.with_canonical_url(document_pages(spark, folder))),
        vocab.CATEGORY_RULES,
        vocab.TTL_DAYS,
        vocab.PLACE_RULES,
        default_category=vocab.DEFAULT_CATEGORY,
    )


@query(
    "p17_chunk_prose",
    t.with_pieces("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, content FROM pieces"),
)
def p17(spark, folder):
    return document_pieces(spark, folder).select("doc_id", F.col("chunk_no").cast("long"), "content")


@query(
    "p19_chunk_category",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, category FROM chunks"),
)
def p19(spark, folder):
    return document_chunks(spark, folder).select("doc_id", F.col("chunk_no").cast("long"), "category")


@query(
    "p25_search_text",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, content_hash, search_text FROM chunks"),
)
def p25(spark, folder):
    return document_chunks(spark, folder).select(
        "doc_id", F.col("chunk_no").cast("long"), "content_hash", "search_text"
    )

# --- enrichment ------------------------------------------------------------------------------


@query(
    "p20_validity",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, category, CAST(valid_until AS VARCHAR) AS valid_until FROM chunks"),
)
def p20(spark, folder):
    return document_chunks(spark, folder).select(
        "doc_id", F.col("chunk_no").cast("long"), "category", F.col("valid_until").cast("string")
    )


@query(
    "p21_content_hash",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, content_hash FROM chunks"),
)
def p21(spark, folder):
    return document_chunks(spark, folder).select("doc_id", F.col("chunk_no").cast("long"), "content_hash")


def _fact_sql(pattern: str, group: int = 0) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(body, {t.text(pattern)}, {group}))), '|'), '')"


_price_sql = r"(?:^|[^\pL\pN_])(\d{1,3}(?:[.,]\d{3})+(?:\s?VNĐ|\s?vnđ|\s?VND)?)"
_offer = "text || ' Giảm ' || (5 + doc_id % 60) || '% và x' || (1 + doc_id % 5) || ' ưu đãi, ' || (1 + doc_id % 28) || '/5/2026 - 30/6/2026. Costs ' || (1 + doc_id % 900) || '.000 VND'"


@query(
    "p22_facts",
    f"""SELECT doc_id, {_fact_sql(_price_sql, 1)} AS price, {_fact_sql(ops.DISCOUNT_PATTERN.replace('(?iU)', '(?i)'))} AS discount,
        {_fact_sql(ops.DATE_WINDOW_PATTERN)} AS applicability FROM (SELECT doc_id, {_offer} AS body FROM documents)""",
)
def p22(spark, folder):
    """Prices, discounts and date windows; each document gets an offer sentence derived from its id."""
    number = F.col("doc_id")
    offer = F.concat(
        F.col("text"), F.lit(" Giảm "), (5 + number % 60).cast("string"), F.lit("% và x"), (1 + number % 5).cast("string"), F.lit(" ưu đãi, "),
        (1 + number % 28).cast("string"), F.lit("/5/2026 - 30/6/2026. Costs "), (1 + number % 900).cast("string"),
        F.lit(".000 VND"),
    )
    facts = ops.with_facts(document_pages(spark, folder).select("doc_id", offer.alias("content")))
    return facts.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("price", "discount", "applicability")])


@query(
    "p23_place_tags",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, location, language FROM chunks"),
)
def p23(spark, folder):
    return document_chunks(spark, folder).select("doc_id", F.col("chunk_no").cast("long"), "location", "language")


def _compact_sql(expr: str, limit: int) -> str:
    flat = t.collapse(expr)
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(substring({flat}, 1, {limit - 1})) || '...' END"


@query(
    "p27_hit_payload",
    f"SELECT doc_id, {_compact_sql('text', 900)} AS content, {_compact_sql('text', 120)} AS title, {_compact_sql('text', 160)} AS section FROM documents",
)
def p27(spark, folder):
    text = F.col("text")
    return document_pages(spark, folder).select(
        "doc_id", compact(text, 900).alias("content"), compact(text, 120).alias("title"), compact(text, 160).alias("section")
    )


@query(
    "p1_site_scope",
    t.with_chunks("SELECT category, count(*) AS chunks FROM chunks WHERE site_id = 'src3' GROUP BY category"),
)
def p1(spark, folder):
    return scoped(document_chunks(spark, folder), "src3").groupBy("category").agg(F.count("*").alias("chunks"))


@query(
    "p2_optional_scope",
    t.with_chunks("""SELECT wanted, category, count(*) AS chunks FROM chunks JOIN (VALUES (NULL), ('src3')) w(wanted)
        ON wanted IS NULL OR site_id = wanted GROUP BY 1, 2"""),
)
def p2(spark, folder):
    """The same filter with a null parameter, which switches it off and folds away in the plan, and with a site."""
    def scope(site):
        wanted = F.lit(site).cast("string")
        chunks = document_chunks(spark, folder).filter(wanted.isNull() | (F.col("site_id") == wanted))
        return chunks.groupBy(wanted.alias("wanted"), "category").agg(F.count("*").alias("chunks"))

    return scope(None).unionByName(scope("src3"))


# --- sinks -----------------------------------------------------------------------------------

def as_of():
    return F.expr("TIMESTAMP_NTZ'2026-01-20 00:00:00'")


def _text_rows(spark, folder):
    """Documents keyed by language and text only, so copies share a key."""
    return table(spark, folder, "documents").select(
        F.col("lang").alias("site_id"), F.sha2("text", 256).alias("content_hash"), "doc_id"
    )


@query(
    "s7_insert_if_absent",
    """WITH r AS (SELECT lang AS site_id, sha256(text) AS content_hash, doc_id FROM documents),
       old AS (SELECT r.* FROM r JOIN labels l ON l.doc_id = r.doc_id)
       SELECT site_id, content_hash, min(doc_id) AS doc_id FROM r
       WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.site_id = r.site_id AND o.content_hash = r.content_hash) GROUP BY 1, 2""",
)
def s7(spark, folder):
    """Insert all documents into a table that already holds the labelled ones."""
    rows = _text_rows(spark, folder)
    stored = rows.join(table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi")
    return sinks.insert_if_absent(stored, rows, ["site_id", "content_hash"], [F.asc("doc_id")])


@query(
    "j3_inserted_counts",
    """WITH r AS (SELECT lang AS site_id, sha256(text) AS content_hash, doc_id FROM documents),
       old AS (SELECT r.* FROM r JOIN labels l ON l.doc_id = r.doc_id)
       SELECT site_id, count(DISTINCT content_hash) AS inserted FROM r
       WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.site_id = r.site_id AND o.content_hash = r.content_hash) GROUP BY 1""",
)
def j3(spark, folder):
    return s7(spark, folder).groupBy("site_id").agg(F.count("*").alias("inserted"))


@query(
    "s8_upsert_latest",
    """SELECT user_id, event_type, value, CAST(ts AS VARCHAR) AS updated_at, CAST(first_ts AS VARCHAR) AS created_at FROM (
       SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""",
)
def s8(spark, folder):
    """Latest state per user: the first half of the log is the stored table, the rest arrives."""
    log = table(spark, folder, "events").select(
        "user_id", "event_type", "value", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at")
    )
    middle = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    merged = sinks.upsert_latest(
        log.filter(F.col("updated_at") < middle), log.filter(F.col("updated_at") >= middle), ["user_id"], "updated_at", "created_at"
    )
    return merged.select(
        "user_id", "event_type", "value", F.col("updated_at").cast("string"), F.col("created_at").cast("string")
    )


def known_sites(spark, folder):
    """Configured sites: every nation outside region 0 stands for the site of one source."""
    return table(spark, folder, "nation").filter("n_regionkey <> 0").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("site_id")
    )


_KNOWN = "known AS (SELECT 'src' || n_nationkey AS site_id FROM nation WHERE n_regionkey <> 0)"


@query(
    "s9_new_sites",
    f"""WITH {_KNOWN}, first AS (SELECT source AS site_id, min_by('https://' || source || '.example.org', doc_id) AS root_url FROM documents GROUP BY source)
        SELECT f.site_id, f.root_url, replace(f.root_url, 'https://', '') AS allowed_domain FROM first f
        WHERE f.site_id NOT IN (SELECT site_id FROM known)""",
)
def s9(spark, folder):
    pages = document_pages(spark, folder).select("site_id", "source_url", "doc_id")
    return sinks.new_sites(pages, known_sites(spark, folder), F.col("doc_id"))


@query(
    "s10_backfill",
    t.with_chunks("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, search_text FROM chunks"),
)
def s10(spark, folder):
    """Rows written before the derived column existed are filled, the others kept."""
    chunks = document_chunks(spark, folder)
    older = chunks.withColumn("search_text", F.when(F.col("language") == "en", F.col("search_text")).otherwise(""))
    filled = sinks.backfill(older, "search_text", ops.search_text(*ops.SEARCH_FIELDS))
    return filled.select("doc_id", F.col("chunk_no").cast("long"), "search_text")


# --- roll-ups --------------------------------------------------------------------------------


@query("a1_category_counts", t.with_chunks("SELECT category, count(*) AS chunks FROM chunks GROUP BY category ORDER BY chunks DESC, category"))
def a1(spark, folder):
    return rollups.category_counts(document_chunks(spark, folder))


@query(
    "a2_category_counts_unknown",
    t.with_chunks("""SELECT site_id, category, count(*) AS chunks FROM (SELECT site_id, coalesce(CASE WHEN category <> 'overview' THEN category END, 'unknown') AS category FROM chunks) GROUP BY 1, 2"""),
)
def a2(spark, folder):
    """Counts per site; the default category is stored as null here and shown as ``unknown``."""
    chunks = document_chunks(spark, folder).withColumn("category", F.nullif(F.col("category"), F.lit("overview")))
    return rollups.category_counts(chunks, ("site_id",))


@query("a3_crawl_extent", t.with_chunks("SELECT count(*) AS chunks, CAST(max(crawled_at) AS VARCHAR) AS latest_crawl FROM chunks"))
def a3(spark, folder):
    return rollups.crawl_extent(document_chunks(spark, folder)).select("chunks", F.col("latest_crawl").cast("string"))


@query("a4_stale_count", t.with_chunks("SELECT count(*) AS stale FROM chunks WHERE valid_until < TIMESTAMP '2026-01-20'"))
def a4(spark, folder):
    return document_chunks(spark, folder).agg(F.count_if(rollups.expired(as_of())).alias("stale"))


@query(
    "t6_expiry_sweep",
    t.with_chunks("""SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(valid_until AS VARCHAR) AS valid_until FROM chunks WHERE valid_until < TIMESTAMP '2026-01-20'"""),
)
def t6(spark, folder):
    return document_chunks(spark, folder).filter(rollups.expired(as_of())).select(
        "doc_id", F.col("chunk_no").cast("long"), F.col("valid_until").cast("string")
    )


@query(
    "a5_doc_set_hash",
    t.with_chunks("""SELECT site_id, md5(string_agg(content_hash, ',' ORDER BY content_hash)) AS doc_set_hash, count(*) AS chunks
        FROM chunks GROUP BY site_id"""),
)
def a5(spark, folder):
    return rollups.doc_set_hash(document_chunks(spark, folder), ("site_id",))


@query(
    "a6_site_status",
    t.with_chunks(
        """SELECT k.site_id, coalesce(sum(n), 0)::BIGINT AS document_count, CAST(max(latest) AS VARCHAR) AS latest_crawl,
           coalesce(sum(stale), 0)::BIGINT AS stale_count, string_agg(category || '=' || n, ',' ORDER BY n DESC, category) AS category_counts
           FROM known k LEFT JOIN (SELECT site_id, category, count(*) AS n, max(crawled_at) AS latest,
             count(*) FILTER (valid_until < TIMESTAMP '2026-01-20') AS stale FROM chunks GROUP BY 1, 2) c ON c.site_id = k.site_id GROUP BY k.site_id""",
        f", {_KNOWN}",
    ),
)
def a6(spark, folder):
    status = rollups.site_status(document_chunks(spark, folder), known_sites(spark, folder), as_of())
    pairs = F.transform(F.map_entries("category_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return status.select(
        "site_id", "document_count", F.col("latest_crawl").cast("string"), "stale_count", F.array_join(pairs, ",").alias("category_counts")
    )


@query(
    "a8_context_size",
    """SELECT source, count(*) AS hit_count, max(CAST(n_chars AS DOUBLE)) AS top_score, CAST(sum(length(text)) AS BIGINT) AS context_chars,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS context_bytes FROM documents GROUP BY source""",
)
def a8(spark, folder):
    docs = table(spark, folder, "documents").withColumn("score", F.col("n_chars").cast("double"))
    return rollups.context_size(docs, "source", "text", "score")


def job_events(events):
    """The event log as crawl-job events: ``signup`` creates, every type updates its own field."""
    kind = F.when(F.col("event_type") == "signup", "create").otherwise("update")
    return events.select(
        F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"), F.col("event_type").alias("status"),
        F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"),
    )


JOB_SQL = """WITH e AS (SELECT user_id AS job_id, ts, event_id, event_type, props ->> '$.k' AS v FROM events),
       started AS (SELECT job_id, max((ts, event_id)) AS at FROM e WHERE event_type = 'signup' GROUP BY 1),
       live AS (SELECT e.* FROM e JOIN started s ON s.job_id = e.job_id WHERE (e.ts, e.event_id) >= s.at),
       keyed AS (SELECT job_id, event_type, max_by(v, (ts, event_id)) AS v FROM live GROUP BY 1, 2)
       SELECT l.job_id, max_by(l.event_type, (l.ts, l.event_id)) AS status, CAST(max(l.ts) AS VARCHAR) AS updated_at,
         (SELECT string_agg(k.event_type || '=' || k.v, ',' ORDER BY k.event_type) FROM keyed k WHERE k.job_id = l.job_id) AS fields
       FROM live l GROUP BY l.job_id"""


def job_rows(jobs):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return jobs.select("job_id", "status", F.col("updated_at").cast("string"), F.array_join(pairs, ",").alias("fields"))


@query("a10_job_state", JOB_SQL)
def a10(spark, folder):
    return job_rows(rollups.fold_jobs(job_events(table(spark, folder, "events"))))


@query(
    "a11_nearest_rank",
    """SELECT l_returnflag, l_linestatus, avg(CASE WHEN l_discount <= 0.05 THEN 1.0::DOUBLE ELSE 0.0 END) AS pass_rate, round(avg(l_extendedprice), 4) AS mean,
       list_sort(list(l_extendedprice))[1 + CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT)] AS p95 FROM lineitem GROUP BY 1, 2""",
)
def a11(spark, folder):
    """Pass rate, mean and nearest-rank p95 over line items."""
    keys = ["l_returnflag", "l_linestatus"]
    items = table(spark, folder, "lineitem").select(*keys, "l_discount", "l_extendedprice")
    means = items.groupBy(*keys).agg(
        F.avg((F.col("l_discount") <= 0.05).cast("double")).alias("pass_rate"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"),
    )
    return means.join(rollups.nearest_rank(items, keys, "l_extendedprice"), keys)


@query(
    "o4_page_budget",
    """SELECT o_custkey, count(*) AS max_pages, CASE WHEN count(*) <= 4 THEN 0 ELSE least(12, greatest(2, count(*) // 4)) END AS reserve,
       greatest(1, count(*) - CASE WHEN count(*) <= 4 THEN 0 ELSE least(12, greatest(2, count(*) // 4)) END) AS crawl_limit,
       least(5000, greatest(100, count(*) * 20)) AS map_limit FROM orders GROUP BY o_custkey""",
)
def o4(spark, folder):
    """Page budgets of crawls; each customer's order count stands for a requested page count."""
    asked = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("max_pages"))
    return asked.select("o_custkey", "max_pages", *frontier.page_budgets(F.col("max_pages")))
