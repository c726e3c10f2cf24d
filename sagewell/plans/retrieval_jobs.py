"""Registered queries: embeddings, vector and lexical retrieval, fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.operators import cells
from sagewell.operators import postings as lists
from sagewell.operators import rollups
from sagewell.operators import search as ops
from sagewell.operators import vectors as vec
from sagewell.operators.rank import first_per, top_k
from sagewell.operators.scan import scan_topk
from sagewell.plans import twins as t
from sagewell.plans.chunk_jobs import document_chunks
from sagewell.plans.registry import query
from sagewell.session import materialized
from sagewell.sources.tables import spread, table

PROFILES = (
    ops.SiteProfile(
        "src1", aliases=("theringth", "eanon"), url_markers=("/fr/",), off_topic=("ungder", "ciónla"), offer_path="/es/"
    ),
)
HOME = ops.HomeLanguage("fr", "éèêç", ("pour", "avec"))
ALIASES = ["thand", "eauxla", "keitung", "ciones", "onthe"]  # one per region of the site's nation


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return document_chunks(spark, folder).withColumn("chunk_id", F.col("content_hash"))


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table, written once and then scanned by every pass of a search; scans embed its texts."""
    columns = ["chunk_id", "site_id", "title", "section", "category", "content", "source_url", "language",
               "crawled_at", "valid_until", "search_text"]
    return materialized(keyed_chunks(spark, folder).select(*columns), "chunks")


def searchable(spark: SparkSession, folder: str) -> DataFrame:
    """What lexical retrieval reads of the chunk table."""
    return materialized(keyed_chunks(spark, folder).select("chunk_id", "search_text"), "search-texts")


def site_table(spark: SparkSession, folder: str) -> DataFrame:
    """Site dimension: every nation stands for the site of one source."""
    alias = F.element_at(F.array(*map(F.lit, ALIASES)), F.col("n_regionkey") + 1)
    return table(spark, folder, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("site_id"),
        F.array(F.lower("n_name"), alias).alias("site_aliases"),
    )


def dense(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("chunk_id", F.col("vec_id").cast("string"))
    return vec.dense_as_sparse(spread(vectors), "chunk_id", "embedding")


def centroids(spark, folder):
    """One query vector per label: the mean of its embeddings, computed per dimension."""
    dims = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return vec.dense_as_sparse(
        rows.select(F.col("label").cast("long").alias("query_id"), F.col("v.x").alias("mean")), "query_id", "mean"
    )


# --- twins -----------------------------------------------------------------------------------


def hashed(name: str, relation: str) -> str:
    """CTEs ``<name>_vec(id, dim, w, norm)`` of a relation (id, text)."""
    return f"""
{name}_tok AS (SELECT id, tok, count(*) AS c FROM (
   SELECT id, unnest(string_split({t.collapse('lower(text)')}, ' ')) AS tok FROM {relation}) WHERE tok <> '' GROUP BY id, tok),
{name}_slots AS (SELECT tok, CAST('0x' || substring(h, 8 * i + 1, 4) AS INTEGER) % 1536 AS dim,
   1 - 2 * (CAST('0x' || substring(h, 8 * i + 5, 2) AS INTEGER) % 2) AS sgn
   FROM (SELECT tok, sha256(tok) AS h FROM (SELECT DISTINCT tok FROM {name}_tok)), (SELECT unnest(range(8)) AS i)),
{name}_raw AS (SELECT k.id, s.dim, sum(k.c * s.sgn) AS w FROM {name}_tok k JOIN {name}_slots s ON s.tok = k.tok
   GROUP BY k.id, s.dim HAVING sum(k.c * s.sgn) <> 0),
{name}_vec AS (SELECT r.id, r.dim, CAST(r.w AS DOUBLE) AS w, n.norm FROM {name}_raw r
   JOIN (SELECT id, sqrt(CAST(sum(w * w) AS DOUBLE)) AS norm FROM {name}_raw GROUP BY id) n ON n.id = r.id)"""


_wanted = ", ".join(
    f"CASE WHEN {t.any_of('lower(text)', kws)} THEN {t.text(name)} END" for name, kws in vocab.SEARCH_RULES
)
BENCHMARK = "(SELECT item_id AS id, text FROM benchmark)"
QUERIES_TEMPLATE = f"""
q AS (SELECT id, text, {t.normalized('text')} AS norm_text, lower(text) AS low,
      list_filter([{_wanted}], lambda x: x IS NOT NULL) AS wanted FROM <source>),
q_terms AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(string_split(norm_text, ' ')) AS term FROM q) WHERE length(term) >= 2),
q_long AS (SELECT DISTINCT id, tok FROM (SELECT id, unnest(string_split({t.collapse('low')}, ' ')) AS tok FROM q) WHERE length(tok) >= 4),
{hashed('qv', '(SELECT id, text FROM q)')}"""
QUERIES_SQL = QUERIES_TEMPLATE.replace("<source>", BENCHMARK)

CHUNK_SIDE = f"""
kc AS (SELECT content_hash AS id, content AS text, * FROM chunks),
c_terms AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(string_split(search_text, ' ')) AS term FROM kc) WHERE length(term) >= 2),
{hashed('cv', '(SELECT id, text FROM kc)')},
cosines AS (SELECT qv_vec.id AS qid, cv_vec.id AS cid, round(sum(qv_vec.w * cv_vec.w) / (max(cv_vec.norm) * max(qv_vec.norm)), 6) AS base
  FROM qv_vec JOIN cv_vec ON cv_vec.dim = qv_vec.dim GROUP BY 1, 2),
shared AS (SELECT a.id AS qid, b.id AS cid, count(*) AS n FROM q_terms a JOIN c_terms b ON b.term = a.term GROUP BY 1, 2),
words AS (SELECT q.id AS qid, kc.id AS cid, coalesce(s.n, 0) + CASE WHEN contains(kc.search_text, q.norm_text) THEN 2.0 ELSE 0.0 END AS lexical
  FROM q CROSS JOIN kc LEFT JOIN shared s ON s.qid = q.id AND s.cid = kc.id),
scored AS (SELECT w.qid, w.cid, coalesce(c.base, 0.0) AS base, CAST(w.lexical AS DOUBLE) AS lexical
  FROM words w LEFT JOIN cosines c ON c.qid = w.qid AND c.cid = w.cid)"""

FOUND = f"""
found AS (
  SELECT * FROM (SELECT qid, cid, base, lexical, 'vector' AS channel, row_number() OVER (PARTITION BY qid ORDER BY base DESC, cid) AS rn FROM scored) WHERE rn <= 30
  UNION ALL
  SELECT * FROM (SELECT qid, cid, base, lexical, 'lexical' AS channel, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, cid) AS rn FROM scored WHERE lexical > 0) WHERE rn <= 30)"""


def _site_sql() -> str:
    profile = PROFILES[0]
    configured = "(len(list_filter(site_aliases, lambda a: contains(hay, lower(a)))) > 0)"
    arms = []
    for p in (profile, ops.SiteProfile("")):
        usable = "pid = 'src1'" if p.site_id else "pid IS NULL AND len(site_aliases) > 0"
        alias = f"({configured}" + (f" OR {t.any_of('hay', p.aliases)})" if p.aliases else ")")
        off_query = t.any_of("low", p.off_topic) if p.off_topic else "FALSE"
        parts = [f"CASE WHEN {alias} THEN 0.85 ELSE 0 END"]
        if p.url_markers:
            parts.append(f"CASE WHEN {t.any_of('lower(source_url)', p.url_markers)} THEN 0.45 ELSE 0 END")
        home = t.any_of("low", tuple(HOME.letters) + tuple(HOME.words))
        parts.append(f"CASE WHEN language = '{HOME.code}' AND {home} THEN 0.12 ELSE 0 END")
        if p.offer_path:
            parts.append(f"CASE WHEN contains(lower(source_url), '{p.offer_path}') AND NOT {alias} THEN -0.35 ELSE 0 END")
        if p.off_topic:
            parts.append(f"CASE WHEN {t.any_of('hay', p.off_topic)} AND NOT {alias} THEN -0.70 ELSE 0 END")
        arms.append(f"WHEN {usable} AND NOT {off_query} THEN " + " + ".join(parts))
    return "CASE " + " ".join(arms) + " ELSE 0 END"


_keyword_sql = " + ".join(
    f"CASE WHEN list_contains(wanted, '{name}') THEN CASE WHEN category = '{name}' THEN 0.45 ELSE 0 END + "
    f"CASE WHEN {t.any_of('hay', kws)} THEN 0.25 ELSE 0 END ELSE 0 END"
    for name, kws in vocab.SEARCH_RULES
)
_pid = (
    "CASE WHEN lower(site_id) = 'src1' OR "
    + t.any_of("hay || ' ' || lower(source_url)", PROFILES[0].aliases + PROFILES[0].url_markers)
    + " THEN 'src1' END"
)
_alias_list = "[" + ", ".join(t.text(a) for a in ALIASES) + "]"
SITES_SQL = f"sites AS (SELECT 'src' || n_nationkey AS site_id, [lower(n_name), {_alias_list}[n_regionkey + 1]] AS site_aliases FROM nation)"


def boosts_sql(source: str, name: str) -> str:
    """CTEs adding ``kw``, ``site`` and ``adjusted`` to (qid, cid, base, lexical, ...) rows."""
    return f"""
{name}_hay AS (SELECT f.*, k.category, k.site_id, k.source_url, k.language, q.low, q.wanted, coalesce(s.site_aliases, []) AS site_aliases,
   lower(k.title || ' ' || k.section || ' ' || k.category || ' ' || k.content || ' ' || k.source_url) AS hay
   FROM {source} f JOIN kc k ON k.id = f.cid JOIN q ON q.id = f.qid LEFT JOIN sites s ON s.site_id = k.site_id),
{name}_long AS (SELECT h.qid, h.cid, count(*) AS n FROM (SELECT DISTINCT qid, cid, hay FROM {name}_hay) h JOIN q_long l ON l.id = h.qid WHERE contains(h.hay, l.tok) GROUP BY 1, 2),
{name}_kw AS (SELECT h.*, CAST({_keyword_sql} + 0.03 * coalesce(l.n, 0) AS DOUBLE) AS kw, {_pid} AS pid
   FROM {name}_hay h LEFT JOIN {name}_long l ON l.qid = h.qid AND l.cid = h.cid),
{name}_site AS (SELECT *, CAST({_site_sql()} AS DOUBLE) AS site FROM {name}_kw),
{name} AS (SELECT *, round(base + kw + site, 6) AS adjusted FROM {name}_site)"""


FUSION = """
confident AS (SELECT *, round(adjusted + CASE WHEN channel = 'lexical' THEN least(greatest(lexical, 0) * 0.08, 0.30) ELSE 0 END, 6) AS confidence FROM boosted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY confidence DESC, cid) AS crank FROM confident),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fusion_score DESC, cid) AS fused_rank FROM (
   SELECT qid, cid, max(confidence) AS score, round(sum(1.0::DOUBLE / (60 + crank)), 9) AS fusion_score FROM ranked GROUP BY qid, cid)),
fused_cut AS (SELECT f.*, k.category, k.source_url, q.wanted FROM fused f JOIN kc k ON k.id = f.cid JOIN q ON q.id = f.qid WHERE fused_rank <= 30),
placed AS (SELECT *, CASE WHEN list_contains(wanted, category) AND row_number() OVER (PARTITION BY qid, category ORDER BY fused_rank) = 1
   THEN list_position(wanted, category) END AS place FROM fused_cut),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place NULLS LAST, fused_rank) AS rank FROM placed) WHERE rank <= 5)"""


def search_sql(
    tail: str, mode: str = "per_channel", scope: str = "", source: str = BENCHMARK, before: str = "", after: str = "",
    found: str = FOUND,
) -> str:
    """A full search over the queries of ``source``; ``before`` and ``after`` are further CTEs."""
    if mode == "per_channel":
        body = found + ", " + boosts_sql("found", "boosted") + ", " + FUSION
    else:
        full = boosts_sql("scored", "full_rows")
        both = """
boosted AS (SELECT *, 'vector' AS channel FROM full_rows UNION ALL SELECT *, 'lexical' FROM full_rows WHERE lexical > 0)"""
        body = full + ", " + both + ", " + FUSION
    side = CHUNK_SIDE.replace("* FROM chunks)", f"* FROM chunks {scope})")
    asked = QUERIES_TEMPLATE.replace("<source>", source)
    return t.with_chunks(tail, f"{before}, {SITES_SQL}, {asked}, {side}, {body}{after}")


# --- embeddings ------------------------------------------------------------------------------


@query(
    "v1_hashed_embedding",
    f"""WITH {hashed('dv', '(SELECT doc_id AS id, text FROM documents)')}
        SELECT id AS doc_id, CAST(dim AS BIGINT) AS dim, round(w / norm, 9) AS weight FROM dv_vec""",
)
def v1(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return vec.hashed_terms(docs, "doc_id", "text").select(
        "doc_id", F.col("dim").cast("long"), F.round("weight", 9).alias("weight")
    )


_CENTERS = """
dims AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
centers AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM dims GROUP BY 1, 2),
center_norm AS (SELECT label, sqrt(sum(x * x)) AS norm FROM centers GROUP BY 1),
row_norm AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm FROM dims GROUP BY 1),
sims AS (SELECT c.label AS query_id, d.vec_id, round(sum(c.x * CAST(d.x AS DOUBLE)) / (max(r.norm) * max(n.norm)), 6) AS score
  FROM centers c JOIN dims d ON d.dim = c.dim JOIN center_norm n ON n.label = c.label JOIN row_norm r ON r.vec_id = d.vec_id GROUP BY 1, 2)"""


@query(
    "v2_vector_topk",
    f"""WITH {_CENTERS} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM sims) WHERE rank <= 10""",
)
def v2(spark, folder):
    found = vec.vector_topk(centroids(spark, folder), dense(spark, folder), 10)
    return found.withColumn("rank", F.col("rank").cast("long"))


SAMPLED = "vec_id % 25 = 0"  # the query set of the searches by cell


def sampled(spark, folder):
    """Every 25th vector as a query, against all."""
    few = table(spark, folder, "embeddings").where(SAMPLED).withColumn("query_id", F.col("vec_id"))
    return vec.dense_as_sparse(few, "query_id", "embedding")


_SAMPLED_SQL = f"""
unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
cosine AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(q.v, u.v), 6) AS score FROM unit q, unit u WHERE q.{SAMPLED})"""
_NEAREST_SQL = """SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, score, row_number() OVER w AS rank FROM {source}
  WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) QUALIFY row_number() OVER w <= 10"""


@query("v3_cells_exact", f"WITH {_SAMPLED_SQL} {_NEAREST_SQL.format(source='cosine')}")
def v3_exact(spark, folder):
    """Exact top 10 by cells: bounds decide which cells need not be read."""
    found = cells.search_lists(sampled(spark, folder), cells.build_lists(dense(spark, folder)), 10, probes=4, exact=True)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "v3_cells_given_centres",
    f"""WITH {_SAMPLED_SQL}, {_CENTERS.strip()},
centre AS (SELECT label, list(x ORDER BY dim) AS c FROM centers GROUP BY label),
near AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, c) DESC, label) AS place FROM unit, centre),
held AS (SELECT DISTINCT label FROM near WHERE place = 1),
probed AS (SELECT vec_id AS query_id, label FROM near JOIN held USING (label) WHERE vec_id % 25 = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY place) <= 3),
met AS (SELECT c.* FROM cosine c JOIN probed p ON p.query_id = c.query_id JOIN near n ON n.vec_id = c.vec_id AND n.place = 1 AND n.label = p.label)
{_NEAREST_SQL.format(source='met')}""",
)
def v3_given(spark, folder):
    """Top 10 of the three nearest of given cells, whose centres are the label means."""
    means = centroids(spark, folder).orderBy("query_id").select("weights").toPandas()  # one row a label
    stored = cells.build_lists(dense(spark, folder), centres=list(means["weights"]))
    found = cells.search_lists(sampled(spark, folder), stored, 10, probes=3)
    return found.withColumn("rank", F.col("rank").cast("long"))


def half_of(stored: cells.VectorLists) -> int:
    """Half of the cells; the sample vectors are nearly random in their dimensions, so fewer would miss the recall."""
    return -(-len(stored.centres) // 2)


@query("v3_vector_topk_cells")
def v3(spark, folder):
    """Approximate top 10 with its recall against the exact one, per query."""
    vectors, asked = dense(spark, folder), materialized(centroids(spark, folder), "centroids")
    stored = cells.build_lists(vectors)
    near = cells.search_lists(asked, stored, 10, probes=half_of(stored))
    exact = vec.vector_topk(asked, vectors, 10).select("query_id", "chunk_id", F.lit(1).alias("exact"))
    return (
        exact.join(near.select("query_id", "chunk_id", F.lit(1).alias("near")), ["query_id", "chunk_id"], "full")
        .groupBy("query_id")
        .agg(F.count("near").alias("returned"), (F.count(F.expr("near + exact")) / F.count("exact")).alias("recall"))
    )


@query(
    "v4_embed_distinct",
    f"""WITH {hashed('dv', '(SELECT sha256(text) AS id, min(text) AS text FROM documents GROUP BY 1)')},
        per AS (SELECT id, count(*) AS nonzero, round(max(norm), 6) AS norm FROM dv_vec GROUP BY id)
        SELECT d.doc_id, p.nonzero, p.norm FROM documents d JOIN per p ON p.id = sha256(d.text)""",
)
def v4(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return vec.embed_distinct(docs, "text").select(
        "doc_id", F.size("dims").cast("long").alias("nonzero"), F.round("norm", 6).alias("norm")
    )


@query(
    "j9_strict_zip",
    f"""WITH {hashed('dv', '(SELECT doc_id AS id, text FROM documents)')}
        SELECT d.doc_id, count(*) AS nonzero FROM documents d JOIN dv_vec v ON v.id = d.doc_id GROUP BY d.doc_id""",
)
def j9(spark, folder):
    """Vectors joined one to one to their rows; a missing or doubled vector fails the job."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vectors = vec.with_vectors(docs, "text").groupBy("doc_id").agg(
        F.count("*").alias("copies"), F.max(F.size("dims")).cast("long").alias("nonzero")
    )
    joined = docs.select("doc_id").join(vectors, "doc_id", "left")
    checked = F.when(F.col("copies") == 1, F.col("nonzero")).otherwise(
        F.raise_error(F.lit("each row needs exactly one vector"))
    )
    return joined.select("doc_id", checked.cast("long").alias("nonzero"))


# --- lexical ---------------------------------------------------------------------------------


@query(
    "l3_query_context",
    f"""WITH {QUERIES_SQL} SELECT q.id AS query_id, norm_text AS normalized, array_to_string(wanted, '|') AS wanted,
        (SELECT count(*) FROM q_terms t WHERE t.id = q.id) AS n_terms FROM q""",
)
def l3(spark, folder):
    return ops.prepare_queries(questions(spark, folder)).select(
        "query_id", "normalized", F.array_join("wanted", "|").alias("wanted"), F.size("terms").cast("long").alias("n_terms")
    )


def _prepared(spark, folder, least_chars=2):
    return _asked(ops.prepare_queries(questions(spark, folder), least_chars=least_chars))


def _asked(prepared):
    return prepared.withColumn("vector_text", F.col("raw"))


_side = t.with_chunks("{tail}", f", {QUERIES_SQL}, {CHUNK_SIDE.split('cosines AS')[0].rstrip().rstrip(',')}, shared AS {CHUNK_SIDE.split('shared AS')[1].split('scored AS')[0].rstrip().rstrip(',')}")


@query(
    "l1_token_overlap",
    _side.replace("{tail}", """SELECT qid AS query_id, cid AS chunk_id, CAST(lexical AS DOUBLE) AS lexical, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, cid) AS rank FROM words WHERE lexical > 0) WHERE rank <= 20"""),
)
def l1(spark, folder):
    asked = ops.prepare_queries(questions(spark, folder))
    chunks = searchable(spark, folder)
    found = lists.token_overlap(asked, chunks, lists.build_postings(chunks), 20)
    return found.select("query_id", "chunk_id", "lexical", F.col("rank").cast("long"))


#: ``dens(qid, cid, density)``: cover density of the chunks that hold every word of a benchmark text.
DENSITY_SQL = f"""
q1 AS (SELECT item_id AS id, string_split({t.normalized('text')}, ' ') AS ws FROM benchmark),
qt AS (SELECT DISTINCT id, unnest(ws) AS term FROM q1),
qn AS (SELECT id, count(*) AS n FROM qt GROUP BY id),
pos AS (SELECT content_hash AS cid, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM (SELECT content_hash, string_split(search_text, ' ') AS w FROM chunks)),
occ AS (SELECT qt.id AS qid, pos.cid, pos.term, pos.p FROM pos JOIN qt ON qt.term = pos.term),
full_match AS (SELECT qid, cid, n FROM (SELECT qid, cid, count(DISTINCT term) AS m FROM occ GROUP BY 1, 2) JOIN qn ON qn.id = qid WHERE m = n),
o2 AS (SELECT o.* FROM occ o JOIN full_match f ON f.qid = o.qid AND f.cid = o.cid),
lasts AS (SELECT e.qid, e.cid, e.p AS e, s.term, max(s.p) AS lp FROM o2 e JOIN o2 s ON s.qid = e.qid AND s.cid = e.cid AND s.p <= e.p GROUP BY 1, 2, 3, 4),
spans AS (SELECT l.qid, l.cid, l.e, min(l.lp) AS s FROM lasts l JOIN full_match f ON f.qid = l.qid AND f.cid = l.cid GROUP BY 1, 2, 3 HAVING count(*) = max(f.n)),
covers AS (SELECT qid, cid, s, min(e) AS e FROM spans GROUP BY 1, 2, 3),
dens AS (SELECT c.qid, c.cid, round(sum(0.1::DOUBLE / (1 + (c.e - c.s) - (f.n - 1))), 9) AS density FROM covers c JOIN full_match f ON f.qid = c.qid AND f.cid = c.cid GROUP BY 1, 2)"""


@query(
    "l2_all_terms",
    t.with_chunks(
        """SELECT qid AS query_id, cid AS chunk_id, density, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY qid ORDER BY density DESC, cid) AS rank FROM dens) WHERE rank <= 20""",
        f",{DENSITY_SQL}",
    ),
)
def l2(spark, folder):
    chunks = searchable(spark, folder)
    asked = ops.prepare_queries(questions(spark, folder), least_chars=1)
    found = lists.all_terms(asked, chunks, lists.build_postings(chunks), 20)
    return found.select(
        "query_id", "chunk_id", F.col("lexical").alias("density"), F.col("rank").cast("long")
    )


# --- boosts and fusion -----------------------------------------------------------------------


def candidate_pairs(spark, folder):
    """The 30 best chunks per query and channel with their text, before any boost."""
    chunks = stored_chunks(spark, folder)
    found = scan_topk(ops.chunk_vectors(chunks), _prepared(spark, folder), 30, lexical="overlap")
    # The few candidates travel to the chunks, whose texts stay where they are.
    detailed = ops.with_details(found.drop("confidence", "rank"), chunks, [
        "chunk_id", "site_id", "title", "section", "category", "content", "source_url", "language"])
    asked = ops.prepare_queries(questions(spark, folder)).select("query_id", "lower", "long_tokens", "wanted")
    return ops.with_site_aliases(detailed, site_table(spark, folder)).join(asked, "query_id")


@query("f1_keyword_boost", search_sql("SELECT qid AS query_id, channel, cid AS chunk_id, round(kw, 6) AS boost FROM boosted"))
def f1(spark, folder):
    pairs = candidate_pairs(spark, folder).withColumn("hay", ops.haystack())
    return pairs.select("query_id", "channel", "chunk_id", F.round(ops.keyword_boost(), 6).alias("boost"))


@query("f2_site_boost", search_sql("SELECT qid AS query_id, channel, cid AS chunk_id, round(site, 6) AS boost FROM boosted"))
def f2(spark, folder):
    pairs = candidate_pairs(spark, folder).withColumn("hay", ops.haystack())
    pairs = pairs.withColumn("profile_id", ops.profile_id(PROFILES, F.col("hay")))
    return pairs.select("query_id", "channel", "chunk_id", F.round(ops.site_boost(PROFILES, HOME), 6).alias("boost"))


def confident_pairs(spark, folder):
    return ops.relevance(candidate_pairs(spark, folder), PROFILES, home=HOME)


@query("f3_confidence", search_sql("SELECT qid AS query_id, channel, cid AS chunk_id, confidence FROM confident"))
def f3(spark, folder):
    return confident_pairs(spark, folder).select("query_id", "channel", "chunk_id", "confidence")


@query(
    "w1_channel_rank",
    search_sql("SELECT qid AS query_id, channel, cid AS chunk_id, crank AS channel_rank FROM ranked"),
)
def w1(spark, folder):
    return ops.channel_ranks(confident_pairs(spark, folder)).select(
        "query_id", "channel", "chunk_id", F.col("channel_rank").cast("long")
    )


@query(
    "f4_rrf",
    search_sql("SELECT qid AS query_id, cid AS chunk_id, score, fusion_score, fused_rank FROM fused WHERE fused_rank <= 30"),
)
def f4(spark, folder):
    fused = ops.rrf(ops.channel_ranks(confident_pairs(spark, folder)), 30)
    return fused.select("query_id", "chunk_id", "score", "fusion_score", F.col("fused_rank").cast("long"))


@query(
    "o5_channel_union",
    search_sql("SELECT qid AS query_id, channel, count(*) AS candidates, round(max(base), 6) AS top_base FROM found GROUP BY 1, 2"),
)
def o5(spark, folder):
    chunks = ops.chunk_vectors(keyed_chunks(spark, folder))
    found = scan_topk(chunks, _prepared(spark, folder), 30, lexical="overlap")
    return found.groupBy("query_id", "channel").agg(
        F.count("*").alias("candidates"), F.round(F.max("base"), 6).alias("top_base")
    )


@query(
    "o6_no_tokens",
    search_sql("SELECT qid AS query_id, channel, count(*) AS candidates FROM found WHERE channel = 'vector' GROUP BY 1, 2"),
)
def o6(spark, folder):
    """Queries reduced to marks have no words: the lexical channel is empty, the vector one is not."""
    blanked = ops.prepare_queries(questions(spark, folder))
    blanked = blanked.withColumn("normalized", F.lit("")).withColumn("terms", F.array().cast("array<string>"))
    found = scan_topk(
        ops.chunk_vectors(keyed_chunks(spark, folder)), _asked(blanked), 30, lexical="overlap"
    )
    return found.groupBy("query_id", "channel").agg(F.count("*").alias("candidates"))


def _hits_of(spark, folder, chunks, **options):
    return ops.hybrid_search(
        questions(spark, folder), chunks, site_table(spark, folder), profiles=PROFILES, home=HOME, **options
    )


def _hits(spark, folder, **options):
    return _hits_of(spark, folder, stored_chunks(spark, folder), **options)


_HIT_SQL = "SELECT qid AS query_id, rank, cid AS chunk_id, category, source_url, score, fusion_score FROM hits"


def _hit_view(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long"), "chunk_id", "category", "source_url", "score", "fusion_score"
    )


@query("f6_hybrid_search", search_sql(_HIT_SQL))
def f6(spark, folder):
    return _hit_view(_hits(spark, folder))


@query("f6_hybrid_search_full_rank", search_sql(_HIT_SQL, "all"))
def f6_all(spark, folder):
    return _hit_view(_hits(spark, folder, candidate_mode="all"))


def indexed(spark, folder):
    """The chunk table with its inverted table and its vector lists, as a deployment stores them."""
    chunks = stored_chunks(spark, folder)
    return chunks, lists.build_postings(chunks.select("chunk_id", "search_text")), cells.build_lists(
        chunks.select("chunk_id", F.col("content").alias("vector_text")))


def _indexed_hits(spark, folder, tables, **options):
    chunks, postings, vector_lists = tables
    return ops.hybrid_search(
        questions(spark, folder), chunks, site_table(spark, folder), profiles=PROFILES, home=HOME, postings=postings,
        vector_lists=vector_lists, **options)


@query("f6_hybrid_search_index", search_sql(_HIT_SQL))
def f6_index(spark, folder):
    """The hits of the scan from the stored tables: cells are read until their bounds say that none is missed."""
    return _hit_view(_indexed_hits(spark, folder, indexed(spark, folder)))


_density_channel = FOUND.replace("FROM scored WHERE lexical > 0", "FROM (SELECT s.* REPLACE (d.density AS lexical) FROM scored s JOIN dens d USING (qid, cid))")


@query(
    "f6_hybrid_search_all_terms",
    search_sql(_HIT_SQL, found=f"{DENSITY_SQL},{_density_channel}"),
)
def f6_all_terms(spark, folder):
    """The stored mode: words match if a chunk holds all of them, ranked by cover density."""
    return _hit_view(_indexed_hits(spark, folder, indexed(spark, folder), lexical="all_terms"))


@query("f6_hybrid_search_cells")
def f6_cells(spark, folder):
    """Hits from a fixed number of cells, with the share of the exact vector channel and of the exact hits found."""
    chunks, postings, vector_lists = tables = indexed(spark, folder)
    asked = vec.with_vectors(_prepared(spark, folder), "raw")
    probes = half_of(vector_lists)
    cut = ops.candidate_limit(5)

    def share(near, exact, name):
        both = exact.join(near.select("query_id", "chunk_id", F.lit(1).alias("near")), ["query_id", "chunk_id"], "left")
        return both.groupBy("query_id").agg((F.count("near") / F.count("*")).alias(name))

    near = materialized(cells.search_lists(asked, vector_lists, cut, probes=probes), "near")
    channel = share(near, cells.search_lists(asked, vector_lists, cut, probes=probes, exact=True, near=near), "channel_recall")
    hits = materialized(_indexed_hits(spark, folder, tables, probes=probes, exact=False, near=near), "hits")
    exact = materialized(_hits_of(spark, folder, chunks), "exact-hits")
    return _hit_view(hits).join(share(hits, exact, "hit_recall"), "query_id").join(channel, "query_id")


@query("f6_hybrid_search_site", search_sql(_HIT_SQL, scope="WHERE site_id = 'src3'"))
def f6_site(spark, folder):
    return _hit_view(_hits(spark, folder, site_id="src3"))


@query(
    "f5_diversify",
    search_sql("SELECT qid AS query_id, cid AS chunk_id, rank, fused_rank, category FROM hits"),
)
def f5(spark, folder):
    ranked = materialized(ops.channel_ranks(confident_pairs(spark, folder)).drop("content"), "ranked")
    category = ranked.select("query_id", "chunk_id", "category", "wanted").dropDuplicates(["query_id", "chunk_id"])
    hits = ops.diversify(ops.rrf(ranked, 30).join(category, ["query_id", "chunk_id"]), 5)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("fused_rank").cast("long"), "category")


@query(
    "f7_retrieval_summary",
    search_sql("""SELECT q.id AS query_id, count(h.cid) AS hit_count, max(h.score) AS top_score, min_by(h.category, h.rank) AS top_category,
        min_by(h.source_url, h.rank) AS top_source_url, coalesce(max(h.score), 0) AS confidence FROM q LEFT JOIN hits h ON h.qid = q.id GROUP BY q.id"""),
)
def f7(spark, folder):
    return ops.retrieval_summary(questions(spark, folder), _hits(spark, folder))


@query(
    "a12_top_confidence",
    search_sql("SELECT q.id AS query_id, coalesce(max(h.score), 0) AS confidence FROM q LEFT JOIN hits h ON h.qid = q.id AND h.category = 'offer' GROUP BY q.id"),
)
def a12(spark, folder):
    """Best confidence among offer hits, 0 where a query has none."""
    offers = _hits(spark, folder).filter("category = 'offer'").groupBy("query_id").agg(F.max("score").alias("s"))
    return questions(spark, folder).join(offers, "query_id", "left").select(
        "query_id", F.coalesce("s", F.lit(0.0)).alias("confidence")
    )


@query(
    "q15_distinct_questions",
    search_sql("""SELECT q2.id AS query_id, h.rank, h.cid AS chunk_id, h.score FROM hits h JOIN (
        SELECT item_id * 2 + 1 AS id, item_id AS src FROM benchmark UNION ALL SELECT item_id * 2, item_id FROM benchmark) q2 ON q2.src = h.qid"""),
)
def q15(spark, folder):
    """Every question asked twice, once in other spacing and case; each is searched once."""
    asked = questions(spark, folder)
    shouted = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    twice = asked.select((F.col("query_id") * 2).alias("query_id"), "text").unionByName(
        asked.select((F.col("query_id") * 2 + 1).alias("query_id"), F.concat(F.lit("  "), shouted).alias("text"))
    )
    chunks = stored_chunks(spark, folder)
    # One row: the state of the documents that the answers are found in.
    state = rollups.doc_set_hash(chunks.select(F.col("chunk_id").alias("content_hash"))).first()["doc_set_hash"]
    scoped = twice.withColumn("site_id", F.lit(None).cast("string")).withColumn("doc_set_hash", F.lit(state))

    def search(distinct):
        return ops.hybrid_search(
            distinct.select("query_id", "text"), chunks, site_table(spark, folder), profiles=PROFILES, home=HOME
        )

    return ops.deduplicated_search(scoped, search).select("query_id", F.col("rank").cast("long"), "chunk_id", "score")


@query(
    "w2_top_per_site",
    t.with_chunks("""SELECT site_id, content_hash AS chunk_id, rank FROM (SELECT *, row_number() OVER (
        PARTITION BY site_id ORDER BY length(content) DESC, content_hash) AS rank FROM chunks) WHERE rank <= 5"""),
)
def w2(spark, folder):
    order = [F.desc(F.length("content")), F.asc("chunk_id")]
    return top_k(keyed_chunks(spark, folder), ["site_id"], order, 5).select(
        "site_id", "chunk_id", F.col("rank").cast("long")
    )


@query(
    "w3_first_per_category",
    t.with_chunks("""SELECT site_id, category, content_hash AS chunk_id FROM (SELECT *, row_number() OVER (
        PARTITION BY site_id, category ORDER BY crawled_at DESC, content_hash) AS rn FROM chunks) WHERE rn = 1"""),
)
def w3(spark, folder):
    return first_per(keyed_chunks(spark, folder), ["site_id", "category"], [F.desc("crawled_at"), F.asc("chunk_id")]).select(
        "site_id", "category", "chunk_id"
    )


@query(
    "j1_site_aliases",
    t.with_chunks(
        """SELECT c.site_id, count(*) AS chunks, coalesce(array_to_string(any_value(s.site_aliases), '|'), '') AS aliases
           FROM chunks c LEFT JOIN (SELECT 'src' || n_nationkey AS site_id, [lower(n_name)] AS site_aliases FROM nation WHERE n_regionkey <> 0) s ON s.site_id = c.site_id GROUP BY c.site_id""",
        f", {SITES_SQL}",
    ),
)
def j1(spark, folder):
    """Sites of one region are not configured, so their chunks get an empty alias list."""
    sites = table(spark, folder, "nation").filter("n_regionkey <> 0").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("site_id"),
        F.array(F.lower("n_name")).alias("site_aliases"),
    )
    joined = ops.with_site_aliases(document_chunks(spark, folder).select("site_id"), sites)
    return joined.groupBy("site_id").agg(
        F.count("*").alias("chunks"), F.array_join(F.any_value("site_aliases"), "|").alias("aliases")
    )
