"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.llm import (
    cascade, exact_dedup, hard_negatives, katz, langid, mixing, multi_index, ngram_join, pieces, quality, url_lists, warc, whitening,
)
from sagewell.llm.shared import fold, prepare, stored
from sagewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPACES = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def register(job):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(prepare(spark), folder)

        run.__name__, run.__doc__ = name, job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


@query("op1_exact_dedup", f"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS sha
  FROM documents),
r AS (
  SELECT doc_id, sha,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM r
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's piece ids, of their decoding and of their spans in the original."""
    return pieces.encode(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("digests",))


@query("op3_ngram_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return ngram_join.similar_documents(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "class_size", "n_links")


@query("op4_katz_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability under a Katz model of nine tenths of the corpus."""
    return katz.katz_scores(table(spark, folder, "documents"), fold("doc_id", 10) == 0)


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, bytes, hex, max(page_id) OVER (PARTITION BY hex) AS best FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    ((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back along verified record boundaries."""
    return warc.archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's calibrated quality score; the folds 1 to 4 train, of which fold 1 calibrates."""
    stats = stored(
        quality.document_statistics(table(spark, folder, "documents"), fold("doc_id", 5)), "quality-stats")
    labels = quality.labels_of(table(spark, folder, "labels"))
    known = stored(
        stats.where("fold <> 0").join(labels, F.col("doc_id") == F.col("labelled_id")).select("fold", "stats", "label"),
        "quality-train")
    model = quality.fit(known.where("fold <> 1"), known.where("fold = 1"))
    return quality.score(stats, model).select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP7_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2026-01-01' + to_minutes((page_id * 7919) % 129600) AS fetched_at,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
s AS (SELECT DISTINCT host || '/' || list_filter(string_split(path, '/'), lambda x: x <> '')[1] AS key FROM c
      WHERE host <> '' AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 0),
k AS (
  SELECT host AS key, 'host' AS kind FROM h UNION ALL
  SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') || '', 'site' FROM h
    WHERE len(string_split(host, '.')) > 3 UNION ALL
  SELECT key, 'path' FROM s),
d AS (SELECT key, kind, CAST(('0x' || substr(md5(key), 1, 6))::BIGINT AS BIGINT) AS v FROM k),
e AS (
  SELECT key, CASE WHEN kind = 'path' THEN 'allow' ELSE 'block' END AS action,
         TIMESTAMP '2026-01-01' + to_minutes(v % 64800) AS at_ FROM d WHERE v % 3 <> 0 UNION ALL
  SELECT key, 'remove', TIMESTAMP '2026-01-01' + to_minutes(v % 64800 + 7200 + v % 14400) FROM d WHERE v % 3 <> 0 UNION ALL
  SELECT key, 'block', TIMESTAMP '2026-01-01' + to_minutes(v % 64800 + 43200) FROM d WHERE v % 5 = 0),
g AS (SELECT key, at_, arg_max(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action
      FROM e GROUP BY key, at_),
i AS (SELECT key, action, at_ AS valid_from, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS valid_to FROM g),
x AS (
  SELECT page_id, i.key, i.action, i.valid_from, i.valid_to,
         row_number() OVER (PARTITION BY page_id ORDER BY length(i.key) DESC) AS rn
  FROM c JOIN i ON i.action <> 'remove' AND c.fetched_at >= i.valid_from
    AND (i.valid_to IS NULL OR c.fetched_at < i.valid_to)
    AND c.host <> '' AND (i.key = c.host OR ends_with(c.host, '.' || i.key)
      OR starts_with(array_to_string(list_concat([c.host], list_filter(string_split(c.path, '/'), lambda x: x <> '')), '/') || '/',
                     i.key || '/')))
SELECT c.page_id, CASE WHEN c.host <> '' THEN c.host END AS host, c.fetched_at,
  coalesce(x.action, 'unlisted') AS decision, x.key AS matched_key, x.valid_from, x.valid_to
FROM c LEFT JOIN x ON x.page_id = c.page_id AND x.rn = 1
"""


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as captures; the table has no fetch times, so the id spreads them over ninety days."""
    return table(spark, folder, "pages").select("page_id", "url", F.expr(
        "TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast((page_id * 7919) % 129600 as int))"
    ).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts, sites and first path parts of the pages, spread by a hash of the key."""
    seen = pages.select(url_lists.host_of("url").alias("host"), url_lists.path_of("url").alias("path")).where("host <> ''")
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    hosts = seen.select("host").distinct()
    labels = F.split("host", r"\.")
    keys = (
        hosts.select(F.col("host").alias("key"), F.lit("host").alias("kind"))
        .unionByName(hosts.where(F.size(labels) > 3).select(
            F.array_join(F.slice(labels, -3, 3), ".").alias("key"), F.lit("site").alias("kind")).distinct())
        .unionByName(seen.where(F.size(parts) > 0).select(
            F.concat("host", F.lit("/"), F.get(parts, 0)).alias("key"), F.lit("path").alias("kind")).distinct())
        .withColumn("v", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long"))
    )
    first = F.when(F.col("kind") == "path", "allow").otherwise("block")
    dated = keys.select("key", F.explode(F.array(
        F.struct(first.alias("action"), (F.col("v") % 64800).alias("minute"), (F.col("v") % 3 != 0).alias("used")),
        F.struct(F.lit("remove").alias("action"), (F.col("v") % 64800 + 7200 + F.col("v") % 14400).alias("minute"),
                 (F.col("v") % 3 != 0).alias("used")),
        F.struct(F.lit("block").alias("action"), (F.col("v") % 64800 + 43200).alias("minute"),
                 (F.col("v") % 5 == 0).alias("used")))).alias("e")).where("e.used")
    return dated.select("key", F.col("e.action").alias("action"), F.expr(
        "TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(e.minute as int))").alias("at"))


@query("op7_url_lists", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every page capture judged by the list entries active when it was fetched."""
    return url_lists.evaluate(captures(spark, folder), list_entries(table(spark, folder, "pages")))


@query("op8_multi_index")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest found of every vector whose id is divisible by 20."""
    vectors = multi_index.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    book = multi_index.fit(vectors)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = multi_index.build(vectors, book)
    return multi_index.search(index, book, index.where("vec_id % 20 = 0").select("vec_id", "vector"))


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language; documents of fold 2 of 4 are held out of training."""
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2).select("lang", "text"))
    return langid.identify(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


#: Target weights of the mix, all whole numbers: sources by the tier in their number, languages, then sources.
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def mix_levels() -> dict:
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return {"domain": F.concat(F.lit("domain"), (number % 3).cast("string")), "lang": F.col("lang"),
            "source": F.col("source")}


def mix_weights() -> list:
    domain = F.when(F.col("mix_domain") == "domain0", 2).when(F.col("mix_domain") == "domain1", 3).otherwise(5)
    lang = F.lit(1)
    for name, weight in LANGUAGE_WEIGHTS.items():
        lang = F.when(F.col("mix_lang") == name, weight).otherwise(lang)
    return [domain, lang, F.lit(1)]


def _level_sql(depth: int, parent: str) -> str:
    """One level of budgeting: siblings that cannot spend their share leave it to the others."""
    path = ["domain", "lang", "source"][: depth + 1]
    keys, up = ", ".join(path), ", ".join(path[:-1])
    over = f"PARTITION BY {up}" if up else ""
    join = f"JOIN {parent} USING ({up})" if up else f"CROSS JOIN {parent}"
    return f"""
l{depth}a AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, max(w{depth}) AS w FROM leaf GROUP BY {keys}),
l{depth}b AS (SELECT l{depth}a.*, b,
    CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS before,
    CAST(sum(w) OVER ({over}) - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest
  FROM l{depth}a {join}
  WINDOW o AS ({over} ORDER BY cap / w, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l{depth}c AS (SELECT *, cap * rest <= w * (b - before) AS full_ FROM l{depth}b),
l{depth}d AS (SELECT *, CAST(sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({over}) AS BIGINT) AS spent,
    CAST(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over}) AS BIGINT) AS open FROM l{depth}c),
b{depth} AS (SELECT {keys}, CASE WHEN full_ THEN cap ELSE least(cap, w * (b - spent) // open) END AS b FROM l{depth}d)"""


OP10_SQL = f"""
WITH t AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) % 3) AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL),
leaf AS (SELECT domain, lang, source, tokens * 3 AS cap,
    CASE domain WHEN 'domain0' THEN 2 WHEN 'domain1' THEN 3 ELSE 5 END AS w0,
    CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w1, 1 AS w2 FROM leaves),
root AS (SELECT CAST(least((SELECT sum(tokens) FROM leaves) // 2, sum(cap)) AS BIGINT) AS b FROM leaf),
{_level_sql(0, 'root')},{_level_sql(1, 'b0')},{_level_sql(2, 'b1')},
plan AS (SELECT domain, lang, source, b AS budget, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS whole,
    b - CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END * tokens AS rest FROM b2 JOIN leaves USING (domain, lang, source)),
o AS (SELECT doc_id, domain, lang, source, tokens, budget, whole, rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id, tokens
                      ROWS UNBOUNDED PRECEDING) AS reached
  FROM t JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens AS n_tokens, budget AS leaf_budget,
  CAST(CASE WHEN budget <= 0 THEN 0 ELSE whole + CASE WHEN reached <= rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM o
"""


@query("op10_mixture", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document enters a mix of half the corpus's tokens with set weights."""
    docs = stored(table(spark, folder, "documents").select(
        "doc_id", "lang", "source", mixing.word_count("text").alias("n_words")), "mix-words")
    mixed = mixing.mix(docs, mix_levels(), mix_weights(), tokens=F.col("n_words"))
    return mixed.select(
        "doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"),
        F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_budget").alias("leaf_budget"), F.col("mix_copies").alias("copies"))


@query("op11_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same,
         CAST(list_dot_product(a.v::DOUBLE[], e.v::DOUBLE[]) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Three negatives for each of the five positives of every vector whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.entries(table(spark, folder, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's coordinate along each of the leading components, one row a component."""
    rows = whitening.whole_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding")
    model = whitening.fit(rows)
    explained = F.array(*[F.lit(float(share)) for share in model.explained]).cast("array<double>")
    return whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))


@query("op13_quality_rules", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
m AS (
  SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
    len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) AS n_letterless,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals, len(regexp_extract_all(text, '\p{L}')) AS n_letters,
    len(regexp_extract_all(text, '[0-9]')) AS n_digits FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6),
    lambda i: array_to_string(words[i:i + 7], ' '))) AS gram FROM m WHERE len(words) >= 8),
r AS (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM g
      QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM r GROUP BY doc_id),
w AS (SELECT doc_id, max(c) AS top_word FROM (
      SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(words) AS w FROM m) GROUP BY ALL) GROUP BY doc_id),
p AS (SELECT doc_id, max(c) AS top_pair FROM (
      SELECT doc_id, p, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(words)),
        lambda i: words[i] || ' ' || words[i + 1])) AS p FROM m) GROUP BY ALL) GROUP BY doc_id),
a AS (
  SELECT m.*, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(top_word, 0) AS top_word,
         coalesce(top_pair, 0) AS top_pair
  FROM m LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    10 * n_letterless > 4 * n_words OR 10 * top_pair > n_words OR 10 * n_capitals > 4 * n_letters OR 5 * top_word > n_words
    OR 10 * n_ellipses > 3 * n_lines OR 10 * n_bullets > 9 * n_lines OR 10 * n_dup_lines > 3 * n_lines
    OR 5 * n_digits > word_chars OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base measures and whether it passes the cascade of quality rules."""
    docs = table(spark, folder, "documents")
    return cascade.verdicts(docs, cascade.plan(docs)).drop("rejected_by", "rules_run")
