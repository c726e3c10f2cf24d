"""Readers for stored crawl results (JSON) and the per-URL metadata join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.functions.urls import canonical_url

PAGE = (
    "struct<markdown string, links array<string>, metadata struct<title string, sourceURL string, "
    "url string, description string, ogDescription string, statusCode int>>"
)
ENVELOPE = f"status string, total int, completed int, creditsUsed int, `next` string, data array<{PAGE}>"
SINGLE = (
    f"success boolean, data {PAGE}, markdown string, links array<string>, "
    "metadata struct<title string, sourceURL string, url string, description string, ogDescription string, "
    "statusCode int>"
)
CASE = (
    "id string, transcript string, turns array<string>, expected_intent string, expected_handoff boolean, "
    "required_substrings array<string>, requires_citations boolean, requires_tool_call boolean, "
    "expected_tool string, site_id string, `limit` int, expected_context_substrings array<string>, "
    "expected_rewrite_source string, expected_resolved_query_substrings array<string>, "
    "expected_answer_substrings array<string>, forbidden_answer_substrings array<string>, "
    "time_sensitive boolean, max_tool_latency_ms int"
)


def read_crawl_results(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Pages of every stored part of a crawl; ``path`` is a file or a folder of parts.

    A part is one JSON document; with ``lines`` a file holds one document per line and large files are split.
    """
    return pages_of(spark.read.schema(ENVELOPE).json(path, multiLine=not lines).select("data"))


def read_crawl_totals(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """What every stored part of a crawl says of itself: ``status, total, completed, credits_used`` and its file."""
    parts = spark.read.schema(ENVELOPE).json(path, multiLine=not lines)
    return parts.select("status", "total", "completed", F.coalesce("creditsUsed", F.lit(0)).alias("credits_used"),
                        F.input_file_name().alias("file"))


def read_single_pages(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Pages stored one by one, wrapped in ``data`` or bare."""
    return pages_of(_single_pages(spark.read.schema(SINGLE).json(path, multiLine=not lines)))


def read_cases(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Golden evaluation cases of either shape (single transcript or list of turns)."""
    return spark.read.schema(CASE).json(path, multiLine=not lines)


def _single_pages(df: DataFrame) -> DataFrame:
    page = F.coalesce(F.col("data"), F.struct("markdown", "links", "metadata").cast(PAGE))
    return df.select(F.array(page).alias("data"))


def pages_of(envelopes: DataFrame) -> DataFrame:
    """One row per page; missing fields become empty values."""
    page = envelopes.select(F.explode("data").alias("p"))
    source = F.coalesce("p.metadata.sourceURL", "p.metadata.url")
    return page.select(
        F.coalesce("p.markdown", F.lit("")).alias("markdown"),
        F.coalesce("p.links", F.array().cast("array<string>")).alias("links"),
        F.col("p.metadata.title").alias("title"),
        source.alias("source_url"),
        F.coalesce("p.metadata.url", source).alias("page_url"),
        F.coalesce("p.metadata.description", "p.metadata.ogDescription").alias("description"),
        F.col("p.metadata.statusCode").alias("status_code"),
    )


def site_map_urls(maps: DataFrame, column: str = "value") -> DataFrame:
    """URLs of site-map lists whose items are objects with ``url`` or bare strings; blanks dropped."""
    rest = [c for c in maps.columns if c != column]
    items = maps.select(*rest, F.explode(F.from_json(column, "links array<variant>")["links"]).alias("v"))
    url = F.coalesce(F.try_variant_get("v", "$.url", "string"), F.try_variant_get("v", "$", "string"))
    # An object without url renders as JSON text under "$"; it carries no URL and is dropped.
    return items.select(*rest, url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("{"))


def url_metadata(pages: DataFrame, overrides: DataFrame, key: str, urls: list) -> DataFrame:
    """Attach the override of a page's URLs: each URL as given, then in canonical form, in order."""
    candidates = F.array(*[c for url in urls for c in (url, canonical_url(url))])
    probes = pages.select(key, F.posexplode(candidates).alias("_priority", "url")).filter("url IS NOT NULL")
    best = (
        probes.join(overrides.select("url", "extra"), "url")
        .groupBy(key)
        .agg(F.min_by(F.struct("url", "extra"), "_priority").alias("_best"))
    )
    return (
        pages.join(best, key, "left")
        .withColumn("matched_url", F.col("_best.url"))
        .withColumn("extra", F.col("_best.extra"))
        .drop("_best")
    )
