"""URL filtering against dated lists: entries become validity intervals, captures are joined as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str) -> Column:
    """The host in lower case without port, user part and trailing dots; '' if there is none."""
    found = F.regexp_extract(
        F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.rtrim(F.lower(found), F.lit("."))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Every list key a URL falls under: its host, the domains above it, and host plus each path prefix."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, size), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.when(host != "", F.array_distinct(
        F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, valid_from, valid_to`` from dated ``key, action, at`` entries.

    ``action`` is block, allow or remove. An entry holds from its time until the next entry of its key; the
    last one holds for ever (null). Of several entries of one key and time, remove gives way to allow and allow
    to block. Entries with a null key, action or time are left out.
    """
    rank = F.expr("case action when 'block' then 2 when 'allow' then 1 else 0 end")
    decided = (
        entries.where("key is not null and at is not null and action in ('block', 'allow', 'remove')")
        .groupBy("key", "at").agg(F.max_by("action", rank).alias("action"))
    )
    later = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return decided.select(
        "key", "action", F.col("at").alias("valid_from"), later.alias("valid_to")).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of ``captures`` (page_id, url, fetched_at): the decision of the entries then active.

    The longest active key decides, so a path overrules its host and a host its domain; ``decision`` is block,
    allow or unlisted, with the entry's key and validity. A capture without URL or time is unlisted.
    """
    spans = intervals(entries).select(F.col("key").alias("__key"), "action", "valid_from", "valid_to")
    asked = captures.select("page_id", "url", "fetched_at").withColumns({
        "__row": F.monotonically_increasing_id(), "host": host_of("url"), "__path": path_of("url")})
    active = (
        asked.withColumn("__key", F.explode_outer(keys_of(F.col("host"), F.col("__path"))))
        .join(spans, "__key", "left")
        .withColumn("__hit", (F.col("fetched_at") >= F.col("valid_from")) & (
            F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    )
    best = F.max_by(
        F.struct("__key", "action", "valid_from", "valid_to"),
        F.when(F.col("__hit"), F.length("__key")))
    return active.groupBy("__row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"),
        F.first("fetched_at").alias("fetched_at"), best.alias("__best")
    ).select(
        "page_id", F.when(F.col("host") != "", F.col("host")).alias("host"), "fetched_at",
        F.coalesce(F.col("__best.action"), F.lit("unlisted")).alias("decision"),
        F.col("__best.__key").alias("matched_key"), F.col("__best.valid_from").alias("valid_from"),
        F.col("__best.valid_to").alias("valid_to"),
    )
