"""Roll-ups over chunks, crawl rows and job events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagewell.session import materialized


def category_counts(chunks: DataFrame, keys: tuple = ()) -> DataFrame:
    """Chunk count per category (null as ``unknown``), ordered by count then name."""
    counted = chunks.groupBy(*keys, F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("chunks")
    )
    return counted.orderBy(*keys, F.desc("chunks"), F.asc("category"))


def crawl_extent(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.max("crawled_at").alias("latest_crawl"))


def expired(as_of: Column) -> Column:
    return F.col("valid_until").isNotNull() & (F.col("valid_until") < as_of)


def doc_set_hash(chunks: DataFrame, keys: tuple = (), prefix_chars: int = 0) -> DataFrame:
    """Fingerprint of the set of content hashes, whole or per key.

    The md5 of all hashes, sorted and joined by commas. A digest over one sequence is one task's work, so
    a key's hashes meet in one task, but only as sorted rows: Spark's sort spills, and the digest takes
    them batch by batch, so memory does not grow with a key. ``prefix_chars`` gives another value, built
    in two levels: a digest per bucket of equal leading characters, then one over the buckets.
    """
    if not prefix_chars:
        return _streamed_hash(chunks, keys)
    bucket = F.substring("content_hash", 1, prefix_chars)
    low = chunks.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.md5(F.array_join(F.sort_array(F.collect_list("content_hash")), ",").cast("binary")).alias("_md5"),
        F.count("*").alias("_n"),
    )
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_bucket", "_md5"))), lambda p: p["_md5"])
    return low.groupBy(*keys).agg(
        F.md5(F.array_join(parts, ",").cast("binary")).alias("doc_set_hash"), F.sum("_n").alias("chunks")
    )


def _streamed_hash(chunks: DataFrame, keys: tuple) -> DataFrame:
    """The md5 of each key's hashes in order; rows without a hash are counted only."""
    rows = chunks.select(*keys, F.col("content_hash").cast("string").alias("content_hash"))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    out = T.StructType([
        *rows.schema.fields[:-1], T.StructField("doc_set_hash", T.StringType()), T.StructField("chunks", T.LongType())
    ])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, held, digest, empty, n = None, None, hashlib.md5(), True, 0
        for part in batches:
            fields = list(part.schema)[:-1]
            lists = [column.to_pylist() for column in part.columns]
            done = []
            for key, group in groupby(zip(*lists, strict=True), key=lambda row: row[:-1]):
                if key != held:
                    if held is not None:
                        done.append((*held, digest.hexdigest(), n))
                    held, digest, empty, n = key, hashlib.md5(), True, 0
                hashes = [row[-1] for row in group]
                n += len(hashes)
                known = [h for h in hashes if h is not None]
                if known:
                    digest.update((("" if empty else ",") + ",".join(known)).encode())
                    empty = False
            yield from _hash_rows(done, fields)
        if held is not None:
            yield from _hash_rows([(*held, digest.hexdigest(), n)], fields)

    found = dealt.sortWithinPartitions(*keys, "content_hash").mapInArrow(digests, out)
    if keys:
        return found
    nothing = hashlib.md5().hexdigest()
    return found.agg(F.coalesce(F.max("doc_set_hash"), F.lit(nothing)).alias("doc_set_hash"),
                     F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))


def _hash_rows(done: list[tuple], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    if done:
        schema = pa.schema([*fields, ("doc_set_hash", pa.string()), ("chunks", pa.int64())])
        columns = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def site_status(chunks: DataFrame, sites: DataFrame, as_of: Column) -> DataFrame:
    """One row per known site: chunk count, latest crawl, stale count and counts per category.

    The chunk side is reduced to one row per (site, category) before anything is joined.
    """
    per_category = chunks.groupBy("site_id", F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("n"),
        F.max("crawled_at").alias("latest"),
        F.count_if(expired(as_of)).alias("stale"),
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "category")))
    per_site = per_category.groupBy("site_id").agg(
        F.sum("n").alias("document_count"),
        F.max("latest").alias("latest_crawl"),
        F.sum("stale").alias("stale_count"),
        F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["category"], -x["m"]))).alias("category_counts"),
    )
    zero = F.lit(0).cast("long")
    return (
        sites.join(per_site, "site_id", "left")
        .withColumn("document_count", F.coalesce("document_count", zero))
        .withColumn("stale_count", F.coalesce("stale_count", zero))
    )


def context_size(hits: DataFrame, key: str, text: str, score: str) -> DataFrame:
    """Number of hits, best score, characters and UTF-8 bytes per key."""
    return hits.groupBy(key).agg(
        F.count("*").alias("hit_count"),
        F.max(score).alias("top_score"),
        F.sum(F.char_length(text).cast("long")).alias("context_chars"),
        F.sum(F.octet_length(text).cast("long")).alias("context_bytes"),
    )


def crawl_summary(pages: DataFrame, selection: DataFrame, credits: DataFrame) -> DataFrame:
    """Per crawl: pages seen, crawled, failed, credits, and URL counts with skip reasons.

    ``pages``: ``crawl_id, canonical_url, failed, scraped`` (read one by one after the crawl, which costs a credit each);
    ``selection``: ``crawl_id, skip_reason``; ``credits``: ``crawl_id, credits_used`` of the stored crawl results. URL
    lists stay rows (``select_urls``) because a crawl's candidates have no bound.
    """
    seen = pages.groupBy("crawl_id").agg(
        F.count("*").alias("pages_seen"),
        F.count_if(~F.col("failed")).alias("pages_crawled"),
        F.count_if("failed").alias("pages_failed"),
        F.count_if(F.col("scraped") & ~F.col("failed")).alias("_scraped"),
    )
    spent = credits.groupBy("crawl_id").agg(F.sum("credits_used").alias("_spent"))
    reasons = selection.groupBy("crawl_id", "skip_reason").agg(F.count("*").alias("n"))
    urls = reasons.groupBy("crawl_id").agg(
        F.sum("n").alias("candidate_urls"),
        F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("n"))), F.lit(0)).alias("selected_urls"),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("skip_reason").isNotNull(), F.struct("skip_reason", "n")))
            )
        ).alias("skip_reasons"),
    )
    return seen.join(urls, "crawl_id", "left").join(spent, "crawl_id", "left").withColumn(
        "credits_used", F.coalesce("_spent", F.lit(0)) + F.col("_scraped")).drop("_spent", "_scraped")


def fold_jobs(events: DataFrame) -> DataFrame:
    """Current state of each job from its event log (``job_id, ts, event_id, kind, status, key, value``).

    A ``create`` event starts a job afresh; later updates are merged key by key, the latest value of
    a key wins. Updates to a job that was never created are ignored. Two aggregations: per (job, key)
    and then per job, so the log itself is reduced on the map side.
    """
    at = F.struct("ts", "event_id")
    per_key = events.groupBy("job_id", "key").agg(
        F.max(at).alias("at"),
        F.max_by("value", at).alias("value"),
        F.max_by("status", at).alias("status"),
        F.max(F.when(F.col("kind") == "create", at)).alias("created"),
    )
    created = F.max("created").over(W.partitionBy("job_id"))
    live = per_key.withColumn("started", created).filter(
        F.col("started").isNotNull() & (F.col("at") >= F.col("started"))
    )
    return live.groupBy("job_id").agg(
        F.max_by("status", "at").alias("status"),
        F.max("at.ts").alias("updated_at"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("fields"),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float = 0.95, buckets: int | None = None) -> DataFrame:
    """Nearest-rank percentile per key: the sorted value at ``round_half_even((n - 1) * p)``.

    Exact without sorting a key in one task: equal values become one counted row, the rows are cut into
    ranges of about equal size (``buckets`` of them, the session's shuffle partitions by default), wherever
    their values lie, and only the range that holds the wanted position is ordered. The ranges are written
    once: they are read twice, and their limits are sampled.
    """
    spark = df.sparkSession
    ranges = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cut = counted.repartitionByRange(ranges, *keys, "_v").withColumn("_range", F.spark_partition_id())
    rows = materialized(cut, "ranks")
    key = W.partitionBy(*keys)
    running = key.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    target = (
        rows.groupBy(*keys, "_range")
        .agg(F.sum("_c").alias("_held"))
        .select(*keys, "_range", (F.sum("_held").over(running) - F.col("_held")).alias("_before"), "_held",
                F.bround((F.sum("_held").over(key) - 1) * F.lit(p)).cast("long").alias("_wanted"))
        .filter((F.col("_before") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_before") + F.col("_held")))
        .select(*keys, "_range", (F.col("_wanted") - F.col("_before")).alias("_skip"))
    )
    ordered = key.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(target, [*keys, "_range"])
        .withColumn("_upto", F.sum("_c").over(ordered))
        .filter((F.col("_upto") > F.col("_skip")) & (F.col("_upto") - F.col("_c") <= F.col("_skip")))
        .select(*keys, F.col("_v").alias(f"p{round(p * 100)}"))
    )
