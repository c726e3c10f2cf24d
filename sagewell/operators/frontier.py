"""Link-frontier expansion over already crawled pages, in waves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagewell.functions.urls import canonical_url
from sagewell.operators.pages import category_rank, link_rows, select_urls
from sagewell.session import ensure_checkpoint_dir


def page_budgets(max_pages: Column) -> list[Column]:
    """Pages kept back for discovery, pages of the first crawl, and URLs asked of the site map."""
    reserve = F.when(max_pages <= 4, F.lit(0)).otherwise(
        F.least(F.lit(12), F.greatest(F.lit(2), F.floor(max_pages / 4)))
    )
    return [
        reserve.cast("long").alias("reserve"),
        F.greatest(F.lit(1), max_pages - reserve).cast("long").alias("crawl_limit"),
        F.least(F.lit(5000), F.greatest(F.lit(100), max_pages * 20)).cast("long").alias("map_limit"),
    ]


def expand_frontier(
    candidates: DataFrame,
    pages: DataFrame,
    visited: DataFrame,
    *,
    budget: int,
    strict: bool = False,
    job: Callable[[Column], Column] | None = None,
    **policy,
) -> DataFrame:
    """Visit admitted URLs under a page budget; read pages add their links to the frontier.

    ``candidates``: ``url, discovered_from``; ``pages``: ``page_id, url, html``; ``visited``: ``url``.
    Returns the visit log ``url, category, discovered_from, wave, scraped``. A URL without a stored
    page counts as failed: it is logged but uses no budget.

    A wave takes every open URL the budget allows, in (category rank, URL) order; ``strict`` takes
    one URL per wave, which equals visiting one page at a time. Waves go on until the budget is used
    or no URL is open. Links are read from the pages once, before the first wave; each wave is
    checkpointed, so its lineage ends there and a lost executor costs one wave at most.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    stored = pages.withColumn("key", canonical_url(F.col("url")))
    known = select_urls(candidates.select("url", "discovered_from"), **policy).filter("skip_reason IS NULL")
    known = known.select("url", "category", "discovered_from").checkpoint()
    seen = visited.select("url")
    links_of = link_rows(pages).filter("pos > 0").select(
        F.col("source").alias("key"), "url", "discovered_from", "page_id", "pos").checkpoint()
    present_keys = stored.select(F.col("key").alias("url"), F.lit(True).alias("scraped")).distinct().checkpoint()
    log, left, wave = None, budget, 0
    while left > 0:
        open_urls = known.join(seen, "url", "left_anti")
        present = open_urls.join(present_keys, "url", "left")
        ordered = present.withColumn("sort_rank", category_rank(F.col("category"))).withColumn(
            "scraped", F.coalesce("scraped", F.lit(False))
        )
        if job is not None:
            taken = _affordable(ordered.withColumn("job", job(F.col("url"))), log, job, budget, strict)
        elif strict:
            taken = ordered.orderBy("sort_rank", "url").limit(1)
        else:
            # Failed URLs before the last affordable page are visited too. ``limit`` keeps the best
            # pages; the last of them bounds what the wave takes.
            paid = ordered.filter("scraped").orderBy("sort_rank", "url").limit(left)
            last = paid.agg(F.max(F.struct("sort_rank", "url")).alias("last"), F.count("*").alias("n")).first()
            if last["n"] < left:
                taken = ordered
            else:
                edge = last["last"]
                taken = ordered.filter(
                    (F.col("sort_rank") < edge["sort_rank"])
                    | ((F.col("sort_rank") == edge["sort_rank"]) & (F.col("url") <= edge["url"]))
                )
        taken = taken.select(
            "url", "category", "discovered_from", F.lit(wave).alias("wave"), "scraped"
        ).checkpoint()
        counts = taken.agg(F.count("*").alias("n"), F.count_if("scraped").alias("ok")).first()
        if counts["n"] == 0:
            break
        if job is None:
            left -= counts["ok"]
        log = taken if log is None else log.unionByName(taken).checkpoint()
        seen = seen.unionByName(taken.select("url")).checkpoint()
        read = links_of.join(taken.filter("scraped").select(F.col("url").alias("key")), "key", "left_semi")
        links = read.groupBy("url").agg(
            F.min_by("discovered_from", F.struct("page_id", "pos")).alias("discovered_from")
        )
        fresh = select_urls(links.join(known, "url", "left_anti"), **policy).filter("skip_reason IS NULL")
        known = known.unionByName(fresh.select("url", "category", "discovered_from")).checkpoint()
        wave += 1
    return log if log is not None else known.limit(0).select(
        "*", F.lit(0).alias("wave"), F.lit(False).alias("scraped")
    )


def _affordable(
    ordered: DataFrame, log: DataFrame | None, job: Callable[[Column], Column], budget: int, strict: bool
) -> DataFrame:
    """The open URLs of one wave under a budget per job, by the rule for one job.

    The window keeps at most ``budget`` rows a job and is pruned before its shuffle; all rows of a
    job meet only its one row of the page it can afford last.
    """
    rows = ordered.withColumn("left", F.lit(budget))
    if log is not None:
        spent = log.filter("scraped").groupBy(job(F.col("url")).alias("job")).agg(F.count("*").alias("spent"))
        rows = ordered.join(spent, "job", "left").withColumn("left", budget - F.coalesce("spent", F.lit(0)))
        rows = rows.filter("left > 0")
    place = F.row_number().over(W.partitionBy("job").orderBy("sort_rank", "url"))
    if strict:
        return rows.withColumn("place", place).filter("place = 1")
    paid = rows.filter("scraped").withColumn("place", place).filter((F.col("place") <= budget) & (F.col("place") <= F.col("left")))
    last = paid.groupBy("job").agg(F.max(F.struct("sort_rank", "url")).alias("last"), F.count("*").alias("paid"))
    return rows.join(last, "job", "left").filter(
        F.col("paid").isNull() | (F.col("paid") < F.col("left")) | (F.struct("sort_rank", "url") <= F.col("last"))
    )


def visit_summary(log: DataFrame) -> DataFrame:
    """Scraped and failed counts per wave and category."""
    return log.groupBy("wave", "category").agg(
        F.count_if("scraped").alias("scraped"), F.count_if(~F.col("scraped")).alias("failed")
    )
