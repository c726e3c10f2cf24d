"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of groups (domain, language, source, ...). At every node the children share the
budget by weight; a child that cannot supply its share gives the shortage to its siblings, and only what a whole
subtree cannot supply reaches the subtrees beside it, because each node is first capped by all its leaves hold.
A leaf then takes whole seeded epochs and a prefix of the next one in its shuffled order.

All of it is integer arithmetic in DataFrame expressions. Groups are small tables; the running sum over a
leaf's documents is cut into slices of the shuffled order, so no leaf has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagewell.llm.shared import stored

ROWS_PER_SLICE = 1000
#: A table of leaves up to this size is sent to every task; a larger one is joined by key.
SMALL_TABLE_ROWS = 20_000
MISSING = "(none)"


def word_count(text: str) -> Column:
    """Tokens for the budget: runs of characters other than the six ASCII white-space characters."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: list[Column], budget: Column, epochs: int) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``leaf_budget``: whole tokens, at most ``epochs`` times the tokens.

    ``weights[i]`` is a whole number computed from ``levels[: i + 1]``; a null or negative one counts as 0. A
    group without weight gets nothing. Division rounds down at every node, so a node may leave up to one token
    per child unspent.
    """
    nodes = leaves.select(*levels, (F.col("tokens") * epochs).alias("cap"))
    for depth, weight in enumerate(weights):
        counted = F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0)).alias(f"w{depth}")
        nodes = nodes.withColumn(f"w{depth}", counted)
    live = nodes.withColumn(
        "cap", F.when(F.expr(" and ".join(f"w{d} > 0" for d in range(len(levels)))), F.col("cap")).otherwise(0)
    )
    given = None
    for depth in range(len(levels)):
        parent, path = levels[:depth], levels[: depth + 1]
        level = live.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w{depth}").alias("w"))
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        if parent:
            level = level.join(given, parent)
        else:
            level = level.withColumn("b", F.least(budget, F.sum("cap").over(siblings)).cast("long"))
        ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w"))
        order = siblings.orderBy(ratio.asc_nulls_last(), *path)
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns({
            "before": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "rest": F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(upto), F.lit(0)),
        })
        full = (F.col("w") > 0) & (F.col("cap") * F.col("rest") <= F.col("w") * (F.col("b") - F.col("before")))
        level = level.withColumn("full", full)
        level = level.withColumns({
            "spent": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings),
            "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings),
        })
        share = F.when(F.col("full"), F.col("cap")).when(
            F.col("w") > 0, F.expr("least(cap, (w * (b - spent)) div open)")
        ).otherwise(F.lit(0))
        given = level.select(*path, share.cast("long").alias("b"))
    return leaves.join(given.withColumnRenamed("b", "leaf_budget"), levels)


def _place(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: list[Column], budget: int | None = None,
    share: tuple[int, int] = (1, 2), epochs: int = 3, seed: int = 17, id_col: str = "doc_id",
    text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_budget``, ``mix_copies`` and the levels as ``mix_<level>``.

    ``levels`` names the tree from the root down, each an expression over ``docs``; a null value is a group of
    its own. ``budget`` is in tokens, or ``share`` of all tokens there are. ``mix_copies`` says how often a
    document is taken, 0 for never: once per whole epoch, and once more if the leaf's shuffled prefix reaches
    it. The prefix ends before the first document that would pass the budget. Documents without tokens are
    taken when the prefix has not ended before them. Repeated rows are counted and placed one by one, an empty
    table gives an empty table. Columns of ``docs`` that are named ``mix_`` and more are left out.
    """
    docs = docs.drop(*[name for name in docs.columns if name.startswith("mix_")])
    names = [f"mix_{name}" for name in levels]
    count = word_count(text_col) if tokens is None else tokens
    marked = docs.withColumns(
        {f"mix_{n}": F.coalesce(e.cast("string"), F.lit(MISSING)) for n, e in levels.items()}
    ).withColumn("mix_tokens", count)
    narrow = stored(marked.select(F.col(id_col).alias("mix_id"), *names, "mix_tokens"), "mix-tokens")
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs"))
    if budget is None:
        held = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("held")).first()["held"]
        budget = held * share[0] // share[1]
    planned = budgets(leaves, names, weights, F.lit(budget).cast("long"), epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(F.lit(0)).cast("long")
    planned = stored(planned.select(
        *names, F.col("leaf_budget").alias("mix_budget"), whole.alias("mix_whole"),
        (F.col("leaf_budget") - whole * F.col("tokens")).alias("mix_rest"),
        F.greatest(F.ceil(F.col("docs") / ROWS_PER_SLICE), F.lit(1)).cast("long").alias("mix_slices"),
    ), "mix-budgets")
    if planned.count() <= SMALL_TABLE_ROWS:
        planned = F.broadcast(planned)

    def sliced(df, key):
        placed = df.join(planned, names).withColumn("mix_order", _place(seed, F.col("mix_whole"), key))
        first = F.conv(F.substring("mix_order", 1, 6), 16, 10).cast("long")
        return placed.withColumn("mix_slice", F.shiftright(first * F.col("mix_slices"), 24))

    sums = sliced(narrow, F.col("mix_id")).groupBy(*names, "mix_slice").agg(F.sum("mix_tokens").alias("held"))
    before = Window.partitionBy(*names).orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *names, "mix_slice", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("mix_start"))
    within = Window.partitionBy(*names, "mix_slice").orderBy("mix_order", F.col(id_col), "mix_tokens").rowsBetween(
        Window.unboundedPreceding, 0)
    reached = F.col("mix_start") + F.sum("mix_tokens").over(within)
    return (
        sliced(marked, F.col(id_col)).join(starts, [*names, "mix_slice"])
        .withColumn("mix_reached", reached)
        .withColumn(
            "mix_copies",
            F.when(F.col("mix_budget") <= 0, F.lit(0)).otherwise(
                F.col("mix_whole") + (F.col("mix_reached") <= F.col("mix_rest")).cast("long")).cast("long"))
        .select(*docs.columns, *names, "mix_tokens", "mix_budget", "mix_copies")
    )


def taken(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The selected rows themselves, a document as often as it is taken."""
    return (
        mixed.where("mix_copies > 0")
        .withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
        .select(*columns)
    )
