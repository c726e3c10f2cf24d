"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges: the root is the smallest node it is connected to.

    Every round a root takes the smallest root among the neighbours of its members, then every node follows its
    root to that node's root, so rounds grow with the logarithm of the component's width. Edges stay distributed.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("near"))
        hooks = stored(state.join(near, "node").groupBy("root").agg(F.min("near").alias("near")).select(
            "root", F.least("root", "near").alias("new")), "hooks")
        if hooks.where("root <> new").isEmpty():
            return state
        hooked = stored(state.join(hooks, "root").select("node", F.col("new").alias("root")), "roots")
        beyond = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        state = stored(hooked.join(beyond, "root").select("node", F.col("next").alias("root")), "roots")
