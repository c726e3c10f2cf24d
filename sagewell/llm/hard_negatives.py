"""Hard negatives by a vertical scan over columns of blocks, with partial scores and bounds (BOND).

Vectors become whole numbers and are dealt into blocks; a block is held by dimension, with the least and the
largest value of each. An anchor reads the dimensions in descending order of its own magnitude and adds them to the
partial scores of the candidates it has left. What the unread dimensions can still add lies between two sums of
their extremes, which decide early who cannot be among the best positives, or cannot come to lie among the first
of any score window; the bitmap of candidates shrinks until the scores that are left are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagewell.llm.shared import stored

#: At most so many rows of either side meet in a task; fewer where that leaves tasks idle.
ROWS_PER_BLOCK = 65_536
#: Dimensions read between two looks at the bounds.
STEP = 8
EXACT_IN_DOUBLE, EXACT_IN_LONG = 2 ** 53, 2 ** 63
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())])


def entries(table: DataFrame, vec_id: str, vector: str, label: str | Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, with ``floor(scale * x)`` for a component ``x``.

    Left out are rows with a null id or label, with a null vector, or with a null or non-finite component; of
    vectors of several lengths those take part whose length is the commonest (the shortest of equally common ones).
    An empty vector has no components and scores 0. Other columns are not read.
    """
    x = F.col(vector).cast("array<double>")
    whole = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).alias("label"),
        F.transform(x, lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.floor(scale * c))).alias("vector"))
    taking = whole.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda c: c.isNotNull()))
    sizes = taking.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return taking.where(F.size("vector") == (sizes["size"] if sizes else 0))


class Block:
    """Candidates by column: ``columns[d]`` has dimension ``d`` of all of them, in ascending order of their ids."""

    def __init__(self, rows: pa.Table, number: type):
        ids = rows["vec_id"].to_numpy()
        labels, x = rows["label"].to_numpy(), _matrix(rows["vector"], number)
        # Rows of one id are one candidate, the one with the smallest label and vector.
        order = np.lexsort((*x.T[::-1], labels, ids))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])] if len(order) else order
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(x[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the candidates of the bitmap ``alive`` that ``keep`` never let go.

        ``keep(least, most)`` gets the bounds of the scores of those left and says which stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (np.minimum(*ends), np.maximum(*ends)))
        at = np.flatnonzero(alive)
        score = np.zeros(len(at), dtype=self.columns.dtype)
        for start in range(0, len(order), STEP):
            read = order[start: start + STEP]
            part = self.columns[read] if len(at) == len(alive) else self.columns[read[:, None], at[None, :]]
            score = score + anchor[read] @ part
            done = start + len(read)
            stay = keep(score + least[done], score + most[done])
            at, score = at[stay], score[stay]
            if not len(at):
                break
        return at, score


def _matrix(column: pa.ChunkedArray, number: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(number) if len(column) else np.zeros((0, 0), number)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _at_least(values: np.ndarray, k: int):
    """The ``k``-th largest value, which ``k`` of them reach."""
    return np.partition(values, len(values) - k)[len(values) - k]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FOUND)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _dealt(side: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Rows with their own block, once for every block of the other side."""
    return side.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks))).withColumn(
        other, F.explode(F.expr(f"sequence(0L, {other_blocks - 1}L)")))


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Hard negatives of every anchor and positive: ids, rank and whole-number scores.

    ``rows`` comes from ``entries``; ``anchors`` says which of its rows are anchors. An anchor's positives are the
    first ``positives`` other rows of its label, and each gets the first ``negatives`` rows of other labels whose score
    is from ``window[0]`` to ``window[1]`` hundredths of the positive's; higher scores come first, ties by smaller id.
    Rows of one id are one row, the one with the smallest label and vector. Anchors without another row of their label
    and windows without a row give nothing, and an empty table gives no rows. Vectors whose scores
    may not fit into a long raise a ValueError.

    Both sides are cut into blocks by a hash of the id, so neither a common label nor a common vector gathers in a task;
    every pair of blocks is one group, and of it only the first few rows of an anchor go on.
    """
    spark = rows.sparkSession
    asked = stored(rows.where(anchors).groupBy("vec_id").agg(
        F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector"), "anchors")
    largest = F.aggregate("vector", F.lit(0.0), lambda most, c: F.greatest(most, F.abs(c.cast("double"))))
    sizes = rows.agg(F.count("*").alias("n"), F.max(largest).alias("largest"), F.max(F.size("vector")).alias("dims")).first()
    reach = (sizes["largest"] or 0.0) ** 2 * (sizes["dims"] or 0)
    if reach >= EXACT_IN_LONG:
        raise ValueError("scores of these vectors do not fit into a long; use a smaller scale")
    # Sums of whole numbers are exact in doubles up to 2^53; the rare larger ones take slower numbers.
    number = np.float64 if reach < EXACT_IN_DOUBLE else np.int64
    if (sizes["largest"] or 0.0) < 2 ** 31:
        rows, asked = (side.withColumn("vector", F.col("vector").cast("array<int>")) for side in (rows, asked))
    anchor_blocks = max(1, -(-asked.count() // rows_per_block))
    blocks = max(-(-sizes["n"] // rows_per_block), -(-2 * spark.sparkContext.defaultParallelism // anchor_blocks), 1)
    dealt = _dealt(rows, "block", blocks, "asked", anchor_blocks)
    keys = ["block", "asked"]

    def first_positives(candidates: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and some.num_rows:
            block = Block(candidates, number)
            for anchor, label, x in zip(
                    some["vec_id"].to_pylist(), some["label"].to_pylist(), _matrix(some["vector"], number), strict=True):
                def keep(least, most):
                    return most >= _at_least(least, positives) if len(least) > positives else np.ones(len(least), bool)

                at, score = block.scan(x, (block.labels == label) & (block.ids != anchor), keep)
                found += [(anchor, 0, int(block.ids[at[i]]), int(score[i])) for i in _best(block.ids[at], score, positives)]
        return _table(found)

    def first_in_windows(candidates: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and some.num_rows:
            block = Block(candidates, number)
            for anchor, label, scores, x in zip(
                    some["vec_id"].to_pylist(), some["label"].to_pylist(), some["scores"].to_pylist(),
                    _matrix(some["vector"], number), strict=True):
                # Whole scores from ceil(low * p / 100) to floor(high * p / 100).
                spans = [(-(-window[0] * p // 100), window[1] * p // 100) for p in scores]

                def keep(least, most, spans=spans):
                    stay = np.zeros(len(least), bool)
                    for low, high in spans:
                        may, sure = (most >= low) & (least <= high), (least >= low) & (most <= high)
                        if np.count_nonzero(sure) >= negatives:
                            may &= most >= _at_least(least[sure], negatives)
                        stay |= may
                    return stay

                at, score = block.scan(x, block.labels != label, keep)
                for slot, (low, high) in enumerate(spans):
                    held = np.flatnonzero((score >= low) & (score <= high))
                    best = held[_best(block.ids[at[held]], score[held], negatives)]
                    found += [(anchor, slot, int(block.ids[at[i]]), int(score[i])) for i in best]
        return _table(found)

    def run(some: DataFrame, job: Callable, k: int) -> DataFrame:
        there = _dealt(some, "asked", anchor_blocks, "block", blocks)
        near = dealt.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(
            lambda candidates, here: job(candidates, here), "anchor_id long, slot int, found_id long, score long")
        first = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id")
        return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    chosen = stored(run(asked, first_positives, positives).groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "found_id", "score"))).alias("found")).select(
            F.col("anchor_id").alias("vec_id"), F.col("found.found_id").alias("ids"), F.col("found.score").alias("scores")),
        "positives")
    hard = run(asked.join(chosen.select("vec_id", "scores"), "vec_id"), first_in_windows, negatives)
    named = chosen.select(F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("slot", "positive"))
    return hard.join(named, ["anchor_id", "slot"]).select(
        "anchor_id", F.col("positive.ids").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"),
        F.col("positive.scores").alias("positive_score"), F.col("score").alias("negative_score"))
