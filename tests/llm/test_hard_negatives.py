import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.llm import hard_negatives
from sagewell.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, v array<float>, block int, asked int, slot int"


def brute(x, labels, anchors, positives=5, negatives=3, window=(50, 95)):
    ids, found = np.arange(len(x)), set()
    for a in anchors:
        score = x @ x[a]
        order = [int(i) for i in np.lexsort((ids, -score)) if i != a]
        for p in [i for i in order if labels[i] == labels[a]][:positives]:
            held = [i for i in order if labels[i] != labels[a]
                    and window[0] * int(score[p]) <= 100 * int(score[i]) <= window[1] * int(score[p])]
            found |= {(a, p, rank, n, int(score[p]), int(score[n])) for rank, n in enumerate(held[:negatives], 1)}
    return found


def mined(spark, x, labels, extra=(), anchors="vec_id % 10 = 0", **options):
    rows = [(i, int(label), [float(c) for c in v], 1, 2, 3) for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    table = spark.createDataFrame(rows + list(extra), SCHEMA)
    whole = hard_negatives.entries(table, "vec_id", "v", "label", scale=options.pop("scale", 256))
    return {tuple(r) for r in hard_negatives.mine(whole, F.expr(anchors), **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def test_equals_brute_force_with_ties_copies_and_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)).astype("float32") / 3
    x[::3] = x[0]                                       # a third of all rows are one vector
    x[1:60] = np.round(x[1:60], 1)
    labels = rng.choice(4, 300, p=[0.6, 0.2, 0.15, 0.05])
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    expected = brute(whole, labels, range(0, 300, 10))
    assert len(expected) > 100
    assert mined(spark, x, labels) == expected
    assert mined(spark, x, labels, rows_per_block=40) == expected


def test_rows_that_take_no_part_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)).astype("float32")
    labels = rng.integers(0, 3, 80)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, [1.0] * 5, 0, 0, 0), (910, 1, None, 0, 0, 0), (920, 1, [None] + [1.0] * 4, 0, 0, 0),
           (930, 1, [nan] + [1.0] * 4, 0, 0, 0), (940, 1, [inf] * 5, 0, 0, 0), (None, 1, [9.0] * 5, 0, 0, 0),
           (950, 1, [9.0] * 4, 0, 0, 0), (960, 1, [], 0, 0, 0)]
    again = [(i, int(labels[i]), [float(c) for c in x[i]], 7, 7, 7) for i in (0, 1, 2, 10)]
    worse = [(3, 99, [50.0] * 5, 0, 0, 0)]             # the same id with a larger label is not the row of that id
    expected = brute(np.floor(256 * x.astype(float)).astype(np.int64), labels, range(0, 80, 10))
    assert mined(spark, x, labels, bad + again + worse) == expected


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2 ** 23, 2 ** 23, size=(60, 6)).astype("float32") * 8
    labels = rng.integers(0, 2, 60)
    whole = np.floor(8 * x.astype(float)).astype(np.int64)
    assert (np.abs(whole @ whole.T) > 2 ** 53).any()
    assert mined(spark, x, labels, scale=8) == brute(whole, labels, range(0, 60, 10))
    with pytest.raises(ValueError, match="scale"):
        mined(spark, x, labels, scale=2 ** 20)


def test_alone_all_one_label_and_empty(spark):
    assert mined(spark, np.ones((1, 3)), [0]) == set()
    assert mined(spark, np.ones((20, 3)), [1] * 20) == set()
    assert mined(spark, np.zeros((0, 3)), []) == set()
    # Two labels of equal vectors: all score alike, so nothing is below 95 hundredths.
    assert mined(spark, np.ones((20, 3)), [i % 2 for i in range(20)]) == set()
    # A positive at 0 leaves exactly the negatives at 0.
    x, labels = np.array([[1.0, 0], [0, 1.0], [0, 2.0], [5.0, 0]]), [0, 0, 1, 1]
    assert mined(spark, x, labels) == {(0, 1, 1, 2, 0, 0)}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{folder}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x = np.floor(256 * np.array([r.embedding for r in rows], dtype=np.float32).astype(float)).astype(np.int64)
    labels = [(r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label for r in rows]
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    found = {tuple(r) for r in QUERIES["op11_hard_negatives"](spark, folder).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    assert found == brute(x, np.array(labels), range(0, len(rows), 50))
