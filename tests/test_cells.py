import numpy as np
import pytest
from pyspark.sql import functions as F

from sagewell.operators import cells, vectors

SCHEMA = "chunk_id string, embedding array<double>"


def clustered(n=400, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + 0.15 * rng.normal(size=(n, width))
    x[: n // 3] = x[0]                                  # a third of the rows are one vector
    return x


def sparse(spark, x, name="chunk_id"):
    rows = [(f"v{i:04d}" if name == "chunk_id" else i, [float(c) for c in v]) for i, v in enumerate(x)]
    schema = SCHEMA if name == "chunk_id" else "query_id long, embedding array<double>"
    return vectors.dense_as_sparse(spark.createDataFrame(rows, schema), name, "embedding")


def brute(x, queries, k):
    unit, asked = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, queries))
    score = np.round(asked @ unit.T, 6)
    return {q: [(f"v{i:04d}", s[i]) for i in sorted(range(len(x)), key=lambda i: (-s[i], i))[:k]] for q, s in enumerate(score)}


def rows(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return found


@pytest.fixture()
def small_parts(monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 30)
    monkeypatch.setattr(cells, "QUERY_ROWS", 2)


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_exact_search_equals_brute_force(spark, small_parts, k):
    x = clustered()
    queries = np.vstack([x[[0, 200, 399]], np.random.default_rng(5).normal(size=(4, 12))])
    lists = cells.build_lists(sparse(spark, x))
    assert lists.rows.where("part > 0").count() > 0 and lists.rows.count() == 400
    found = rows(cells.search_lists(sparse(spark, queries, "query_id"), lists, k, probes=2, exact=True))
    expected = brute(x, queries, k)
    for q in expected:
        assert [c for c, _ in found[q]] == [c for c, _ in expected[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in expected[q]], atol=1e-9)


def test_bound_stops_before_all_cells_and_probes_reach_the_recall(spark):
    x = clustered(seed=4)
    queries = sparse(spark, x[[0, 150, 250, 399]], "query_id")
    lists = cells.build_lists(sparse(spark, x))
    near = rows(cells.search_lists(queries, lists, 10, probes=3))
    kth = spark.createDataFrame([(q, hits[9][1]) for q, hits in near.items()], "query_id long, kth double")
    more = cells.probes_of(queries, lists, 3, kth).groupBy("query_id").count().collect()
    assert all(r["count"] < lists.cells.count() - 3 for r in more)
    expected = brute(x, x[[0, 150, 250, 399]], 10)
    hit = sum(len({c for c, _ in near[q]} & {c for c, _ in expected[q]}) for q in expected)
    assert hit >= 0.9 * 40


def test_only_probed_cells_are_read(spark, tmp_path):
    lists = cells.build_lists(sparse(spark, clustered()), str(tmp_path / "lists"))
    again = cells.read_lists(spark, str(tmp_path / "lists"))
    one = spark.createDataFrame([(int(lists.cells.orderBy("cell").first()["cell"]),)], "cell int")
    read = cells.read_cells(again, one)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    n = {r["cell"]: r["n"] for r in lists.cells.collect()}
    assert read.count() == n[one.first()["cell"]] < 400
    folders = read.select(F.regexp_extract(F.input_file_name(), "cell=[0-9]+", 0).alias("f")).distinct().collect()
    assert len(folders) == 1


def test_given_centres_and_small_tables(spark):
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [0, 0]])
    lists = cells.build_lists(sparse(spark, x), centres=np.array([[5.0, 0], [0, 2.0]]))
    assert {r.chunk_id: r.cell for r in lists.rows.collect()} == {"v0000": 0, "v0001": 0, "v0002": 1, "v0003": 0}
    queries = sparse(spark, np.array([[1.0, 0.2]]), "query_id")
    assert [c for c, _ in rows(cells.search_lists(queries, lists, 5, probes=1))[0]] == ["v0001", "v0000", "v0003"]
    assert len(rows(cells.search_lists(queries, lists, 5, probes=1, exact=True))[0]) == 4
    none = cells.build_lists(sparse(spark, x[:0]))
    assert cells.search_lists(queries, none, 5, probes=2, exact=True).count() == 0
    assert cells.search_lists(queries.limit(0), lists, 5, probes=2, exact=True).count() == 0


def test_texts_are_embedded_on_the_way_to_their_cells_and_read_cells_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 90, 12)) for _ in range(200)] + ["", None, "Lone"]
    rows_ = spark.createDataFrame([(f"v{i:04d}", t) for i, t in enumerate(texts)], "chunk_id string, vector_text string")
    written, plain = [], cells.materialized
    monkeypatch.setattr(cells, "materialized", lambda table, purpose: (written.append(purpose), plain(table, purpose))[1])
    stored = cells.build_lists(vectors.with_vectors(rows_, "vector_text").drop("vector_text"))
    lists = cells.build_lists(rows_)
    kept = ["chunk_id", "dims", "weights", "norm", "part", "cell"]
    assert sorted(map(str, lists.rows.select(kept).collect())) == sorted(map(str, stored.rows.select(kept).collect()))
    asked = vectors.with_vectors(spark.createDataFrame([(1, "w1 w2 w3"), (2, "")], "query_id long, text string"), "text")
    whole = rows(cells.search_lists(asked, lists, 10, probes=2, exact=True))
    near = cells.search_lists(asked, lists, 10, probes=2).cache()
    written.clear()
    assert rows(cells.search_lists(asked, lists, 10, probes=2, exact=True, near=near)) == whole
    assert written.count("probes") == 1
    assert rows(cells.search_lists(asked, lists, 10, probes=2, near=near)) == rows(near)


def test_the_nearest_centre_is_that_of_double_precision():
    rng = np.random.default_rng(9)
    x, own = rng.normal(size=(300, 50)), rng.normal(size=(40, 50))
    x, own = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, own))
    own[20:30] = own[:10] + 1e-9 * own[10:20]
    own[30:] = own[:10]
    x[:40], x[40] = own, 0
    assert (cells._nearest(x, own, own.astype(np.float32)) == (x @ own.T).argmax(axis=1)).all()
