import numpy as np
import pytest

from sagewell.llm import feast, whitening
from sagewell.llm.queries import QUERIES

SCHEMA = "vec_id long, e array<float>, x int, whitened int, n int"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(60, 70, 64),                                  # a dense band
    np.r_[1e6, 1e3, np.full(20, 5.0), np.linspace(0, 1, 20)],  # repeated eigenvalues across the cut
    np.r_[np.full(3, 2.0), np.zeros(20)],                     # less rank than wanted
    np.exp(-np.arange(40.0)),
    1 + 1e-7 * np.arange(30.0),                               # close neighbours
    np.array([3.0]),
])
def test_eigenpairs_equal_a_dense_solver(values):
    matrix = symmetric(np.asarray(values))
    expected = np.linalg.eigvalsh(matrix)[::-1]
    found, vectors = feast.leading(matrix, 12)
    rank = int((expected > 1e-11 * expected[0]).sum())
    assert min(rank, 12) <= len(found) <= 12
    top = expected[0]
    assert np.allclose(found, expected[: len(found)], rtol=0, atol=1e-12 * top)
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * top


def test_inertia_counts_equal_sorted_eigenvalues():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 30):
        a = rng.normal(size=(size, size))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.normal(size=10) * 3:
            assert feast.count_above(a, shift) == (values > shift).sum()
    assert feast.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def brute(vectors, k):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def run(spark, rows, k=32):
    table = spark.createDataFrame(rows, SCHEMA)
    whole = whitening.whole_vectors(table, "vec_id", "e")
    model = whitening.fit(whole, k)
    return model, {r.vec_id: r for r in whitening.whiten(whole, model).collect()}


def test_equals_a_dense_solver_and_leaves_bad_rows_out(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(200, 10)) * np.linspace(3, 1, 10) + 100).astype("float32")
    vectors[::3] = vectors[0]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [None] + [1.0] * 9), (902, [nan] * 10), (903, [inf] * 10), (904, []), (905, [1.0] * 9)]
    rows = [(i, [float(c) for c in v], 1, 2, 3) for i, v in enumerate(vectors)] + [(i, v, 1, 2, 3) for i, v in bad]
    model, found = run(spark, rows, 6)
    deviation, whitened, explained = brute(vectors, 6)
    assert sorted(found) == list(range(200)) and model.n == 200
    assert [int(found[i].deviation) for i in range(200)] == deviation.tolist()
    got = np.array([found[i].whitened for i in range(200)])
    assert np.allclose(got * np.sign((got * whitened).sum(axis=0)), whitened, atol=1e-9)
    assert np.allclose(model.explained, explained, rtol=1e-12) and model.identity_error < 1e-10


def test_repeated_rows_null_ids_and_less_rank_than_asked(spark):
    rows = [(1, [1.0, 0.0, 5.0], 0, 0, 0)] * 3 + [(None, [2.0, 0.0, 5.0], 0, 0, 0)]
    model, found = run(spark, rows)
    assert model.n == 4 and len(model.eigenvalues) == 1 and sorted(map(str, found)) == ["1", "None"]
    assert np.isclose(found[None].whitened[0], 3 ** 0.5) and np.isclose(found[1].whitened[0], -1 / 3 ** 0.5)
    for same in ([], [(1, [2.0, 3.0], 0, 0, 0)], [(i, [2.0, 3.0], 0, 0, 0) for i in range(9)]):
        model, found = run(spark, same)
        assert len(model.eigenvalues) == 0 and all(list(r.whitened) == [] and r.deviation == 0 for r in found.values())


def test_sums_and_deviations_beyond_a_long_are_exact(spark):
    big = [(i, [float(2 ** 45 + 2 ** 30 * i)], 0, 0, 0) for i in range(3)]
    model, found = run(spark, big)
    x = [int(64 * r[1][0]) + 1_000_000 for r in big]
    assert [int(found[i].deviation) for i in range(3)] == [(3 * c - sum(x)) ** 2 for c in x]
    with pytest.raises(Exception, match="smaller scale"):
        run(spark, [(1, [1e17], 0, 0, 0)])


def test_query_equals_a_dense_solver(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{folder}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    deviation, whitened, explained = brute([r.embedding for r in rows], 32)
    found = QUERIES["op12_whitening"](spark, folder).orderBy("vec_id", "component").collect()
    assert len(found) == 32 * len(rows)
    got = np.array([r.whitened for r in found]).reshape(-1, 32)
    assert np.allclose(got * np.sign((got * whitened).sum(axis=0)), whitened, atol=1e-8)
    assert [r.deviation for r in found[::32]] == deviation.tolist() and {r.n for r in found} == {len(rows)}
    assert np.allclose([r.explained for r in found[:32]], explained, rtol=1e-10)
    assert {r.identity_error < 1e-9 for r in found} == {True}
