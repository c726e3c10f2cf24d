import numpy as np

from sagewell.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, one int, block int"


def table(spark, n=600, copies=200):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 16)).astype("float32")
    x[:copies] = x[0]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    bad = [(9001, None, 0, 0), (9002, [0.0] * 16, 0, 0), (9003, [float("nan")] + [1.0] * 15, 0, 0), (9004, [None] + [1.0] * 15, 0, 0),
           (9005, [float("inf")] + [1.0] * 15, 0, 0), (9006, [1.0], 0, 0), (None, [1.0] * 16, 0, 0)]
    return x.astype(float), spark.createDataFrame(rows + bad, SCHEMA)


def find(table, **options):
    vectors = multi_index.usable(table, "vec_id", "embedding")
    book = multi_index.fit(vectors)
    index = multi_index.build(vectors, book)
    found = {}
    for r in multi_index.search(index, book, index.where("vec_id % 20 = 0").select("vec_id", "vector"), **options).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return found


def exact(x, query, k):
    score = (x * x[query]).sum(axis=1)
    order = [int(i) for i in np.lexsort((np.arange(len(x)), -score)) if i != query][:k]
    return order, score


def test_visiting_all_cells_is_exact_with_ties_and_blocks(spark):
    x, vectors = table(spark)
    found = find(vectors, visit=1.0, entries_per_block=50, queries_per_block=7)
    assert sorted(found) == list(range(0, 600, 20))
    for query, rows in found.items():
        order, score = exact(x, query, 20)
        assert [rows[r][0] for r in range(1, 21)] == order
        assert np.allclose([rows[r][1] for r in range(1, 21)], score[order], rtol=0, atol=1e-12)


def test_recall_with_production_parameters(spark):
    x, vectors = table(spark, 2000, 1)
    hit = sum(len(set(exact(x, q, 20)[0]) & {v for v, _ in rows.values()}) for q, rows in find(vectors).items())
    assert hit / (20 * 100) >= 0.9


def test_few_candidates_and_empty_table(spark):
    x, vectors = table(spark)
    assert {q: len(r) for q, r in find(vectors.where("vec_id < 5")).items()} == {0: 4}
    assert multi_index.fit(multi_index.usable(vectors.limit(0), "vec_id", "embedding")) is None


def test_repeated_ids_are_one_candidate_and_one_query(spark):
    x, vectors = table(spark, 200, 1)
    again = vectors.where("vec_id in (0, 3, 7) and block = 0")
    other = spark.createDataFrame([(5, [9.0] * 16, 0, 0), (20, [-9.0] * 16, 0, 0)], SCHEMA)
    found = find(vectors.unionByName(again).unionByName(again).unionByName(other), visit=1.0, entries_per_block=30)
    for query, rows in found.items():
        ask = x[query] if query != 20 else np.minimum(x[20], -9.0) * 0 - 9.0
        score = (x * ask).sum(axis=1)
        score[5], score[20] = max(score[5], 9.0 * ask.sum()), max(score[20], -9.0 * ask.sum())
        order = [int(i) for i in np.lexsort((np.arange(200), -score)) if i != query][:20]
        assert [rows[r][0] for r in range(1, 21)] == order, query


def test_recall_with_a_hot_vector(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype("float32")
    x[600:] = x[600]
    vectors = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(x)], SCHEMA)
    x = x.astype(float)
    hit = sum(len(set(exact(x, q, 20)[0]) & {v for v, _ in rows.values()}) for q, rows in find(vectors).items())
    assert hit / (20 * 45) >= 0.9
