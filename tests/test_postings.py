import random

import pytest
from pyspark.sql import functions as F

from sagewell.operators import postings as lists
from sagewell.operators.scan import cover_density

QUERY = "query_id long, normalized string, terms array<string>"


@pytest.fixture()
def small_pieces(monkeypatch):
    monkeypatch.setattr(lists, "BLOCK", 4)
    monkeypatch.setattr(lists, "SALT_ROWS", 20)
    monkeypatch.setattr(lists, "SHARD_ROWS", 200)


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "a", "an", "and", "ing"]
    weights = [1.0 / (i + 1) for i in range(60)] + [30, 20, 10, 5, 5, 3]
    made = {f"c{i:03d}": " ".join(rng.choices(vocabulary, weights, k=rng.randrange(3, 40))) for i in range(n)}
    return made | {"c900": "the wandering of things", "c901": "xw5 theory", "c902": "", "c903": "w5 w5 w5 w5 w5 w5 w6 w6"}


def asked(least=2):
    texts = ["the of a w1 w2 w3 w40", "the", "w5", "w59 w58 w57", "unknown words", "", "a", "w1 the w2", "the of and an w0",
             "wander", "of thing", "w5 the", "w6 w5", "w5 w5 w6", "the of", "andering of thing"]
    return [(i, t, list(dict.fromkeys(w for w in t.split(" ") if len(w) >= least))) for i, t in enumerate(texts)]


def overlap_brute(chunks, queries, k):
    found = {}
    for query_id, phrase, terms in queries:
        scores = [(-(len(set(terms) & set(text.split())) + (2.0 if phrase in text else 0.0)), c) for c, text in chunks.items()]
        found[query_id] = [(c, -s) for s, c in sorted(scores) if s < 0][:k] if terms else []
    return found


def density_brute(chunks, queries, k):
    found = {}
    for query_id, _, terms in queries:
        held = [(-round(cover_density(t, set(terms)), 9), c) for c, t in chunks.items() if terms and set(terms) <= set(t.split())]
        found[query_id] = [(c, -d) for d, c in sorted(held)][:k]
    return found


def rows(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.chunk_id, r.lexical))
    return found


def filled(found, queries):
    return {q: found.get(q, []) for q, _, _ in queries}


@pytest.mark.parametrize("k,rare", [(3, 0.01), (10, 0.2), (500, 0.01)])
def test_token_overlap_equals_brute_force(spark, small_pieces, k, rare):
    texts, queries = corpus(), asked()
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, search_text string")
    stored = lists.build_postings(chunks)
    assert stored.lists.select("shard").distinct().count() > 1 and stored.lists.where("salt > 0").count() > 0
    found = lists.token_overlap(spark.createDataFrame(queries, QUERY), chunks, stored, k, rare=rare)
    assert filled(rows(found), queries) == overlap_brute(texts, queries, k)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_all_terms_equals_brute_force(spark, small_pieces, k):
    texts, queries = corpus(seed=2), asked(1)
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, search_text string")
    found = lists.all_terms(spark.createDataFrame(queries, QUERY), chunks, lists.build_postings(chunks), k)
    assert filled(rows(found), queries) == density_brute(texts, queries, k)


def test_lists_hold_every_word_once_a_chunk_in_falling_blocks(spark, small_pieces):
    texts = corpus(seed=3)
    stored = lists.build_postings(spark.createDataFrame(list(texts.items()), "chunk_id string, search_text string"))
    held = {}
    for b in sorted(stored.lists.collect(), key=lambda b: (b.term, b.salt, b.block)):
        assert len(b.entries) <= 4
        held.setdefault((b.term, b.salt), []).append(b.most)
    assert all(most == sorted(most, reverse=True) for most in held.values())
    total = sum(len(set(t.split())) for t in texts.values())
    assert stored.lists.selectExpr("sum(size(entries))").first()[0] == total == stored.terms.selectExpr("sum(df)").first()[0]
    assert stored.chunks == len(texts)


def test_no_python_and_no_unasked_partition_is_read(spark, small_pieces, tmp_path):
    texts = corpus(seed=4)
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, search_text string")
    stored = lists.build_postings(chunks, str(tmp_path / "table"))
    again = lists.read_postings(spark, str(tmp_path / "table"))
    words = lists._asked_terms(spark.createDataFrame([(1, "w7", ["w7"])], QUERY), again)
    read = lists._lists_of(words, again)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "Python" not in plan and "Arrow" not in plan
    shard = words.first()["shard"]
    assert {r.shard for r in read.collect()} == {shard} and stored.lists.select("shard").distinct().count() > 1


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "chunk_id string, search_text string")
    stored = lists.build_postings(chunks)
    queries = spark.createDataFrame(asked(), QUERY)
    assert lists.token_overlap(queries, chunks, stored, 5).count() == 0
    assert lists.all_terms(queries, chunks, stored, 5).count() == 0
    some = spark.createDataFrame([("c", "w1 w2")], "chunk_id string, search_text string")
    assert lists.token_overlap(queries.limit(0), some, lists.build_postings(some), 5).count() == 0


def test_a_task_writes_a_bounded_share_of_the_lists(spark, small_pieces, tmp_path):
    texts = corpus(n=600, seed=6)
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, search_text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stored = lists.build_postings(chunks, str(tmp_path / "table"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = stored.terms.selectExpr("sum(df)").first()[0]
    held = [r["n"] for r in stored.lists.groupBy(F.input_file_name()).agg(F.sum(F.size("entries")).alias("n")).collect()]
    assert stored.lists.select("shard").distinct().count() < len(held) and max(held) < total / 8
