import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from sagewell.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def norm(text):
    return (text or "").translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))


def test_stages_hand_on_the_columns_and_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 --", "en", "src0", 6), (None, "the and of", None, None, None)],
                                docs.schema)
    now = docs.unionByName(odd)
    rows = [tuple(r) for r in now.select("doc_id", "text").collect()]
    seen = []
    for name, stage in pipeline.STAGES:
        before = rows
        now = stage(spark, now, FOLDER).persist()
        seen.append(name)
        if name == "pieces":
            assert now.count() == len(before)
            break
        assert now.columns == docs.columns
        rows = [tuple(r) for r in now.select("doc_id", "text").collect()]
        assert set(rows) <= set(before)
        if name == "language":
            assert {i for i, _ in before} - {i for i, _ in rows} == {9001, 9002}
        elif name == "exact_dedup":
            assert len(rows) == len({norm(t) for _, t in before})
        elif name == "ngram_join":
            groups = brute.similar(before)
            assert {r[0] for r in rows} == {g[1] for g in groups if g[2] > 1} | {g[0] for g in groups if g[2] == 1}
        else:
            assert len(rows) == len(set(rows))
    assert seen == [n for n, _ in pipeline.STAGES]


def test_stages_take_an_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, FOLDER, "documents").limit(60)
    own = ["__id", "__node", "__sha", "node", "root", "kept", "mix_tokens", "mix_copies", "a.b", "extra_0"]
    wide = docs.toDF(*docs.columns).select("*", *[F.concat(F.lit(f"{name}:"), "doc_id").alias(name) for name in own])
    twice = wide.unionByName(wide.limit(5)).unionByName(wide.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for rows in (wide, twice):
        now = rows
        for name, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, FOLDER)
            assert now.columns == rows.columns, name
        left = now.collect()
        assert left
        assert all(r[c] == f"{c}:{r.doc_id}" for r in left if r.doc_id is not None for c in own)
