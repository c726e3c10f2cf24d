"""Steps that every search shares do their work once and in bounded memory."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sagewell.functions import text as tx
from sagewell.operators import chunks as ops
from sagewell.operators import scan
from sagewell.operators.embedding import Embedder, norms

BLANKS = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def test_blanks_are_found_by_one_range_test(spark):
    texts = [f"{b}a{b}b {b}c.​{b}" for b in BLANKS] + ["", "   ", "a b", "\U0001f600　 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.collapse(F.col("t")).alias("c"), tx.strip(F.col("t")).alias("s")).collect()
    for row in rows:
        kept = re.escape("".join(BLANKS))
        assert row["c"] == re.sub(f"[{kept}]+", " ", row["t"]).strip(" ")
        assert row["s"] == row["t"].strip("".join(BLANKS))
    assert tx.QUICK_BLANK.startswith(r"[\x{0}-\x{20}")


def test_a_page_is_named_once_and_not_once_a_chunk(spark):
    pages = spark.createDataFrame(
        [("https://A.example.org/x//y/", "t", "word " * 900), (None, "t", "word " * 900)], "source_url string, title string, text string"
    ).withColumn("crawled_at", F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'"))
    cut = ops.chunk(ops.with_canonical_url(pages), "text").withColumn("section", F.lit("s"))
    rich = ops.enrich_chunks(cut, [("a", ["word"])], {"a": 7}, [], default_category="b")
    plan = rich._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "regexp_extract" not in above  # the parts of the URL are cut out below the chunks
    late = ops.enrich_chunks(ops.chunk(pages, "text").withColumn("section", F.lit("s")), [("a", ["word"])], {"a": 7}, [], default_category="b")
    assert sorted(map(str, rich.select(sorted(rich.columns)).collect())) == sorted(map(str, late.select(sorted(late.columns)).collect()))
    assert rich.count() > 2


def test_a_remembered_token_takes_a_third_of_its_room():
    embedder = Embedder()
    first = embedder.counts(["one two three", "two", None, ""])
    for start in range(0, 3000, 100):
        embedder.counts([" ".join(f"w{i}" for i in range(start, start + 100))])
    assert (embedder.counts(["one two three", "two", None, ""]) == first).all()
    room = embedder.slots.nbytes + embedder.signs.nbytes
    assert room <= 2 * 40 * len(embedder.place) and len(embedder.slots) >= len(embedder.place)


def test_a_scan_rounds_only_pairs_that_may_be_among_the_best(monkeypatch):
    rng = np.random.default_rng(2)
    draw = lambda n, size: [" ".join(f"w{int(w)}" for w in rng.integers(0, 400, size) ** 2 // 400) for _ in range(n)]
    texts, asked = draw(3000, 40) + ["w3 w4"] * 9 + [""], draw(40, 6) + ["w3 w4", "w4", "", "w3 w4"]
    names = [f"{'longprefix' if i % 2 else ''}{i % 2900:05d}" for i in range(len(texts))]
    chunks = pd.DataFrame({"chunk_id": names, "vector_text": texts, "search_text": texts})
    rows = [{"query_id": q, "vector_text": t, "normalized": t, "terms": sorted(set(t.split()))} for q, t in enumerate(asked)]
    rounded, plain = [], np.round
    monkeypatch.setattr(scan.np, "round", lambda x, *rest, **named: (rounded.append(np.size(x)), plain(x, *rest, **named))[1])
    task = scan._topk_task(scan._Group(rows, "overlap", False, True, True), 5, {"vector": "base", "lexical": "lexical"})
    found = pd.concat(task([chunks[:1500], chunks[1500:]]))
    assert sum(rounded) < len(rows) * len(texts) / 2
    embedder = Embedder()
    held, wanted = embedder.counts(texts), embedder.counts(asked)
    cosine = plain(wanted @ held.T / np.outer(norms(wanted), norms(held)), 6)
    for q, row in enumerate(rows):
        shared = [len(set(row["terms"]) & set(t.split())) + (2.0 if row["terms"] and row["normalized"] in t else 0.0) for t in texts]
        for channel, value in (("vector", cosine[q]), ("lexical", shared)):
            best = sorted((-v, name) for v, name in zip(value, names) if channel == "vector" or v > 0)[:5]
            mine = found[(found["query_id"] == q) & (found["channel"] == channel)]
            assert sorted(zip(-mine["base" if channel == "vector" else "lexical"], mine["chunk_id"])) == best


def test_one_product_serves_two_chunks_of_like_length(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(w)}" for w in rng.integers(0, 60, size)) for size in rng.integers(0, 90, 150)] + ["w1 " * 700, "w2 " * 3000, ""]
    asked = ["w1 w2 w3", "", "w4 " * 300 + "w5", "w1", " ".join(f"w{i}" for i in range(60))] * 3
    rows = [{"query_id": q, "vector_text": t, "normalized": t, "terms": sorted(set(t.split()))} for q, t in enumerate(asked)]
    embedder = Embedder()
    wanted = embedder.counts(asked)
    for size in (153, 152, 2, 1):
        chunks = pd.DataFrame({"chunk_id": [f"{i:03d}" for i in range(size)], "vector_text": texts[-size:], "search_text": texts[-size:]})
        group = scan._Group(rows, "overlap", False, True, True)
        batch, = group.batches([chunks])
        assert len(batch.packed) == size // 2 and sorted(batch.names) == sorted(chunks["chunk_id"])
        held = embedder.counts(batch.chunks["vector_text"])
        assert (batch.counts == held).all() and (batch.norms == norms(held)).all()
        for block in group.blocks:
            assert block.exact(batch)
            assert (block.products(batch) == wanted[block.ids] @ held.T).all()
            both = [[len(set(rows[q]["terms"]) & set(t.split())) for t in batch.chunks["search_text"]] for q in block.ids]
            for frequent, half in ((1, scan.HALF), (1500, scan.HALF), (10**9, scan.HALF), (10**9, 3)):
                monkeypatch.setattr(scan, "FREQUENT", frequent)
                monkeypatch.setattr(scan, "HALF", half)
                assert (block.shared(batch) == both).all()
            monkeypatch.undo()


def test_chunks_are_embedded_once_for_twice_as_many_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(f"c{i}", f"w{i} w{i + 1} w3") for i in range(20)], "chunk_id string, vector_text string")
    asked = spark.createDataFrame([(i, f"w{i} w3") for i in range(8)], "query_id long, vector_text string")
    written = []
    plain = scan.materialized
    monkeypatch.setattr(scan, "materialized", lambda df, purpose: (written.append(purpose), plain(df, purpose))[1])

    def found(most):
        monkeypatch.setattr(scan, "MAX_QUERIES", most)
        return sorted(map(tuple, scan.scan_topk(texts, asked, 3).collect()))

    usual = found(4)
    assert len(usual) == 24 and not written
    assert found(2) == usual and len(written) == 2
