import math
import random

import brute
import pytest

from pyspark.sql import functions as F
from sagewell.llm import katz
from sagewell.llm.shared import fold


def texts():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "W1 w1\tÉa É\x0bw2"), (None, "w1 w2"), (3, "w1"), (3, "w1"),
                   (203, "the same " * 20_000)]


@pytest.mark.parametrize("split,tokens", [(200_000, 3_000_000), (3, 40)])
def test_scores_equal_plain_python_also_with_split_contexts_and_small_blocks(spark, monkeypatch, split, tokens):
    monkeypatch.setattr(katz, "SPLIT", split)
    rows = texts()
    model = brute.Katz([t for i, t in rows if brute.fold(i, 10)])
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = katz.katz_scores(docs, fold("doc_id", 10) == 0, tokens_per_block=tokens, tokens_per_bucket=500).collect()
    want = sorted((brute.fold(i, 10) == 0, len(brute.tokens(t)), round(model.base(t), 5), round(model.score(t), 5))
                  for i, t in rows)
    assert sorted((r.held_out, r.n_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {model.total}


def test_every_context_sums_to_one():
    model = brute.Katz([t for i, t in texts() if brute.fold(i, 10)])
    for context in list(model.two)[:40]:
        assert math.isclose(sum(model.pair(context, w) for w in model.one) + model.pair(context, "never seen"), 1.0)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.katz_scores(docs, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert katz.katz_scores(docs.where("doc_id = 2"), F.lit(True)).count() == 0
