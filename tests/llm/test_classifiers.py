import numpy as np
import pytest

from sagewell.llm import langid, quality
from sagewell.llm.shared import fold
from sagewell.sources.tables import table

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents").withColumn("held", fold("doc_id", 4) == 2)
    model = langid.fit(docs.where("not held").select("lang", "text"))
    known = {r.doc_id: r.lang for r in docs.where("held").collect()}
    rows = langid.identify(docs.where("held"), model).collect()
    assert sum(known[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_undetermined_texts_and_odd_rows(spark):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze"), (None, "x"), ("fr", None)],
                                  "lang string, text string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 $%", "en"), (4, "the dog", "x"), (None, "der Hund", "x"),
                                  (4, "the dog", "x"), (5, "und " * 400_000, "x")], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()), key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (4, "en"), (5, "de")], key=repr)
    assert sorted(r.doc_id or 0 for r in langid.known_language(docs, model).collect()) == [0, 4, 4, 5]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(train.limit(0))).collect()} == {"und"}


def test_slices_do_not_change_the_features(monkeypatch):
    whole = np.sort(np.concatenate(list(langid.slots("abc déf" * 50))))
    monkeypatch.setattr(langid, "SLICE", 16)
    assert (np.sort(np.concatenate(list(langid.slots("abc déf" * 50)))) == whole).all()


@pytest.mark.parametrize("classes", [1, 2, 4, 9, 40])
def test_codewords_differ(classes):
    code = langid.codewords(classes)
    assert len({tuple(c) for c in code}) == classes


def test_quality_of_held_out_documents(spark):
    stats = quality.document_statistics(table(spark, FOLDER, "documents"), fold("doc_id", 5)).cache()
    labels = quality.labels_of(table(spark, FOLDER, "labels"))
    known = stats.join(labels, stats.doc_id == labels.labelled_id).cache()
    model = quality.fit(known.where("fold > 1"), known.where("fold = 1"))
    truth = {r.doc_id: r.label for r in known.where("fold = 0").collect()}
    rows = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert len(rows) == 1000 and all(0 <= s <= 1 for s in rows.values())
    assert sum((rows[d] >= 0.3) == (t == 1) for d, t in truth.items()) / len(truth) > 0.95


def test_quality_of_odd_texts_and_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "a", "s"), (3, "x" * 400_000, "s"), (3, "x", "s"),
                                  (4, "\x00\n \t", "s")], "doc_id long, text string, stats string")
    stats = quality.document_statistics(docs, fold("doc_id", 5))
    none = spark.createDataFrame([], "stats array<double>, label double")
    assert {r.score for r in quality.score(stats, quality.fit(none, none)).collect()} == {0.5}
    assert quality.document_statistics(docs.limit(0), fold("doc_id", 5)).count() == 0


def test_pooling_is_isotonic():
    knots, values = quality.pooled(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 1, 2]))
    assert values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [1.0, 2.5, 4.0]


def test_languages_of_equal_texts_are_an_ambiguous_tie(spark):
    rows = [(i, "de" if i % 2 else "en", "the same words in both languages") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = langid.identify(docs, langid.fit(docs.select("lang", "text"))).collect()
    assert {(r.lang_pred, r.score, r.ambiguous) for r in found} == {("de", 0.5, True)}
