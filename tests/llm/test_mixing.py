from fractions import Fraction

from pyspark.sql import functions as F
from sagewell.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, mix string"


def tree():
    return {"lang": F.col("lang"), "source": F.col("source")}, [
        F.when(F.col("mix_lang") == "a", 3).when(F.col("mix_lang") == "z", 0).otherwise(1), F.lit(1)]


def rows():
    out, n = [], 0
    for lang, source, docs, words in (("a", "s1", 10, 3), ("a", "s2", 400, 5), ("b", "s1", 50, 7), ("z", "s9", 20, 4)):
        for _ in range(docs):
            out.append((n, " ".join(["w"] * words), lang, source, "m"))
            n += 1
    return out + [(None, "w w", None, None, "m"), (n, None, "b", None, "m"), (n + 1, "", "a", "s1", "m"), (5, "w w w", "a", "s1", "m")]


def share(weights, caps, budget):
    """Fill the smallest children first; the rest share what is left by weight."""
    given, left, open_ = {}, budget, dict(weights)
    for name in sorted(weights, key=lambda k: Fraction(caps[k], weights[k])):
        if caps[name] * sum(open_.values()) <= open_[name] * left:
            given[name] = caps[name]
            left -= caps[name]
            del open_[name]
    return given | {k: left * w // sum(open_.values()) for k, w in open_.items()}


def test_budgets_go_to_siblings_first_and_prefixes_fit(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mixed = mixing.mix(docs, *tree(), budget=1500, epochs=2)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    got = mixed.collect()
    assert len(got) == len(rows())
    tokens = {}
    for _, text, lang, source, _ in rows():
        key = lang or "(none)", source or "(none)"
        tokens[key] = tokens.get(key, 0) + len((text or "").split())
    langs = {"a": 3, "b": 1, "(none)": 1}
    caps = {lang: 2 * sum(n for k, n in tokens.items() if k[0] == lang) for lang in langs}
    for lang, budget in share(langs, caps, 1500).items():
        inner = {k: 1 for k in tokens if k[0] == lang}
        for key, want in share(inner, {k: 2 * tokens[k] for k in inner}, budget).items():
            leaf = [r for r in got if (r.mix_lang, r.mix_source) == key]
            assert {r.mix_budget for r in leaf} == {want}
            used = sum(r.mix_copies * r.mix_tokens for r in leaf)
            assert used <= want < used + max(r.mix_tokens for r in leaf) + 1 or want == 2 * tokens[key]
            assert max(r.mix_copies for r in leaf) - min(r.mix_copies for r in leaf) <= 1
    assert all(r.mix_copies == 0 for r in got if r.lang == "z")
    picked = mixing.taken(mixed, docs.columns)
    assert picked.columns == docs.columns and picked.count() == sum(r.mix_copies for r in got)


def test_slices_do_not_change_the_result(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA)
    one = sorted(mixing.mix(docs, *tree(), share=(1, 3)).select("doc_id", "mix_copies").collect(), key=repr)
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 3)
    two = sorted(mixing.mix(docs, *tree(), share=(1, 3)).select("doc_id", "mix_copies").collect(), key=repr)
    assert one == two


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), *tree()).count() == 0
