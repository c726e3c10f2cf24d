import random
import re

import pytest

from sagewell.llm import cascade
from sagewell.llm.cascade import Measures, Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n_dup = sum(1 for i, line in enumerate(lines) if line in lines[:i])
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), n_dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(4)
    made = [None, "", "  \n\t ", "one", "a b " * 40, " x y " * 30, "é" * 50 + "\x1c" + "ü " * 25, "x" * 5000]
    for _ in range(60):
        words = [rng.choice(["of", "the", "Über", "naïve", "#1", "a|b", "日本", "\U0001f600", "$%", "go."]) + str(rng.randrange(9))
                 for _ in range(rng.randrange(90))]
        if len(words) > 30 and rng.random() < 0.6:
            words += words[3:3 + rng.randrange(20)]
        made.append("".join(w + rng.choice([" ", "  ", "\n", "\r\n", "\t", "\x0b", " "]) for w in words))
    return made + ["Same line here.\n" * 9 + " ".join(f"word{i}" for i in range(30))]


def frame(spark, values):
    return spark.createDataFrame(
        [(i, v, True, "r", -1) for i, v in enumerate(values)], "doc_id long, text string, kept boolean, rejected_by string, n_words int")


def test_base_measures_equal_brute_force(spark):
    docs = frame(spark, texts())
    rows = cascade.verdicts(docs, cascade.plan(docs)).collect()
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert found == {i: brute(t) for i, t in enumerate(texts())}
    assert all(not r.kept and r.rules_run == 0 and r.rejected_by == "base" for r in rows if r.base_failed)


def test_order_changes_work_but_no_verdict(spark):
    plain = " ".join(f"word{i} of" for i in range(40))
    values = [plain, plain.upper(), plain.replace("of", "|"), plain.replace("of", "12345678901"), plain + "\n- a" * 3,
              "\n".join(f"w{i} goes on to..." for i in range(20)), " ".join(f"w{i}" for i in range(30)),
              " ".join("x" * 20 + str(i) for i in range(30)), " ".join("abcdefghijklmnopqrstuvwx"), *texts()]
    docs = frame(spark, values)
    order = cascade.plan(docs)
    assert sorted(e.rule for e in order) == sorted(r.name for r in cascade.RULES)
    one = {r.doc_id: r for r in cascade.verdicts(docs, order).collect()}
    two = {r.doc_id: r for r in cascade.verdicts(docs, order[::-1]).collect()}
    for i, value in enumerate(values):
        m = Measures((value or "").encode())
        expected = not m.base_failed and not any(r.rejects(m) for r in cascade.RULES)
        assert one[i].kept == two[i].kept == expected, i
        if not m.base_failed and not expected:
            names = [e.rule for e in order]
            assert one[i].rules_run == names.index(one[i].rejected_by) + 1
    kept = cascade.keep(docs, order)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in one if one[i].kept}


def test_rules_are_ordered_by_rejection_for_cost():
    # Rule 0 rejects most but is slow; 1 rejects half for little; 2 rejects only what 1 rejects, so it is left for last.
    outcomes = [(0b001, 40), (0b110, 30), (0b011, 20), (0b000, 10)]
    order = cascade.order_rules(outcomes, [1.0, 0.01, 0.02], ["slow", "quick", "same"])
    assert [e.rule for e in order] == ["quick", "slow", "same"]
    assert [e.rejected for e in order] == [0.5, 0.8, 0.0]
    assert [e.rule for e in cascade.order_rules([], [0.0, 0.0], ["a", "b"])] == ["a", "b"]


def test_a_rejected_text_runs_no_later_rule(spark):
    def fails(measures):
        raise RuntimeError("must not run")

    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    rules = [Rule("all", lambda m: True), Rule("never", fails)]
    order = [cascade.Estimate("all", 1.0, 1.0), cascade.Estimate("never", 1.0, 0.0)]
    row = cascade.verdicts(docs, order, rules=rules).first()
    assert (row.kept, row.rejected_by, row.rules_run) == (False, "all", 1)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_small_and_empty_tables(spark, n):
    docs = frame(spark, ["few words"] * n)
    assert cascade.verdicts(docs, cascade.plan(docs)).count() == n


def test_a_long_text_is_measured_whole():
    words = [f"w{i % 5000}" for i in range(200_000)] + ["end"]
    m = Measures(" ".join(words).encode())
    assert (m.n_words, m.n_repeat_words) == (200_001, 200_000)


def test_good_documents_stay_and_bad_ones_go(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = cascade.verdicts(docs, cascade.plan(docs)).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert sum(not r.kept for r in bad) / len(bad) > 0.9
