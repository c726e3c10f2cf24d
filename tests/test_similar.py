import random
import time
from difflib import SequenceMatcher

import pytest

from sagewell.operators import evals, similar


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def noisy(rng, text, share):
    out = []
    for c in text:
        r = rng.random()
        out += [] if r < share / 3 else [c, rng.choice("abc")] if r < 2 * share / 3 else [rng.choice("abcde ")] if r < share else [c]
    return "".join(out)


def texts(seed, n=45):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    made = base + [noisy(rng, t, rng.choice([0.1, 0.3, 0.45])) for t in base] + ["", "a", "é", "ab", "axb", "aaaa", "aaaaa", "ab" * 12, "ab" * 9]
    return made


def brute(left, right, floor, measure):
    found = {}
    for a in set(left):
        for b in set(right):
            held = a in b or b in a
            edits = 1 - distance(a, b) / max(len(a), len(b), 1)
            score = 1.0 if held else edits if measure == "edits" else SequenceMatcher(None, a, b).ratio()
            if score >= floor:
                found[a, b] = (round(score, 9), round(edits, 9))
    return found


@pytest.mark.parametrize("measure,floor", [("blocks", 0.72), ("edits", 0.72), ("blocks", 0.9), ("blocks", 1.0)])
def test_no_match_is_lost(spark, monkeypatch, measure, floor):
    monkeypatch.setattr(similar, "TEXTS", 16)
    monkeypatch.setattr(similar, "RANKED", 40)
    left, right = texts(1), texts(1)[20:] + texts(2)
    frames = [spark.createDataFrame([(t,) for t in side + [None, side[0]]], "text string") for side in (left, right)]
    found = {(r.left_text, r.right_text): (round(r.similarity, 9), round(r.edit_ratio, 9))
             for r in similar.similar_texts(*frames, floor, measure).collect()}
    assert found == brute(left, right, floor, measure)


def test_only_pairs_with_a_rare_pair_of_letters_are_candidates(spark):
    left = spark.createDataFrame([("k1", "opening hours of the museum")], "key string, text string")
    right = spark.createDataFrame([("r1", "opening hours of a museum"), ("r2", "zzzz yyyy zzzz yyyy zzzz xx"), ("r3", "museum"), ("r4", "q")],
                                  "key string, text string")
    assert {r.right_text for r in similar.candidate_pairs(left, right, 0.72).collect()} == {"opening hours of a museum", "museum"}
    with pytest.raises(ValueError, match="two thirds"):
        similar.candidate_pairs(left, right, 0.6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    some = spark.createDataFrame([("a b",), ("",)], "text string")
    assert similar.similar_texts(none, some, 0.72).count() == similar.similar_texts(some, none, 0.72).count() == 0


def test_best_turn_prefers_the_better_and_then_the_earlier(spark):
    cases = spark.createDataFrame([(1, "Opening  hours"), (2, "no such thing")], "case_id long, expected string")
    turns = spark.createDataFrame(
        [(5, 0, "user", "opening hour?"), (5, 2, "user", "the opening hours today"), (5, 4, "user", "opening hours"), (5, 1, "agent", "opening hours"),
         (6, 0, "user", "bye")], "conv_id long, turn long, role string, message string")
    assert [(r.conv_id, r.case_id, r.similarity, r.turn) for r in evals.best_user_turns(cases, turns).collect()] == [(5, 1, 1.0, 2)]


def test_no_side_of_the_join_becomes_a_map_on_the_driver(spark):
    rows = [(str(i), f"text number {i} of a few") for i in range(20)]
    left, right = (spark.createDataFrame(rows, "key string, text string") for _ in range(2))
    plan = similar.candidate_pairs(left, right, 1.0)._jdf.queryExecution().executedPlan().toString()
    # Only texts of at most one letter are broadcast, of which there are no more than letters.
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastNestedLoopJoin") == 2


def syllables(seed, n, least, most):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "ing", "tion", "ble", "wh", " ", " ", " ", ", ", ". "]
    out = []
    for _ in range(n):
        size, text = rng.randrange(least, most), ""
        while len(text) < size:
            text += rng.choice(parts)
        out.append(text)
    return out


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        corner = 0
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def near(left, right, floor, measure):
    return {(left[i], right[j]) for found in similar.alike(left, right, floor, measure) for i, j in zip(*(f.tolist() for f in found), strict=True)}


@pytest.mark.parametrize("ranked", [1024, 7])
def test_no_match_is_lost_among_long_texts_with_popular_letters(monkeypatch, ranked):
    monkeypatch.setattr(similar, "RANKED", ranked)
    monkeypatch.setattr(similar, "WIDE", 500)
    rng = random.Random(3)
    left = syllables(1, 30, 150, 420)
    right = [noisy(rng, t, share) for t in left for share in (0.02, 0.1, 0.25, 0.4)] + [t[60:] + t[:60] for t in left] + syllables(2, 20, 190, 210)
    close = [(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.72]
    found = near(left, right, 0.72, "blocks")
    assert len(close) >= 30 and found >= set(close) and len(found) < 200


def test_letters_in_common_are_counted_beyond_one_number():
    left, right = syllables(4, 6, 1, 400) + ["", "x"], syllables(5, 8, 1, 500) + ["", "ab"]
    codes, sizes = similar._codes(right)
    known, rows = similar.np.unique(codes), similar.np.repeat(similar.np.arange(len(right)), sizes)
    places = similar._Places(similar._letters(codes, known), rows, sizes, len(known))
    mine = [similar._letters(similar._codes([t])[0], known) for t in left]
    everyone = similar.np.tile(similar.np.arange(len(right)), (len(left), 1))
    found = places.common(mine, everyone, places.masks.shape[1], 1000, 1000)
    assert found.tolist() == [[longest_common(a, b) for b in right] for a in left]


@pytest.mark.parametrize("measure", ["blocks", "edits"])
def test_texts_of_one_language_are_told_apart_many_at_once(measure):
    left, right = syllables(6, 400, 20, 380), syllables(7, 4000, 20, 380)
    start = time.process_time()
    found = near(left, right + [t[2:] + "x" for t in left[:100]], 0.72, measure)
    # One by one, 1.6 million pairs of which half share rare letters take minutes.
    assert len(found) >= 95 and time.process_time() - start < 30


def test_what_a_text_does_not_hold_stays_in_its_task():
    held, texts = syllables(8, 300, 2, 260), syllables(9, 200, 100, 300)
    texts += ["so " + t + " it is" for t in held]
    words = similar.np.zeros(1 << 14, similar.np.uint64)
    for hashes in similar._own_hashes(held):
        for k in range(similar.MARKS):
            mark = similar._mark(hashes, k, 64 * len(words))
            similar.np.bitwise_or.at(words, (mark >> 6).astype(int), similar.np.uint64(1) << (mark & similar.np.uint64(63)))
    rows, hashes = similar._held_in(texts, words, similar.np.unique([len(t) for t in held]))
    whole = dict(zip(similar._own_hashes(held)[1].tolist(), held, strict=True))
    met = {(texts[r], whole[h]) for r, h in zip(rows.tolist(), hashes.tolist(), strict=True) if h in whole}
    assert met == {(t, h) for t in texts for h in held if h in t}
    # Every text has hundreds of letter pairs that some other has too; none of them leaves.
    assert len(rows) < 1.1 * len(met) + 20


def test_texts_held_are_found_whatever_their_length(spark):
    rng = random.Random(11)
    long = syllables(10, 25, 60, 700) + ["añ" * 70, "日本語" * 30, "aaaa" * 40]
    short = [t[(i := rng.randrange(len(t))): i + rng.randrange(1, 300)] for t in long for _ in range(6)] + ["aa" * 9, "x", "", "añaña"]
    frames = [spark.createDataFrame([(t,) for t in side], "text string") for side in (short, long)]
    found = {(r.left_text, r.right_text) for r in similar.similar_texts(*frames, 1.0).collect()}
    assert found == {(a, b) for a in short for b in long if a in b or b in a}
