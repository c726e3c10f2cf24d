"""Similarity join of two text tables: letters in common first, then their common subsequence, then the exact ratio.

Both ratios count letters that stand in the same order in both texts, so no match is lost by two bounds: the letters in
common, whatever their order, and the longest common subsequence. A task compares the letters of a block of texts with
those of another in one matrix product, and follows the common subsequences of a text with all that are left at once,
63 places to a number, near the diagonal only. ``SequenceMatcher`` starts a block at a letter that is not popular in a
long right text; with few such letters there are few blocks, and texts of few blocks share many triples of letters.
Blocks hold texts of like length, and blocks whose lengths rule out a match never meet.

A text that holds another one holds its first and last ``2^t`` letters, which cover it. Windows of that length are
looked up in a bit set of the hashed texts, so that next to nothing but the texts held leaves a task.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.session import materialized

#: Texts, and letters, that a block has at most; both sides of a task are such blocks.
TEXTS, LETTERS = 32_768, 8_000_000
#: Right texts whose matrices a task holds at once, and left texts that one product compares with them.
ROWS, STRIP = 4_096, 256
#: Letters that have a count of their own; more share one.
RANKED = 1_024
#: Numbers in a matrix, at most, and counts of triples of letters.
CELLS, TRIPLES = 16_000_000, 2_048
#: Numbers that common subsequences work on in a step.
WIDE = 24_000
#: Length from which ``SequenceMatcher`` has popular letters.
POPULAR = 200
#: Places of a text in one number; the bit left over takes the carry.
PLACES = 63
#: Bits of the set of held texts: for each of them, at most, and set by a hash; and rows that leave a task at once.
BITS, MOST_BITS, MARKS, SENT = 64, 1 << 28, 3, 20_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as numbers, one after the other, and where each text ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


# --- texts alike -----------------------------------------------------------------------------


def _counted(rows: np.ndarray, classes: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How often each class comes in each text."""
    return np.bincount(rows * shape[1] + classes, minlength=shape[0] * shape[1]).reshape(shape).astype(np.int32)


def _triples(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and class of every three neighbouring letters."""
    whole = rows[:-2] == rows[2:] if len(rows) > 2 else np.zeros(0, bool)
    wide = codes.astype(np.uint64)
    mixed = (wide[:-2] * 1_000_003 + wide[1:-1]) * 1_000_003 + wide[2:] if len(rows) > 2 else wide[:0]
    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return rows[: len(whole)][whole], (mixed[whole] % TRIPLES).astype(np.int64)


class _Places:
    """Bit sets of the places of every letter, of many texts at once."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, letters: int):
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - starts[rows]
        words = max(1, -(-int(sizes.max(initial=0)) // PLACES))
        self.masks = np.zeros((letters + 1, words, len(sizes)), np.uint64)  # the last letter is in no text
        flat, n = self.masks.reshape(-1), len(sizes)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place, minlength=1)) if len(place) else np.zeros(0, np.int64)
        begin = 0
        for at, end in enumerate(ends):  # at one place, every text has one letter
            here = order[begin:end]
            flat[(codes[here] * words + at // PLACES) * n + rows[here]] |= np.uint64(1 << at % PLACES)
            begin = end

    def common(self, texts: list[np.ndarray], others: np.ndarray, words: int, behind: int, ahead: int) -> np.ndarray:
        """Lengths of the longest common subsequences of each text and the row of others beside it.

        Only places up to ``behind`` before and ``ahead`` after a letter's own count: who needs many letters in common leaves
        out few of either text. The numbers of a text work on one letter after the other, each a letter behind the one
        before it, which hands on its carry.
        """
        n, size, none = others.shape[1], max(map(len, texts)), len(self.masks) - 1
        first, held, at = np.zeros((len(texts), size), np.int64), [], 0
        for k, text in enumerate(texts):
            used, letters = np.unique(np.append(text, none), return_inverse=True)
            first[k] = at + words * letters[-1]
            first[k, : len(text)] = at + words * letters[:-1]
            held.append(np.empty((len(used), words, n), np.uint64))
            at += words * len(used)
            for letter, rows in zip(used, held[-1], strict=True):
                np.take(self.masks[letter, :words], others[k], axis=1, out=rows, mode="clip")
        rows, order = np.concatenate(held).reshape(-1, n), np.arange(words)
        full, top = np.full((words, len(texts), n), (1 << PLACES) - 1, np.uint64), np.uint64(PLACES)
        state, carry = full.copy(), np.zeros((words + 1, len(texts), n), np.uint64)
        hit, total = np.empty_like(state), np.empty_like(state)
        low = -1
        for step in range(size + words - 1):
            begin = max(0, -((PLACES - 1 + behind - step) // (PLACES + 1)), step - size + 1)
            end = min(words - 1, (step + ahead) // (PLACES + 1), step) + 1
            if begin >= end:
                low = words
                continue
            if begin and low >= begin:  # the number before this one is done
                carry[begin] = 0
            low = begin
            now, here, found, added = order[begin:end], state[begin:end], hit[: end - begin], total[: end - begin]
            np.take(rows, first[:, step - now].T + now[:, None], axis=0, out=found, mode="clip")
            np.bitwise_and(found, here, out=found)
            np.add(here, found, out=added)
            np.add(added, carry[begin:end], out=added)
            np.right_shift(added, top, out=carry[begin + 1: end + 1])
            np.bitwise_xor(here, found, out=here)
            np.bitwise_or(here, added, out=here)
            np.bitwise_and(here, full[begin:end], out=here)
        return words * PLACES - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def _letters(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers of the letters among the known ones; the next number for any other."""
    at = np.searchsorted(known, codes)
    return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == codes), at, len(known))


def alike(mine: list[str], theirs: list[str], floor: float, measure: str):
    """Places ``(i, j)`` of the texts that may reach ``floor``, as pairs of arrays."""
    mine_at, theirs_at = (sorted(range(len(x)), key=lambda i: len(x[i])) for x in (mine, theirs))
    split = sum(len(t) < POPULAR for t in theirs) if measure == "blocks" else len(theirs)
    for part, rows, popular in ((theirs_at[:split], ROWS, False), (theirs_at[split:], ROWS, True)):
        for begin in range(0, len(part), rows):
            yield from _met(mine, mine_at, theirs, np.array(part[begin: begin + rows]), floor, measure, popular)


def _met(mine: list[str], left: list[int], theirs: list[str], right: np.ndarray, floor: float, measure: str, popular: bool):
    reach = 1 / floor if measure == "edits" else (2 - floor) / floor
    shortest, longest = len(theirs[right[0]]), len(theirs[right[-1]])
    left = [i for i in left if shortest <= reach * len(mine[i]) + 1e-9 and len(mine[i]) <= reach * longest + 1e-9]
    codes, sizes = _codes([theirs[j] for j in right])
    known = np.unique(codes)
    if not left:
        return
    if len(right) > 1 and len(right) * len(known) * -(-longest // PLACES) > CELLS:
        half = len(right) // 2
        yield from _met(mine, left, theirs, right[:half], floor, measure, popular)
        yield from _met(mine, left, theirs, right[half:], floor, measure, popular)
        return
    classes = min(max(1, len(known)), RANKED)
    rows = np.repeat(np.arange(len(right)), sizes)
    own = _letters(codes, known)
    shape, places = (len(right), classes), None
    if popular:
        # A block but the first begins at a letter that the right text has seldom; one of n letters has n - 2 triples.
        _, at, often = np.unique(rows * len(known) + own, return_inverse=True, return_counts=True)
        seldom = often[at] <= sizes[rows] // 100 + 1
        counts, triples = _counted(rows[seldom], own[seldom] % classes, shape), _counted(*_triples(codes, rows), (len(right), TRIPLES))
    else:
        counts = _counted(rows, own % classes, shape)
    for begin in range(0, len(left), STRIP):
        strip = left[begin: begin + STRIP]
        left_codes, left_sizes = _codes([mine[i] for i in strip])
        left_rows, letters = np.repeat(np.arange(len(strip)), left_sizes), _letters(left_codes, known)
        shared = letters < len(known)
        a, b = left_sizes[:, None], sizes[None, :]
        need = floor * (np.maximum(a, b) if measure == "edits" else (a + b) / 2) - 1e-9
        may = np.maximum(a, b) <= reach * np.minimum(a, b) + 1e-9
        least = _lesser(_counted(left_rows[shared], letters[shared] % classes, (len(strip), classes)), counts)
        if popular:
            may &= _lesser(_counted(*_triples(left_codes, left_rows), (len(strip), TRIPLES)), triples) >= need - 2 * (least + 1)
        else:
            may &= least >= need
        texts = np.split(letters, np.cumsum(left_sizes)[:-1])
        many = may.sum(axis=1)
        order = [k for k in np.argsort(-many, kind="stable") if many[k]]
        while order:
            # Texts with about as many others go together: wide rows make up for the price of each step.
            others = [np.flatnonzero(may[k]) for k in order[:1]]
            words = max(1, -(-int(sizes[others[0][-1]]) // PLACES))
            group, order = order[: (n := max(1, WIDE // (many[order[0]] * words)))], order[n:]
            others += [np.flatnonzero(may[k]) for k in group[1:]]
            words = max(1, max(-(-int(sizes[x[-1]]) // PLACES) for x in others))
            left_out = [math.floor(max(float((x - need[k, o]).max()) for k, o in zip(group, others, strict=True) for x in [at(k, o)]) + 1e-9)
                        for at in (lambda k, o: left_sizes[k], lambda k, o: sizes[o])]
            places = places or _Places(own, rows, sizes, len(known))
            padded = np.array([np.pad(x, (0, len(others[0]) - len(x)), mode="edge") for x in others])
            common = places.common([texts[k] for k in group], padded, words, *left_out)
            for k, x, found in zip(group, others, common, strict=True):
                x = x[found[: len(x)] >= need[k, x]]
                if len(x):
                    yield np.full(len(x), strip[k]), right[x]


def _lesser(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The lesser counts of every row of mine and every row of theirs, added up over the classes.

    Counts become rows of ones, as many columns a class as either side may share, and their product adds up.
    """
    most = np.minimum(mine.max(axis=0, initial=0), theirs.max(axis=0, initial=0))
    classes = np.repeat(np.arange(len(most)), most)
    least = np.arange(len(classes)) - np.repeat(np.cumsum(most) - most, most) + 1
    ones, width = (mine[:, classes] >= least).astype(np.float32), max(1, CELLS // max(1, len(classes)))
    return np.concatenate([ones @ (theirs[i: i + width][:, classes] >= least).astype(np.float32).T for i in range(0, len(theirs), width)], axis=1)


# --- texts held ------------------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def _windows(codes: np.ndarray):
    """``t, hashes`` of all windows of ``2^t`` letters, from two letters on."""
    hashes, t = _mixed(codes.astype(np.uint64) + np.uint64(1)), 0
    while len(hashes) > 1 << t:
        hashes = _mixed(hashes[: -(1 << t)] * np.uint64(0x9E3779B97F4A7C15) + hashes[1 << t:])
        t += 1
        yield t, hashes


def _whole(first: np.ndarray, last: np.ndarray, size) -> np.ndarray:
    """Hash of a text from its first and last window."""
    return _mixed(first * np.uint64(0xD6E8FEB86659FD93) ^ (last + np.asarray(size).astype(np.uint64)))


def _mark(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """One of the places of each hash in a set of so many bits, a power of two."""
    return (hashes + np.uint64(k) * (hashes >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)


def _in_set(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the set."""
    at = np.arange(len(hashes))
    for k in range(MARKS):
        mark = _mark(hashes[at], k, 64 * len(words))
        at = at[(words[mark >> np.uint64(6)] >> (mark & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _own_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first window and of the whole of texts of two letters or more."""
    codes, sizes = _codes(texts)
    starts = np.cumsum(sizes) - sizes
    tiers = np.frexp(sizes)[1] - 1
    first, whole = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    for t, hashes in _windows(codes):
        rows = np.flatnonzero(tiers == t)
        first[rows] = hashes[starts[rows]]
        whole[rows] = _whole(first[rows], hashes[starts[rows] + sizes[rows] - (1 << t)], sizes[rows])
        if t == tiers.max():
            break
    return first, whole


def _held_in(texts: list[str], words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of what the texts hold that may be in the set of texts of these lengths."""
    codes, sizes = _codes(texts)
    ends = np.cumsum(sizes)
    rows, longest = np.repeat(np.arange(len(texts)), sizes), int(sizes.max(initial=0))
    found = [[], []]
    for t, hashes in _windows(codes):
        some = lengths[(lengths >= 1 << t) & (lengths < 2 << t) & (lengths <= longest)]
        if 1 << t > longest:
            break
        if not len(some):
            continue
        at = _in_set(words, hashes)
        for size in some.tolist():
            here = at[at + size <= ends[rows[at]]]
            whole = _whole(hashes[here], hashes[here + size - (1 << t)], size)
            hit = _in_set(words, whole)
            found[0].append(rows[here[hit]])
            found[1].append(whole[hit])
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held = np.unique(np.rec.fromarrays([np.concatenate(f) for f in found], names="row,hash"))
    return held["row"], held["hash"]


def _slices(texts: list[str]):
    """Begin and end of runs of texts of a bounded number of letters."""
    begin = letters = 0
    for i, text in enumerate(texts):
        if i > begin and letters + len(text) > LETTERS // 16:
            yield begin, i
            begin, letters = i, 0
        letters += len(text)
    if texts:
        yield begin, len(texts)


def _holding(short: DataFrame, sizes: dict[int, int], long: DataFrame, names: list[str]) -> DataFrame:
    """Texts of two letters or more, of which there are so many a size, with every text that holds them."""
    context = short.sparkSession.sparkContext
    short, lengths = short.where(F.length("text") > 1), np.array(sorted(n for n in sizes if n > 1), np.int64)
    bits = min(MOST_BITS, 1 << max(16, (BITS * sum(sizes.values())).bit_length()))

    def keyed(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_own_hashes(texts[begin:end])[1].view(np.int64)), batch.column(0).slice(begin, end - begin)], ["hash", names[0]])

    def marked(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _slices(texts):
                for hashes in _own_hashes(texts[begin:end]):
                    for mark in (_mark(hashes, k, bits) for k in range(MARKS)):
                        np.bitwise_or.at(words, mark >> np.uint64(6), np.uint64(1) << (mark & np.uint64(63)))
        at = np.flatnonzero(words)
        for some in (at[i: i + SENT] for i in range(0, len(at), SENT)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "bits"])

    def held(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _slices(texts):
                rows, hashes = _held_in(texts[begin:end], shared.value, lengths)
                for i in range(0, len(rows), SENT):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[i: i + SENT].view(np.int64)), batch.column(0).take(pa.array(rows[i: i + SENT] + begin))], ["hash", names[1]])

    # The set has a fixed size; no table of texts comes to the driver.
    parts = short.mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    shared = context.broadcast(words)
    own = short.mapInArrow(keyed, f"hash long, {names[0]} string")
    # Merge joins: a side that is small as a file may be large as the map that a broadcast builds on the driver.
    return own.hint("merge").join(long.mapInArrow(held, f"hash long, {names[1]} string").hint("merge"), "hash").where(
        F.col(names[1]).contains(F.col(names[0]))).select("left_text", "right_text")


# --- the join --------------------------------------------------------------------------------


def _blocks(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """``shortest, longest, parts`` of blocks of texts of like length; a length with many texts fills several parts."""
    blocks, open_, letters = [], 0, 0
    for size in sorted(sizes):
        n = sizes[size]
        full = max(1, min(most, LETTERS // max(1, size)))
        if open_ and (open_ + n > most or letters + n * size > LETTERS):
            open_ = letters = 0
        if open_:
            blocks[-1] = (blocks[-1][0], size, 1)
        else:
            blocks.append((size, size, -(-n // full)))
        open_, letters = (0, 0) if n > full else (open_ + n, letters + n * size)
    return blocks


def _dealt(side: DataFrame, starts: list[int], first: list[int], parts: list[int], pairs: dict[int, list[int]]) -> DataFrame:
    """``pair, text``: every text once for every pair of blocks that its own block takes part in."""
    def deal(batches):
        for batch in batches:
            texts, spread = batch.column(0), batch.column(1).to_numpy()
            block = np.searchsorted(starts, batch.column(2).to_numpy(), "right") - 1
            block = np.asarray(first)[block] + spread % np.asarray(parts)[block]
            meets = [np.asarray(pairs.get(b, []), np.int64) for b in block.tolist()]
            rows, numbers = np.repeat(np.arange(len(meets)), [len(m) for m in meets]), np.concatenate([np.zeros(0, np.int64), *meets])
            for i in range(0, len(rows), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i: i + SENT]), texts.take(pa.array(rows[i: i + SENT]))], ["pair", "text"])

    return side.select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("spread"), F.length("text").cast("long").alias("size")).mapInArrow(
        deal, "pair long, text string")


def _alike(sides: list[DataFrame], sizes: list[dict[int, int]], floor: float, measure: str) -> DataFrame:
    """Texts of two tables that may reach the floor, block by block."""
    cores, counts = sides[0].sparkSession.sparkContext.defaultParallelism, [sum(s.values()) for s in sizes]
    # Enough pairs of blocks to fill the cores, with few copies of the texts.
    share = [max(1, round(math.sqrt(16 * cores * n / max(1, other)))) for n, other in (counts, counts[::-1])]
    blocks = [_blocks(s, max(1, min(TEXTS, max(64, -(-n // k))))) for s, n, k in zip(sizes, counts, share, strict=True)]
    reach = 1 / floor if measure == "edits" else (2 - floor) / floor
    single = [[(lo, hi) for lo, hi, parts in b for _ in range(parts)] for b in blocks]
    pairs = [(i, j) for i, (lo, hi) in enumerate(single[0]) for j, (low, high) in enumerate(single[1])
             if lo <= reach * high + 1e-9 and low <= reach * hi + 1e-9]
    dealt = []
    for k, side in enumerate(sides):
        own: dict[int, list[int]] = {}
        for number, pair in enumerate(pairs):
            own.setdefault(pair[k], []).append(number)
        parts = [b[2] for b in blocks[k]]
        dealt.append(_dealt(side, [b[0] for b in blocks[k]], [0, *accumulate(parts)], parts, own))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        mine, theirs = one["text"].to_pylist(), two["text"].to_pylist()
        found = list(alike(mine, theirs, floor, measure)) if mine and theirs else []
        return pa.table({name: pa.array([texts[i] for f in found for i in f[k].tolist()], pa.string())
                         for k, (name, texts) in enumerate((("left_text", mine), ("right_text", theirs)))})

    # A fixed number of partitions keeps blocks, small in bytes and long in work, from being put together.
    one, two = (d.repartition(max(1, min(len(pairs), 2_000)), "pair").groupBy("pair") for d in dealt)
    return one.cogroup(two).applyInArrow(lambda here, there: meet(here, there), "left_text string, right_text string")


def candidate_pairs(left: DataFrame, right: DataFrame, floor: float, measure: str = "blocks") -> DataFrame:
    """``left_text, right_text`` of every two distinct texts (``text``) that may reach ``floor`` or hold each other; a pair
    may come twice."""
    if floor <= 2 / 3:
        raise ValueError("below two thirds, any two texts of a language may have enough letters in common")
    sides = [side.select("text").where("text IS NOT NULL") for side in (left, right)]
    sizes = [{r["size"]: r["n"] for r in side.groupBy(F.length("text").alias("size")).agg(F.count("*").alias("n")).collect()} for side in sides]
    ways, back = ["left_text", "right_text"], ["right_text", "left_text"]

    def tiny(short: DataFrame, long: DataFrame, names: list[str]) -> DataFrame:
        # Texts of no or one letter; being distinct they are as few as there are letters.
        few = F.broadcast(short.where(F.length("text") <= 1).select(F.col("text").alias(names[0])))
        return few.join(long.select(F.col("text").alias(names[1])), F.col(names[1]).contains(F.col(names[0]))).select(
            "left_text", "right_text")

    found = [_holding(sides[0], sizes[0], sides[1], ways), _holding(sides[1], sizes[1], sides[0], back), tiny(*sides, ways), tiny(*sides[::-1], back)]
    if floor < 1:  # at one, only texts that hold each other match
        found.append(_alike(sides, sizes, floor, measure))
    return reduce(DataFrame.unionByName, found)


def edit_ratio(distance: Column, one: str, two: str) -> Column:
    longer = F.greatest(F.length(one), F.length(two))
    return F.when(longer == 0, 1.0).otherwise(1 - distance / longer)


def similar_texts(left: DataFrame, right: DataFrame, floor: float, measure: str = "blocks") -> DataFrame:
    """``left_text, right_text, similarity, edit_ratio`` of all distinct texts of the two columns ``text`` that match.

    The similarity is 1 where one text holds the other, else the matching-blocks ratio (``blocks``; of the left text against
    the right one) or the Levenshtein ratio (``edits``), and at least ``floor``. Nulls match nothing.
    """
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # As many files as cores at least: what is small in bytes is long in work.
    sides = [materialized(side.select("text").where("text IS NOT NULL").repartition(parts, "text").distinct(), "texts") for side in (left, right)]
    rows = candidate_pairs(*sides, floor, measure)
    held = F.col("left_text").contains(F.col("right_text")) | F.col("right_text").contains(F.col("left_text"))
    rows = materialized(rows.distinct(), "near-texts")
    edits = edit_ratio(F.levenshtein("left_text", "right_text"), "left_text", "right_text")
    ratio = F.col("edit_ratio") if measure == "edits" else _blocks_ratio(floor)("left_text", "right_text")
    scored = rows.withColumn("edit_ratio", edits).withColumn("similarity", F.when(held, 1.0).otherwise(ratio))
    return scored.where(F.col("similarity") >= floor).select("left_text", "right_text", "similarity", "edit_ratio")


def _blocks_ratio(floor: float):
    @F.pandas_udf("double")
    def ratio(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(lefts, rights, strict=True):
            matcher = SequenceMatcher(None, one, two)
            quick = matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor
            out.append(matcher.ratio() if quick else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio
