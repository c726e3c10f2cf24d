"""One pass over the chunk table that scores every chunk against a block of queries.

Exact nearest neighbours need every (query, chunk) score, so the scores must never become rows: a
task multiplies its chunks with the query matrix batch by batch and keeps a running top k per query
and channel. Only ``k`` rows per query, channel and task leave the scan; chunks are never shuffled.

Queries travel as matrices inside the task closure. Their number is counted first: up to
``MAX_QUERIES`` (or what it says beside) go in one scan, more are split by hash into further scans. A scan is written before the
queries of the next are fetched, so driver and tasks hold one group whatever the size of the query table.
Matrices hold at most ``CELLS`` numbers: groups of long queries are cut, and chunk rows are multiplied in slices.

A vector has many times the bytes of its text, so chunks and queries that bring ``vector_text`` are embedded inside the
task, once a batch. Their vectors are whole numbers, whose products are exact in any order, in single precision too while
they stay below 2^24. Most stay below 2^11: then two chunks share a number, one of them times 2^12, and one product serves
both. Words that few pairs share are counted pair by pair, the others in a matrix. Such a scan compares matrices of products
and counts, small enough for a core's cache, with what the k-th best of every query needs; only pairs that reach it are
divided, rounded and kept.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.operators.embedding import Embedder, norms
from sagewell.operators.rank import top_k
from sagewell.session import materialized

try:
    import ahocorasick
except ImportError:  # plain substring tests give the same result
    ahocorasick = None

MAX_QUERIES = 16384  # as texts; an eighth of it with their vectors, twice as many without vectors and boosts
BLOCK = 256  # queries per matrix
ROWS = 1024  # chunks per matrix
STRIP = 64  # chunks embedded at once, so that what is counted stays in a core's cache
WIDE = 1024  # from so many queries on a scan runs one task a core, for each task gives k rows a query
CELLS = 8_000_000  # numbers in one matrix
SALTS = 64
FREQUENT = 1500  # a word that more than one in so many pairs of a matrix share is counted by a matrix product
EXACT = 2.0**24  # whole numbers up to here are exact in single precision
STEP, HALF = np.float32(2**12), 2**11 - 1  # two whole numbers up to HALF fit into one: low + STEP * high
LEXICAL_STEP, LEXICAL_CAP, PHRASE_BONUS, TOKEN_BOOST = 0.08, 0.30, 2.0, 0.03

SCORED = "query_id long, channel string, chunk_id string, base double, lexical double, confidence double"
COUNTED = "query_id long, channel string, chunk_id string, ahead long"


def _matrix(rows, keys: str, weights: str | None):
    """(key index, key × query matrix) of a sparse query column."""
    index = pd.Index(sorted({k for r in rows for k in (r[keys] or ())}))
    matrix = np.zeros((len(index), len(rows)))
    for q, r in enumerate(rows):
        if r[keys]:
            matrix[index.get_indexer(r[keys]), q] = r[weights] if weights else 1.0
    return index, matrix


def _product(keys, weights, index, matrix):
    """Sparse rows (lists of keys and weights) times the query matrix, in slices of bounded width times length."""
    rows = max(1, CELLS // max(1, len(index)))
    if len(keys) > rows:
        return np.concatenate([
            _product(keys[at : at + rows], None if weights is None else weights[at : at + rows], index, matrix)
            for at in range(0, len(keys), rows)
        ])
    sizes = np.fromiter((len(k) for k in keys), dtype=np.int64, count=len(keys))
    if len(index) == 0 or sizes.sum() == 0:
        return np.zeros((len(keys), matrix.shape[1]))
    column = index.get_indexer(np.concatenate([np.asarray(k) for k in keys]))
    row = np.repeat(np.arange(len(keys)), sizes)
    value = np.ones(len(row)) if weights is None else np.concatenate([np.asarray(w) for w in weights])
    known = column >= 0
    left = np.zeros((len(keys), len(index)))
    left[row[known], column[known]] = value[known]
    return left @ matrix


def _finder(tokens):
    """Function: text to the list of tokens that occur in it as substrings."""
    if ahocorasick is None or not tokens:
        return lambda text: [t for t in tokens if t in text]
    automaton = ahocorasick.Automaton()
    for token in tokens:
        automaton.add_word(token, token)
    automaton.make_automaton()
    return lambda text: sorted({token for _, token in automaton.iter(text)})


def cover_density(text: str, terms: set[str]) -> float:
    """Sum over minimal covers (spans holding every term) of 0.1 / (1 + words that are not needed)."""
    last: dict = {}
    total, previous = 0.0, 0
    for at, word in enumerate(text.split(), 1):
        if word in terms:
            last[word] = at
            if len(last) == len(terms):
                start = min(last.values())
                if start > previous:
                    total += 0.1 / (1 + (at - start) - (len(terms) - 1))
                    previous = start
    return total


def _apart(packed: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The two whole numbers of each of ``packed`` (see ``STEP``), zeros of either sign. All steps are exact in single precision."""
    np.rint(packed * (1 / STEP), out=high)
    np.multiply(high, -STEP, out=low)
    low += packed


def _places(mask: np.ndarray):
    """(row, column) numbers of what is true, many times as quick as ``nonzero`` on a matrix of which little is true."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    eight, place = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    places = np.concatenate([eights[eight] * 8 + place, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(places, mask.shape[1])


def _entries(start: np.ndarray, count: np.ndarray):
    """(number of the list, place of the entry) of every entry of lists that lie at ``start`` and have ``count`` entries."""
    number = np.repeat(np.arange(len(count)), count)
    return number, np.arange(len(number)) + (start - (np.cumsum(count) - count))[number]


class _Batch:
    """What all blocks need of a batch of chunks: vectors, and the rows that hold each query word."""

    def __init__(self, chunks: pd.DataFrame, embedder: Embedder | None, words: dict[str, int], asked: frozenset):
        self.size, self.embedder, self.exact_counts = len(chunks), embedder, None
        self.half = (self.size + 1) // 2
        if "vector_text" in chunks:
            single, length = np.empty((self.size, embedder.dims), dtype=np.float32), np.empty(self.size)
            for at in range(0, self.size, STRIP):
                part = slice(at, at + STRIP)
                counts = embedder.counts(chunks["vector_text"].iloc[part])
                single[part], length[part] = counts, norms(counts)
            # Chunks of like length are half the batch apart; their vectors share one, the shorter pairs first.
            order = np.argsort(length, kind="stable")
            order = np.concatenate([order[0::2], order[1::2]])
            chunks, self.norms, self.single = chunks.iloc[order].reset_index(drop=True), length[order], single[order]
            self.packed = self.single[: self.size - self.half] + STEP * self.single[self.half :]
        self.chunks = chunks
        if words:
            self.texts = [text or "" for text in chunks["search_text"]]
            held = [asked.intersection(text.split(" ")) for text in self.texts]
            sizes = [len(h) for h in held]
            word = np.fromiter(map(words.__getitem__, chain.from_iterable(held)), dtype=np.int64, count=sum(sizes))
            self.rows = np.repeat(np.arange(self.size), sizes)[np.argsort(word, kind="stable")]
            self.held = np.bincount(word, minlength=len(words))  # rows of every word, one word after the other
            self.first = np.cumsum(self.held) - self.held
        self.names = chunks["chunk_id"].to_numpy()
        self.starts = _starts(self.names)

    @property
    def counts(self) -> np.ndarray:
        """The vectors in double precision, for products that single precision may not hold."""
        if self.exact_counts is None:
            self.exact_counts = self.embedder.counts(self.chunks["vector_text"])
        return self.exact_counts


class _Block:
    """A group of queries in matrix form. ``lexical`` is None, ``overlap`` or ``all_terms``.

    Scores are matrices with a row a query. ``words`` numbers the words of all blocks of a task.
    """

    def __init__(self, rows, lexical: str | None, boosts: bool, vectors: bool, words: dict[str, int], embedder: Embedder | None):
        self.ids = [r["query_id"] for r in rows]
        self.lexical, self.boosts, self.find, self.embedded, self.vectors = lexical, boosts, None, None, None
        if vectors and embedder:
            counts = embedder.counts([r["vector_text"] for r in rows])
            self.norms = norms(counts)
            # Held in the fewest bytes, and widened for a product.
            most = np.abs(counts).max(initial=0)
            self.embedded = counts.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.float64)
        elif vectors:
            self.vectors = _matrix(rows, "dims", "weights")
            self.norms = np.array([r["norm"] or 1.0 for r in rows])
        if lexical:
            self.phrases = [r["normalized"] for r in rows]
            term_sets = [set(r["terms"] or ()) for r in rows]
            self.term_sets = term_sets if lexical == "all_terms" else None
            self.needed = np.array([float(len(terms)) for terms in term_sets])
            self._index_words(term_sets, words)
        if boosts:
            self.features = _matrix(rows, "features", "feature_weights")
            self.tokens = _matrix(rows, "long_tokens", None)

    def _index_words(self, term_sets: list[set], words: dict[str, int]):
        asking: dict[int, list[int]] = {}
        for q, terms in enumerate(term_sets):
            for term in terms:
                asking.setdefault(words.setdefault(term, len(words)), []).append(q)
        self.word = np.array(list(asking), dtype=np.int64)
        self.askers = np.array(list(chain.from_iterable(asking.values())), dtype=np.int64)
        self.asked = np.array([len(qs) for qs in asking.values()], dtype=np.int64)
        self.start = np.cumsum(self.asked) - self.asked

    def shared(self, batch: _Batch) -> np.ndarray:
        """Number of shared words, in single precision."""
        shared = np.zeros((len(self.ids), batch.size), dtype=np.float32)
        held = batch.held[self.word]
        frequent = held * self.asked * FREQUENT > shared.size
        many, few = np.flatnonzero(frequent), np.flatnonzero(~frequent & (held > 0))
        step = max(1, CELLS // max(batch.size, len(self.ids)))
        for at in range(0, len(many), step):
            shared += self._matrix_counts(many[at : at + step], batch)
        word, entry = _entries(batch.first[self.word[few]], held[few])
        pair, asker = _entries(self.start[few[word]], self.asked[few[word]])
        np.add.at(shared.reshape(-1), self.askers[asker] * batch.size + batch.rows[entry][pair], np.float32(1))
        return shared

    def _matrix_counts(self, words: np.ndarray, batch: _Batch) -> np.ndarray:
        """Number of these words that each query shares with each chunk."""
        word, entry = _entries(self.start[words], self.asked[words])
        asking = np.zeros((len(self.ids), len(words)), dtype=np.float32)
        asking[self.askers[entry], word] = 1.0
        word, entry = _entries(batch.first[self.word[words]], batch.held[self.word[words]])
        row = batch.rows[entry]
        if len(words) > HALF:
            held = np.zeros((len(words), batch.size), dtype=np.float32)
            held[word, row] = 1.0
            return asking @ held
        held = np.zeros((len(words), batch.half), dtype=np.float32)
        second = row >= batch.half
        np.add.at(held.reshape(-1), word * batch.half + row - batch.half * second, np.where(second, STEP, np.float32(1)))
        counts = np.empty((len(self.ids), 2 * batch.half), dtype=np.float32)
        _apart(asking @ held, counts[:, : batch.half], counts[:, batch.half :])
        return counts[:, : batch.size]

    def overlap(self, batch: _Batch) -> np.ndarray:
        return self.shared(batch).astype(float)

    def exact(self, batch: _Batch) -> bool:
        """No partial sum is larger than the product of the two lengths."""
        return batch.norms.max(initial=0) * self.norms.max(initial=0) < EXACT

    def products(self, batch: _Batch) -> np.ndarray:
        """Products with every chunk, in single precision; right if they are ``exact``."""
        wide = self.embedded.astype(np.float32)
        products = np.empty((len(self.ids), batch.size), dtype=np.float32)
        pairs = np.searchsorted(batch.norms[batch.half :], HALF / self.norms.max(initial=1))
        if pairs:
            _apart(wide @ batch.packed[:pairs].T, products[:, :pairs], products[:, batch.half : batch.half + pairs])
        for low, high in ((pairs, batch.half), (batch.half + pairs, batch.size)):
            if low < high:
                products[:, low:high] = wide @ batch.single[low:high].T
        return products

    def cosine(self, batch: _Batch) -> np.ndarray:
        if self.embedded is None:
            base = _product(batch.chunks["dims"], batch.chunks["weights"], *self.vectors)
            return np.ascontiguousarray(np.round(base / np.outer(batch.chunks["norm"].to_numpy(), self.norms), 6).T)
        dot = self.products(batch) + np.float64(0) if self.exact(batch) else self.embedded.astype(float) @ batch.counts.T
        dot /= np.outer(self.norms, batch.norms)
        return np.round(dot, 6, out=dot)

    def scores(self, batch: _Batch, words: int):
        """(cosine, cosine with boosts, lexical score) matrices, rounded so that ties are the same everywhere."""
        chunks = batch.chunks
        base = np.zeros((len(self.ids), batch.size)) if self.embedded is None and self.vectors is None else self.cosine(batch)
        boosted = base
        if self.boosts:
            extra = _product(chunks["features"], chunks["feature_weights"], *self.features)
            self.find = self.find or _finder(list(self.tokens[0]))
            inside = [self.find(text) for text in chunks["haystack"]]
            extra += TOKEN_BOOST * _product(inside, None, *self.tokens)
            boosted = np.round(base + extra.T, 6)
        if not self.lexical:
            return base, boosted, None
        if not words:
            return base, boosted, np.zeros_like(base)
        overlap = self.overlap(batch)
        needed, asked = self.needed[:, None], (self.needed > 0)[:, None]
        if self.lexical == "all_terms":
            density = np.zeros_like(overlap)
            for q, c in zip(*np.nonzero((overlap >= needed) & asked)):
                density[q, c] = round(cover_density(batch.texts[c], self.term_sets[q]), 9)
            return base, boosted, density
        # All inner words of a contained phrase are shared words, so few pairs need the text search.
        for q, c in zip(*np.nonzero((overlap >= needed - 2) & asked)):
            if self.phrases[q] in batch.texts[c]:
                overlap[q, c] += PHRASE_BONUS
        return base, boosted, overlap


def _lexical_confidence(boosted, overlap):
    return np.round(boosted + np.minimum(np.maximum(overlap, 0.0) * LEXICAL_STEP, LEXICAL_CAP), 6)


def _starts(names) -> np.ndarray:
    """The first eight bytes of every name as a number: names of different numbers are in the order of the numbers."""
    heads = b"".join((name or "").encode("utf-8")[:8].ljust(8, b"\0") for name in names)
    return np.frombuffer(heads, dtype=">u8").astype(np.uint64)


class _Best:
    """The best ``k`` rows of every query of a block in one channel, by value and then by name, held as columns."""

    COLUMNS = ["query", "value", "start", "name", "base", "boosted", "word"]

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.kept, self.new, self.waiting = queries, k, None, [], 0
        self.floor = np.full(queries, -np.inf)
        self.last = np.full(queries, np.iinfo(np.uint64).max, dtype=np.uint64)

    def least(self, ranking: np.ndarray) -> np.ndarray:
        """What a row needs by now; of the first matrix, what its own ``k``-th best has."""
        if self.kept is None and self.waiting == 0 and ranking.shape[1] > self.k:
            return np.partition(ranking, ranking.shape[1] - self.k, axis=1)[:, ranking.shape[1] - self.k]
        return self.floor

    def reach(self, query, value, start) -> np.ndarray:
        """Places of the rows that are not behind the ``k``-th best so far."""
        floor = self.floor[query]
        return np.flatnonzero((value > floor) | ((value == floor) & (start <= self.last[query])))

    def add(self, *columns):
        self.new.append(columns)
        self.waiting += len(columns[0])
        if self.kept is None or self.waiting * 2 >= self.queries * self.k:
            self.cut()

    def cut(self):
        parts = ([self.kept] if self.kept is not None else []) + self.new
        if not parts:
            return
        columns = [np.concatenate(some) for some in zip(*parts)]
        query, value, start, name = columns[:4]
        order = np.lexsort((start, -value, query))
        same = np.flatnonzero((np.diff(query[order]) == 0) & (np.diff(value[order]) == 0) & (start[order][1:] == start[order][:-1]))
        if any(name[order[i]] != name[order[i + 1]] for i in same):
            order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -value[i], name[i] is not None, name[i] or "")))
        held = np.bincount(query, minlength=self.queries)
        place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        last = order[place == self.k - 1]
        self.floor[query[last]], self.last[query[last]] = value[last], start[last]
        order = order[place < self.k]
        self.kept, self.new, self.waiting = [column[order] for column in columns], [], 0


class _Group:
    """The blocks of one group of queries and what they share."""

    def __init__(self, rows, lexical: str | None, boosts: bool, vectors: bool, embedded: bool):
        self.words: dict[str, int] = {}
        self.embedded = embedded
        embedder = Embedder() if embedded else None
        if embedded:  # Queries of like length share a block, so that a long one does not keep others' products from sharing.
            rows = sorted(rows, key=lambda r: len(r["vector_text"] or ""))
        self.blocks = [_Block(part, lexical, boosts, vectors, self.words, embedder)
                       for part in _parts(rows, lexical, boosts, vectors and not embedded)]
        self.vectors = vectors
        self.channels = (["vector"] if vectors else []) + (["lexical"] if lexical else [])
        # What is counted and multiplied in whole numbers can be compared before it is divided and rounded.
        self.whole = embedded and not boosts and lexical in (None, "overlap")

    def batches(self, frames):
        embedder, asked = Embedder() if self.embedded else None, frozenset(self.words)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                yield _Batch(frame.iloc[at : at + ROWS].reset_index(drop=True), embedder, self.words, asked)

    def scores(self, frames):
        """(chunk ids, block, cosine, boosted cosine, lexical score) of every batch and block."""
        for batch in self.batches(frames):
            for block in self.blocks:
                yield batch.names, block, *block.scores(batch, len(self.words))


def _whole_candidates(block: _Block, batch: _Batch, words: int, best: dict):
    """(channel, queries, rows, values, cosines, lexical scores) that may be among the best, from products and counts."""
    dot = block.products(batch)
    shared = block.shared(batch) if block.lexical and words else None
    wide = block.needed - 2 if block.lexical else None

    def scored(query, row):
        base = np.round((dot[query, row].astype(float) + 0.0) / (block.norms[query] * batch.norms[row]), 6)
        word = np.zeros(len(query))
        if shared is not None:
            word = shared[query, row].astype(float)
            # All inner words of a contained phrase are shared words, so few pairs need the text search.
            for i in np.flatnonzero((word >= wide[query]) & (block.needed[query] > 0)):
                if block.phrases[query[i]] in batch.texts[row[i]]:
                    word[i] += PHRASE_BONUS
        return base, word

    if "vector" in best:
        near = dot * (1.0 / batch.norms).astype(np.float32)
        # Two roundings in single precision, and one to six places.
        least = best["vector"].least(near) / block.norms if best["vector"].kept is None else best["vector"].floor
        limit = ((least - 4e-6) * block.norms - 1e-6 * np.abs(least) * block.norms).astype(np.float32)
        query, row = _places(near >= limit[:, None])
        base, word = scored(query, row)
        yield "vector", query, row, base, base, word
    if "lexical" in best and shared is not None:
        least = np.maximum(best["lexical"].least(shared), 0.5)
        # A phrase in the text adds to the count of a pair that shares nearly all words.
        least = np.where(block.needed > 0, np.minimum(least, np.maximum(wide, least - PHRASE_BONUS)), least)
        query, row = _places(shared >= least[:, None].astype(np.float32))
        base, word = scored(query, row)
        some = np.flatnonzero(word > 0)
        query, row, base, word = (column[some] for column in (query, row, base, word))
        yield "lexical", query, row, word, base, word


def _topk_task(group, k, rank_by):
    whole = group.whole and rank_by == {"vector": "base", "lexical": "lexical"}

    def candidates(block, batch, best):
        if whole and block.exact(batch):
            for channel, query, row, value, base, word in _whole_candidates(block, batch, len(group.words), best):
                yield channel, query, row, value, base, base, word
            return
        base, boosted, overlap = block.scores(batch, len(group.words))
        for channel in best:
            by = rank_by[channel]
            if by == "confidence":
                ranking = boosted if channel == "vector" else _lexical_confidence(boosted, overlap)
            else:
                ranking = base if by == "base" else overlap
            if channel == "lexical":
                ranking = np.where(overlap > 0, ranking, -np.inf)
            ahead = ranking >= best[channel].least(ranking)[:, None]
            query, row = _places(ahead & (overlap > 0) if channel == "lexical" else ahead)
            word = np.zeros(len(query)) if overlap is None else overlap[query, row]
            yield channel, query, row, ranking[query, row], base[query, row], boosted[query, row], word

    def run(frames):
        best = [{channel: _Best(len(block.ids), k) for channel in group.channels} for block in group.blocks]
        for batch in group.batches(frames):
            for block, mine in zip(group.blocks, best):
                for channel, query, row, value, *numbers in candidates(block, batch, mine):
                    at = mine[channel].reach(query, value, batch.starts[row])
                    here = row[at]
                    mine[channel].add(query[at], value[at], batch.starts[here], batch.names[here], *(n[at] for n in numbers))
        for block, mine in zip(group.blocks, best):
            for channel, kept in mine.items():
                kept.cut()
                if kept.kept is None or not len(kept.kept[0]):
                    continue
                query, _, _, name, base, boosted, word = kept.kept
                sure = boosted if channel == "vector" else _lexical_confidence(boosted, word)
                yield pd.DataFrame({
                    "query_id": pd.Series([block.ids[q] for q in query], dtype=object), "channel": channel, "chunk_id": name,
                    "base": base, "lexical": word, "confidence": sure})

    return run


def _count_task(group, thresholds):
    """Count the chunks ranked ahead of given candidates (value descending, then id)."""

    def run(frames):
        ahead = {key: np.zeros(len(items), dtype=np.int64) for key, items in thresholds.items()}
        for ids, block, _, boosted, overlap in group.scores(frames):
            everything = np.ones(len(ids), dtype=bool)
            for channel in (["vector"] if group.vectors else []) + ([] if overlap is None else ["lexical"]):
                confidence = boosted if channel == "vector" else _lexical_confidence(boosted, overlap)
                for q, query_id in enumerate(block.ids):
                    items = thresholds.get((query_id, channel))
                    if not items:
                        continue
                    valid = everything if channel == "vector" else overlap[q] > 0
                    column, names = confidence[q, valid], ids[valid]
                    ordered = np.sort(column)
                    limits = np.array([value for _, value in items])
                    ahead[query_id, channel] += len(ordered) - np.searchsorted(ordered, limits, "right")
                    for i, (name, value) in enumerate(items):
                        ahead[query_id, channel][i] += int((names[column == value] < name).sum())
        for (query_id, channel), counts in ahead.items():
            yield pd.DataFrame(
                {
                    "query_id": query_id,
                    "channel": channel,
                    "chunk_id": [name for name, _ in thresholds[query_id, channel]],
                    "ahead": counts,
                }
            )

    return run


def _parts(rows, lexical, boosts, vectors=True):
    """Groups of at most ``BLOCK`` queries whose matrices stay within ``CELLS``; one query is always a group."""
    lists = (["dims"] if vectors else []) + (["terms"] if lexical else []) + (["features", "long_tokens"] if boosts else [])
    part, keys = [], 0
    for row in rows:
        more = max((len(row[name] or ()) for name in lists), default=0)
        if part and (len(part) == BLOCK or (len(part) + 1) * (keys + more) > CELLS):
            yield part
            part, keys = [], 0
        part.append(row)
        keys += more
    if part:
        yield part


def _scan(narrow: DataFrame, queries: DataFrame, task, schema: str) -> DataFrame:
    """``task(rows)`` over the chunks for every query group; of several groups each is written before the next."""
    total = queries.count()
    light = 1 if "features" in queries.columns else 2
    most = max(1, MAX_QUERIES // 8) if "dims" in queries.columns else light * MAX_QUERIES
    groups = max(1, math.ceil(total / most))
    if total >= WIDE:
        narrow = narrow.coalesce(max(1, narrow.sparkSession.sparkContext.defaultParallelism))
    if groups == 1:
        return narrow.mapInPandas(task(queries.collect()), schema)
    parts = []
    for g in range(groups):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).collect()
        parts.append(materialized(narrow.mapInPandas(task(rows), schema), "scan-group"))
    return reduce(DataFrame.unionByName, parts)


VECTOR_COLUMNS = ["dims", "weights", "norm"]
BOOST_COLUMNS = ["features", "feature_weights"]


def _sides(chunks: DataFrame, queries: DataFrame, lexical, boosts, vectors=True):
    """Both tables with the columns a scan reads, and whether texts are embedded inside it."""
    embedded = vectors and "vector_text" in chunks.columns and "vector_text" in queries.columns
    vector = (["vector_text"] if embedded else VECTOR_COLUMNS) if vectors else []
    shared = vector + (BOOST_COLUMNS if boosts else [])
    narrow = chunks.select("chunk_id", *shared, *(["search_text"] if lexical else []), *(["haystack"] if boosts else []))
    asked = queries.select("query_id", *shared, *(["terms", "normalized"] if lexical else []), *(["long_tokens"] if boosts else []))
    return narrow, asked, embedded


def scan_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    lexical: str | None = None,
    boosts: bool = False,
    vectors: bool = True,
    rank_by: dict[str, str] | None = None,
) -> DataFrame:
    """Best ``k`` chunks per query and channel, ties by chunk id.

    ``chunks`` and ``queries`` hold sparse vectors (``dims``, ``weights``, ``norm``) or both a ``vector_text``, which is
    embedded as by ``vectors.with_vectors``. ``lexical`` adds a second channel, scored by shared words (``overlap``) or by
    cover density among the chunks that hold every query word (``all_terms``); it needs the chunks' ``search_text`` and
    the queries' ``terms`` and ``normalized``. ``boosts`` needs ``features`` (see ``search.chunk_features``).
    ``vectors=False`` leaves the vector channel and its columns out.
    """
    rank_by = rank_by or {"vector": "base", "lexical": "lexical"}
    narrow, asked, embedded = _sides(chunks, queries, lexical, boosts, vectors)
    found = _scan(
        narrow, asked, lambda rows: _topk_task(_Group(rows, lexical, boosts, vectors, embedded), k, rank_by), SCORED)
    value = F.when(F.col("channel") == "lexical", F.col(rank_by["lexical"])).otherwise(F.col(rank_by["vector"]))
    order = [F.desc("_value"), F.asc("chunk_id")]
    salted = found.withColumn("_value", value).withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
    few = top_k(salted, ["query_id", "channel", "_salt"], order, k, "_rank")
    return top_k(few, ["query_id", "channel"], order, k, "rank").drop("_value", "_salt", "_rank")


def scan_ranks(chunks: DataFrame, queries: DataFrame, candidates: DataFrame, *, lexical: str = "overlap") -> DataFrame:
    """Exact rank of each candidate (query, channel, chunk, confidence) among all chunks.

    A second scan counts what lies ahead of each candidate; the counts add up across tasks.
    """
    narrow, asked, embedded = _sides(chunks, queries, lexical, True)

    def task(rows):
        # At most a few dozen candidates per query of a bounded group.
        limits: dict = {}
        for r in candidates.filter(F.col("query_id").isin([r["query_id"] for r in rows])).collect():
            limits.setdefault((r["query_id"], r["channel"]), []).append((r["chunk_id"], r["confidence"]))
        return _count_task(_Group(rows, lexical, True, True, embedded), limits)

    counted = _scan(narrow, asked, task, COUNTED)
    return counted.groupBy("query_id", "channel", "chunk_id").agg((F.sum("ahead") + 1).alias("rank"))
