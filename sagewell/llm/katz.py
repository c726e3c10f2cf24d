"""Language-model scores with Katz backoff over word bigrams.

Counts are Good-Turing discounted; what discounting frees in a context goes to the words not seen in it, in
proportion to their own probability, so every conditional distribution sums to one exactly. Likewise the mass
freed among single words is the probability of any unknown word.

Documents are packed into blocks. A block asks for its distinct words and then for its distinct bigrams, as
packed arrays dealt to buckets by word and by context; the buckets add up the counts of all blocks, which is
the stored, partitioned count table, and answer in the order they were asked. A context with very many
occurrences is cut into salted units by successor, whose sums its blocks add. Each token is then evaluated
recursively: bigram, else backoff weight times single word, else unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import batch, partitions_for, stored, texts_of

#: Counts above this are taken as they are; at most this many are discounted.
DISCOUNTED = 5
TOKENS_PER_BLOCK = 2_000_000
TOKENS_PER_BUCKET = 2_000_000
WORDS_PER_BUCKET = 400_000
#: A context seen more often than this is cut into units; their number only sets how it is spread.
SPLIT = 200_000
MAX_UNITS = 4096
#: Ids of the start of a text and of unknown words; known words follow.
START, UNKNOWN, FIRST = 0, 1, 2
END_WORD = ""

PARTS = pa.schema([
    ("block", pa.int64()), ("pos", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("body", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())),
])
PARTS_SQL = (
    "block long, pos int, word string, n long, body binary, ids array<long>, lengths array<int>, held array<boolean>"
)
ANSWERS = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("sums", pa.list_(pa.int64())),
])
ANSWERS_SQL = "block long, bucket long, body binary, sums array<long>"
SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
SCORES_SQL = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: most numbers are small, so most planes are zeros."""
    out = []
    for array in arrays:
        array = np.ascontiguousarray(array)
        planes = array.view(np.uint8).reshape(-1, array.itemsize).T
        body = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())
        out.append(np.array([len(array), len(body)], dtype="<i8").tobytes() + array.dtype.str.encode().ljust(8) + body)
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        count, size = np.frombuffer(body, dtype="<i8", count=2, offset=at)
        kind = np.dtype(body[at + 16: at + 24].decode().strip())
        data = zstandard.ZstdDecompressor().decompress(
            body[at + 24: at + 24 + size], max_output_size=max(1, int(count) * kind.itemsize))
        planes = np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 24 + int(size)
    return out


@dataclass
class Discounts:
    """Good-Turing factors d[r] for counts 1 to k, from the numbers n[r] of things seen r times."""

    factors: np.ndarray

    @classmethod
    def from_counts(cls, seen: dict[int, int], k: int = DISCOUNTED) -> Discounts:
        # The largest k for which every factor lies strictly between 0 and 1; without one nothing is discounted.
        for top in range(k, 0, -1):
            n = [seen.get(r, 0) for r in range(top + 2)]
            if not all(n[1:]):
                continue
            common = (top + 1) * n[top + 1] / n[1]
            factors = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if common < 1 else 0.0
                       for r in range(1, top + 1)]
            if all(0 < f < 1 for f in factors):
                return cls(np.array([1.0, *factors, *[1.0] * (k - top)]))
        return cls(np.ones(k + 1))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.factors[np.where(counts > DISCOUNTED, 0, counts)] * counts


@dataclass
class Words:
    """The distribution of single words, normalised with the unknown word."""

    total: int
    distinct: int
    discounts: Discounts
    scale: float
    unknown: float

    @classmethod
    def build(cls, total: int, distinct: int, seen: dict[int, int]) -> Words:
        discounts = Discounts.from_counts(seen)
        lost = sum((1 - discounts.factors[r]) * r * seen.get(r, 0) for r in range(1, DISCOUNTED + 1))
        if total == 0:
            return cls(0, 0, discounts, 1.0, 1.0)
        scale = float(total if lost > 0 else total + 1)
        return cls(total, distinct, discounts, scale, (lost if lost > 0 else 1.0) / scale)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) / self.scale, self.unknown)


def _read(held: Column, docs: DataFrame, id_col: str, text_col: str, tokens_per_block: int) -> DataFrame:
    """Blocks of documents as local word numbers, and a row for each distinct word of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0

        def flush(ids, flags, rows, known):
            block = (task << 20) + serial
            flat = np.concatenate(rows)
            lengths = np.array([len(r) for r in rows])
            trained = np.repeat(~np.array(flags), lengths)
            every = np.bincount(flat, minlength=len(known))
            train = np.bincount(flat[trained], minlength=len(known))
            # Frequent words get small numbers; the end of a text stays number 0.
            order = np.concatenate([[0], 1 + np.argsort(-every[1:], kind="stable")])
            number = np.empty(len(order), dtype=np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            empty = dict.fromkeys(PARTS.names)
            whole = {**empty, "block": block, "body": pack(number[flat]), "ids": ids,
                     "lengths": lengths, "held": flags}
            yield pa.RecordBatch.from_pylist([whole], schema=PARTS)
            words = list(known)
            for start in range(0, len(order), 50_000):
                part = order[start: start + 50_000]
                yield batch(PARTS, {
                    **{name: pa.nulls(len(part), PARTS.field(name).type) for name in PARTS.names},
                    "block": np.full(len(part), block), "pos": np.arange(start, start + len(part), dtype=np.int32),
                    "word": [words[i].decode("utf-8") for i in part], "n": train[part],
                })

        ids, flags, rows, known, size = [], [], [], {b"": 0}, 0
        for part in batches:
            columns = part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2))
            for doc_id, out, text in zip(*columns, strict=True):
                tokens = (text or "").encode("utf-8", "replace").lower().split()
                for token in tokens:
                    if token not in known:
                        known[token] = len(known)
                numbers = np.fromiter((known[t] for t in tokens), dtype=np.int64, count=len(tokens))
                rows.append(np.append(numbers, 0))
                ids.append(doc_id)
                flags.append(out)
                size += len(tokens) + 1
                if size >= tokens_per_block:
                    yield from flush(ids, flags, rows, known)
                    serial += 1
                    ids, flags, rows, known, size = [], [], [], {b"": 0}, 0
        if ids:
            yield from flush(ids, flags, rows, known)

    return docs.select(
        F.col(id_col).cast("long"), held.cast("boolean"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, PARTS_SQL)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's words in order: counts over all blocks, numbers by bucket, and an answer for every block."""
    task = TaskContext.get().partitionId()
    answers: dict[int, list[list[int]]] = {}
    sums, seen, numbered = [0, 0], [0] * (DISCOUNTED + 2), 0
    word, asked, count = None, [], 0

    def close():
        nonlocal numbered
        if count:
            sums[0] += count
            sums[1] += 1
            if count <= DISCOUNTED + 1:
                seen[count] += 1
        for block, pos in asked:
            row = answers.setdefault(block, [[], [], []])
            row[0].append(pos)
            row[1].append(numbered if count else -1)
            row[2].append(count)
        numbered += bool(count)

    for part in batches:
        for next_word, block, pos, n in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if next_word != word:
                if asked:
                    close()
                word, asked, count = next_word, [], 0
            asked.append((block, pos))
            count += n
    if asked:
        close()
    for block, row in answers.items():
        body = pack(*(np.array(c, dtype=np.int64) for c in row))
        yield batch(ANSWERS, {"block": [block], "bucket": [task], "body": [body], "sums": [None]})
    yield batch(ANSWERS, {"block": [-1], "bucket": [task], "body": [None], "sums": [[*sums, *seen]]})


class Block:
    """A block with its words' global numbers and counts, and its distinct bigrams in asking order."""

    def __init__(self, row: dict, answers: list[tuple[int, bytes]], stride: int, buckets: int):
        (self.tokens,) = unpack(row["body"])
        self.tokens = self.tokens.astype(np.int64)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.held = np.array(row["held"], dtype=bool)
        self.ids = row["ids"]
        size = int(self.tokens.max()) + 1
        self.word, self.count = np.full(size + 1, UNKNOWN, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
        for bucket, body in answers:
            pos, number, count = unpack(body)
            self.word[pos] = np.where(number < 0, UNKNOWN, number * stride + bucket + FIRST)
            self.count[pos] = count
        # The start of a text is the local number after the last word; it occurs as often as the end does.
        self.word[size], self.count[size] = START, self.count[0]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = size
        self.before = before
        self.width = size + 1
        self.pair = before * self.width + self.tokens
        known = (self.word[before] != UNKNOWN) & (self.word[self.tokens] != UNKNOWN)
        self.asked, inverse = np.unique(self.pair[known], return_inverse=True)
        self.slot = np.full(len(self.tokens), -1, dtype=np.int64)
        self.slot[known] = inverse
        train = np.repeat(~self.held, self.lengths)[known]
        self.train = np.bincount(inverse[train], minlength=len(self.asked))
        self._lay_out(buckets)

    def _lay_out(self, buckets: int) -> None:
        contexts = np.unique(self.before)
        contexts = contexts[self.word[contexts] != UNKNOWN]
        units = np.minimum(1 + self.count // SPLIT, MAX_UNITS)
        many = units[contexts]
        self.unit_context = np.repeat(contexts, many)
        salt = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        context = self.word[self.unit_context]
        bucket = self._bucket(context, salt, buckets)
        order = np.lexsort((salt, context, bucket))
        self.unit_context, self.unit_salt = self.unit_context[order], salt[order]
        self.unit_word, self.unit_bucket = context[order], bucket[order]
        first, second = self.asked // self.width, self.asked % self.width
        salts = self.word[second] % units[first]
        bucket = self._bucket(self.word[first], salts, buckets)
        self.order = np.lexsort((self.word[second], salts, self.word[first], bucket))
        self.pair_bucket = bucket[self.order]
        # The pairs of a unit stand together, in the order of the units.
        key = self.word[first[self.order]] * MAX_UNITS + salts[self.order]
        change = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (
            self.pair_bucket[1:] != self.pair_bucket[:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(change, len(key)))
        self.unit_pairs = np.zeros(len(self.unit_word), dtype=np.int64)
        if len(key):
            own = self.unit_word * MAX_UNITS + self.unit_salt
            at = np.argsort(own, kind="stable")
            self.unit_pairs[at[np.searchsorted(own[at], key[change])]] = sizes

    @staticmethod
    def _bucket(word: np.ndarray, salt: np.ndarray, buckets: int) -> np.ndarray:
        mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + salt.astype(
            np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)

    def slices(self) -> Iterator[tuple[int, slice, slice]]:
        """Bucket by bucket, where its units and its pairs stand."""
        for bucket in np.unique(self.unit_bucket):
            yield int(bucket), slice(*np.searchsorted(self.unit_bucket, [bucket, bucket + 1])), slice(
                *np.searchsorted(self.pair_bucket, [bucket, bucket + 1]))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        second = (self.asked % self.width)[self.order]
        train = self.train[self.order]
        for bucket, units, pairs in self.slices():
            yield bucket, pack(
                self.unit_word[units], self.unit_salt[units], self.unit_pairs[units], self.word[second[pairs]],
                self.count[second[pairs]], train[pairs])


def _count_pairs(words: Words):
    """A bucket's bigrams: counts over all blocks, the sums each context needs, and an answer per block."""

    def run(table: pa.Table) -> pa.Table:
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        parts = [unpack(body.as_py()) for body in table.column("body")]
        unit_size, pair_size = [len(p[0]) for p in parts], [len(p[3]) for p in parts]
        _, unit = np.unique(np.concatenate([p[0] * MAX_UNITS + p[1] for p in parts]), return_inverse=True)
        units = int(unit.max()) + 1
        word, count, train = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        owner = np.repeat(unit, np.concatenate([p[2] for p in parts]))
        key, first, slot = np.unique((owner << 42) | word, return_index=True, return_inverse=True)
        found = np.bincount(slot, weights=train, minlength=len(key)).astype(np.int64)
        of = owner[first]
        live = found > 0
        total = np.bincount(of, weights=found, minlength=units).astype(np.int64)
        single = np.bincount(of[live], weights=words.probability(count[first][live]), minlength=units)
        seen = [np.bincount(of[found == r], minlength=units) for r in range(1, DISCOUNTED + 1)]
        overall = [0, *(int((found == r).sum()) for r in range(1, DISCOUNTED + 2))]
        out = {"block": [], "bucket": [], "body": [], "sums": []}
        for block, us, ps in zip(
            blocks, np.split(unit, np.cumsum(unit_size)[:-1]), np.split(slot, np.cumsum(pair_size)[:-1]), strict=True
        ):
            out["block"].append(block)
            out["bucket"].append(bucket)
            out["body"].append(pack(found[ps], total[us], single[us], *(n[us] for n in seen)))
            out["sums"].append(None)
        for name, value in zip(out, (-1, bucket, None, overall), strict=True):
            out[name].append(value)
        return pa.Table.from_pydict(out, schema=ANSWERS)

    return run


def evaluate(block: Block, answers: dict[int, bytes], words: Words, discounts: Discounts) -> dict:
    """Scores of a block's documents from the counts its questions were answered with."""
    found = np.zeros(len(block.asked), dtype=np.int64)
    total, single, kept = (np.zeros(block.width) for _ in range(3))
    for bucket, units, pairs in block.slices():
        counts, sums, probability, *seen = unpack(answers[bucket])
        found[block.order[pairs]] = counts
        context = block.unit_context[units]
        # The units of one context add up; what discounting leaves of its counts is their kept part.
        left = sums.astype(float)
        for r, n in enumerate(seen, start=1):
            left -= (1 - discounts.factors[r]) * r * n
        np.add.at(total, context, sums)
        np.add.at(single, context, probability)
        np.add.at(kept, context, left)
    # A context whose counts are all above the discounted ones frees one count, so its unseen words keep a share.
    scale = np.where(total - kept > 1e-9, total, total + 1)
    free = np.where(total > 0, (scale - kept) / np.maximum(scale, 1), 1.0)
    backoff = np.where(total > 0, free / np.maximum(1 - single, words.unknown), 1.0)
    alone = words.probability(block.count)
    alone[block.word == UNKNOWN] = words.unknown
    probability = backoff[block.before] * alone[block.tokens]
    asked = block.slot >= 0
    counts = np.where(asked, found[np.where(asked, block.slot, 0)] if len(found) else 0, 0)
    hit = counts > 0
    probability[hit] = discounts.of(counts[hit]) / scale[block.before[hit]]
    base = np.log10((block.count + 0.1) / (words.total + 0.1 * (words.distinct + 1)))
    return {
        "doc_id": block.ids, "held_out": block.held, "n_tokens": block.lengths,
        "n_known": np.add.reduceat((block.count[block.tokens] > 0).astype(np.int64), block.starts),
        "train_tokens": np.full(len(block.lengths), words.total),
        "base_score": np.add.reduceat(base[block.tokens], block.starts),
        "score": np.add.reduceat(np.log10(probability), block.starts),
    }


def katz_scores(
    docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text",
    tokens_per_block: int = TOKENS_PER_BLOCK, tokens_per_bucket: int = TOKENS_PER_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``held`` is false. Tokens are runs of characters other than the
    six ASCII white-space characters, A to Z lower-cased, then one end; ``score`` is the log10 probability of
    all of them. A null text counts as empty and has its end only. Repeated rows count and are scored each.
    Without training rows every token is the unknown word, whose probability is then one. No rows give none.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    parts = stored(_read(held, docs, id_col, text_col, tokens_per_block), "katz-tokens")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    asked = parts.where("word is not null").select("word", "block", "pos", "n")
    sizes = parts.where("word is null").agg(F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    vocabulary = stored(
        asked.repartition(partitions_for(asked.count(), WORDS_PER_BUCKET, spark), "word")
        .sortWithinPartitions("word").mapInArrow(_count_words, ANSWERS_SQL), "katz-words")
    words, stride = _totals(vocabulary, "words")
    buckets = partitions_for(sizes, tokens_per_bucket, spark)
    blocks = parts.where("word is null").select("block", "body", "ids", "lengths", "held")
    numbered = vocabulary.where("block >= 0").select("block", F.lit(0).alias("kind"), "bucket", "body")

    def load(left: pa.Table, right: pa.Table):
        rows = left.to_pylist()
        other = right.select(["kind", "bucket", "body"]).to_pylist()
        block = Block(rows[0], [(r["bucket"], r["body"]) for r in other if r["kind"] == 0], stride, buckets)
        return block, {r["bucket"]: r["body"] for r in other if r["kind"] == 1}

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        block, _ = load(left, right)
        number = left.column("block")[0].as_py()
        listed = list(block.questions())
        return pa.table({
            "bucket": pa.array([b for b, _ in listed], pa.int64()),
            "block": pa.array([number] * len(listed), pa.int64()),
            "body": pa.array([b for _, b in listed], pa.binary())})

    questions = blocks.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(
        ask, "bucket long, block long, body binary")
    counted = stored(
        questions.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count_pairs(words), ANSWERS_SQL),
        "katz-counts")
    discounts, _ = _totals(counted, "pairs")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, answers = load(left, right)
        return pa.Table.from_pydict(evaluate(block, answers, words, discounts), schema=SCORES)

    answers = numbered.unionByName(
        counted.where("block >= 0").select("block", F.lit(1).alias("kind"), "bucket", "body"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES_SQL)


def _totals(table: DataFrame, kind: str):
    """A few sums over all buckets: what is needed to discount."""
    width = DISCOUNTED + (4 if kind == "words" else 2)
    columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    row = table.where("sums is not null").agg(*columns, (F.max("bucket") + 1).alias("stride")).first()
    sums = [int(row[f"s{i}"] or 0) for i in range(width)]
    stride = int(row["stride"] or 1)
    if kind == "words":
        return Words.build(sums[0], sums[1], dict(enumerate(sums[2:]))), stride
    return Discounts.from_counts(dict(enumerate(sums))), stride
