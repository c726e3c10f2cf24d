"""Language identification with error-correcting output codes.

Every language gets a codeword. Each bit of the code has one binary classifier over hashed character n-grams
(the log odds of the n-gram under the languages whose bit is set against the others), so one pass that counts
n-grams per language trains all of them. A text is given the language whose codeword has the smallest
loss-weighted distance to the classifiers' margins.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import aside, batch, texts_of

SLOTS = 1 << 15
ORDERS = (2, 3)
#: Bytes hashed at a time, so that memory does not grow with the longest text.
SLICE = 1 << 20
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
COUNTS = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])
PREDICTED = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_()),
])


def slots(text: str) -> Iterator[np.ndarray]:
    """The hashed n-grams of the lower-cased UTF-8 bytes with one space at either end, slice by slice."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    for start in range(0, len(data), SLICE):
        part = data[start: start + SLICE + max(ORDERS) - 1].astype(np.uint32)
        for order in ORDERS:
            size = min(SLICE, len(part) - order + 1)
            if size <= 0:
                continue
            gram = np.full(size, order, dtype=np.uint32)
            for offset in range(order):
                gram = (gram << np.uint32(8)) ^ part[offset: offset + size]
            yield (gram * np.uint32(2654435761)) >> np.uint32(32 - SLOTS.bit_length() + 1)


def codewords(classes: int) -> np.ndarray:
    """One row of +1 and -1 per class: every split of the classes for few, else the best of seeded codes."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [bits for bits in itertools.product((1, -1), repeat=classes) if bits[0] == 1 and -1 in bits]
        return np.array(columns, dtype=float).T
    length, best = 8 * int(np.ceil(np.log2(classes))) + 8, None
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], size=(classes, length))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = min(
            int((code[i] != code[i + 1:]).sum(axis=1).min()) for i in range(classes - 1)
        )
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bits: np.ndarray

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """The nearest codeword's language, its share among all, and whether the runner-up is close."""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        total, seen = np.zeros(self.weights.shape[1]), 0
        for found in slots(text):
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            seen += len(found)
        margin = total / np.sqrt(seen)
        loss = (np.logaddexp(0.0, -self.code * margin) * self.bits).sum(axis=1)
        order = np.lexsort((np.arange(len(loss)), loss))
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(order[0])
        close = len(order) > 1 and share[best] < 2 * share[order[1]]
        return self.languages[best], float(share[best]), bool(close)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            for start in range(0, len(at), 8192):
                use = at[start: start + 8192]
                yield batch(COUNTS, {"lang": [lang] * len(use), "slot": use, "n": counts[use]})

    for part in batches:
        for lang, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
            if lang not in totals and len(totals) >= 64:
                yield from flush()
                totals = {}
            counts = totals.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
            for found in slots(text):
                counts += np.bincount(found, minlength=SLOTS)
    yield from flush()


def fit(labelled: DataFrame) -> Model:
    """Learn from ``(lang, text)`` rows; rows with a null in either, or an empty language, teach nothing.

    The table that reaches the driver has at most ``SLOTS`` rows per language, whatever the input.
    """
    rows = (
        labelled.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .where("lang is not null and text is not null and lang <> ''")
        .mapInArrow(_count, "lang string, slot int, n long")
        .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(rows["lang"].unique())
    shares = np.zeros((len(languages), SLOTS))
    for number, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        shares[number, own["slot"].to_numpy()] = own["n"].to_numpy()
    # One language must not outweigh another only because more of it was seen.
    shares = (shares + 0.5) / (shares.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    code = codewords(len(languages))
    weights = np.zeros((SLOTS, code.shape[1]), dtype=np.float32)
    bits = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        ones, others = code[:, bit] > 0, code[:, bit] < 0
        if ones.any() and others.any():
            positive, negative = shares[ones].mean(axis=0), shares[others].mean(axis=0)
            odds = np.log(positive / negative)
            weights[:, bit] = odds
            # How far apart the two sides are, in nats per n-gram: a bit that tells little weighs little.
            bits[bit] = ((positive - negative) * odds).sum()
    # Languages of equal texts leave no bit that tells them apart; then all bits weigh alike and every answer is a tie.
    told = bits.sum()
    return Model(languages, code, weights, bits / told if told > 0 else np.full(len(bits), 1 / max(1, len(bits))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (0 to 1), ambiguous.

    A null text, an empty one and one without a letter give ``und`` with score 0, flagged as ambiguous, as does
    a model that learned nothing. Ties go to the language first in order. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = shared.value
        for part in batches:
            found = [decoder.decode(text) for text in texts_of(part.column(1))]
            yield batch(PREDICTED, {
                "doc_id": part.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                "ambiguous": [f[2] for f in found],
            })

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined; columns and their order are unchanged.

    The decision is taken row by row in the scan, so rows need no key. An ambiguous language is still a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, docs = docs.columns, aside(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        decoder = shared.value
        for part in batches:
            known = [decoder.decode(text)[0] != UNDETERMINED for text in texts_of(part.column(at))]
            yield part.filter(pa.array(known, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
