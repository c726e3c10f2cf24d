"""Hashed embeddings of texts as rows of a matrix."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

DIMENSIONS = 1536
#: Tokens whose slots a task remembers.
REMEMBERED = 200_000


def token_slots(tokens, dims: int):
    """Eight (slot, sign) pairs per token from its SHA-256 digest, four bytes each, as two arrays."""
    digests = b"".join(hashlib.sha256(token.encode("utf-8")).digest() for token in tokens)
    halves = np.frombuffer(digests, dtype=">u2").astype(np.int64).reshape(-1, 16)
    return halves[:, 0::2] % dims, 1.0 - 2.0 * ((halves[:, 1::2] >> 8) & 1)


class Embedder:
    """Signed token counts of texts. Tokens are hashed once while they are remembered."""

    def __init__(self, dims: int = DIMENSIONS):
        self.dims = dims
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.slots, self.signs = np.zeros((0, 8), dtype=np.int32), np.zeros((0, 8), dtype=np.int8)

    def _learn(self, tokens):
        if len(self.place) > REMEMBERED:
            self._forget()
        new = list(set(tokens).difference(self.place))
        if new:
            at = len(self.place)
            self.place.update(zip(new, range(at, at + len(new))))
            if len(self.place) > len(self.slots):
                # Room for twice as many, so that a batch with few new tokens does not copy all others.
                more = ((0, 2 * len(self.place) - len(self.slots)), (0, 0))
                self.slots, self.signs = np.pad(self.slots, more), np.pad(self.signs, more)
            self.slots[at : at + len(new)], self.signs[at : at + len(new)] = token_slots(new, self.dims)

    def counts(self, texts) -> np.ndarray:
        """One row a text; the entries are whole numbers."""
        lowered = [f" {(text or '').lower()} " for text in texts]
        rows = [text.split() or [text] for text in lowered]
        tokens = list(chain.from_iterable(rows))
        self._learn(tokens)
        at = np.fromiter(map(self.place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = (row[:, None] * self.dims + self.slots[at]).ravel()
        held = np.bincount(flat, weights=self.signs[at].ravel(), minlength=len(rows) * self.dims)
        return held.reshape(len(rows), self.dims)


def norms(counts: np.ndarray) -> np.ndarray:
    """Length of every row, 1 for a row of zeros."""
    length = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    return np.where(length == 0, 1.0, length)
