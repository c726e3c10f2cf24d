"""Subword pieces of a public SentencePiece model, with the original byte span of every piece.

Text is first normalised the way the model says: the compiled character map replaces the longest prefix it
knows at each place, white space is escaped and a dummy prefix may be added. The normaliser here keeps, for
every byte of its output, the byte of the original it came from. The library supplies the merges; the length
of each piece then projects it through that alignment to a span of the original UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import texts_of

#: The visible stand-in for a space inside pieces, U+2581.
SPACE = "▁".encode()
#: Rows of one output batch stay below this many pieces.
PIECES_PER_BATCH = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at: at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at: at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes with their replacements."""

    def __init__(self, blob: bytes):
        self.rules = bool(blob)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4)
            self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement for the longest known prefix at ``at``, if there is one."""
        unit = int(self.units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for taken in range(at, len(data)):
            node ^= data[taken]
            unit = int(self.units[node])
            if unit & 0x800000FF != data[taken]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = int(self.units[node]) & 0x7FFFFFFF
                found = taken + 1 - at, self.replacements[start: self.replacements.index(b"\0", start)]
        return found


class Normaliser:
    """Normalised bytes and, for each of their boundaries, the boundary in the original bytes."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(fields.get(n, 1)) for n in (3, 4, 5))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        if self.map.rules or self.squeeze:
            return self._general(data)
        # Without rules only spaces change, each from one byte to three.
        raw = np.frombuffer(data, dtype=np.uint8)
        width = np.where(raw == 32, len(SPACE), 1) if self.escape else np.ones(len(raw), dtype=np.int64)
        align = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
        text = data.replace(b" ", SPACE) if self.escape else data
        lead = (SPACE if self.escape else b" ") if self.prefix else b""
        return lead + text, np.concatenate([np.zeros(len(lead), dtype=np.int64), align])

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        pieces, at = [], 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map.rules else None
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = size, data[at: at + size]
            pieces.append((at, found[1]))
            at += found[0]
        if self.squeeze:
            while pieces and pieces[0][1].strip(b" ") == b"":
                pieces.pop(0)
        space = SPACE if self.escape else b" "
        out, align, blank = bytearray(), [], False
        if self.prefix and pieces:
            out += space
            align += [pieces[0][0]] * len(space)
            blank = self.squeeze
        for start, text in pieces:
            for byte in text:
                if byte == 32:
                    if not (self.squeeze and blank):
                        out += space
                        align += [start] * len(space)
                    blank = True
                else:
                    out.append(byte)
                    align.append(start)
                    blank = False
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = align[-1]
                del out[-len(space):], align[-len(space):]
        return bytes(out), np.array([*align, end], dtype=np.int64)


class Pieces:
    """A loaded model: encode to ids with spans, decode back."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        blob = self.model.serialized_model_proto()
        self.normalise = Normaliser(next((v for n, v in _fields(blob) if n == 3), b""))
        self.lengths = np.array([
            1 if self.model.is_byte(i) else len(self.model.id_to_piece(i).encode())
            for i in range(self.model.get_piece_size())
        ], dtype=np.int64)
        self.unknown, self.begin, self.end = self.model.unk_id(), self.model.bos_id(), self.model.eos_id()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, add_bos=True, add_eos=True)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end original byte of every id; begin and end ids have empty spans."""
        data, align = self.normalise(text.encode("utf-8"))
        size = self.lengths[ids]
        size[0] = size[-1] = 0
        if (ids == self.unknown).any():
            shown = self.model.encode(text, out_type=str)
            size[1:-1] = [
                1 if self.model.is_byte(int(i)) else len(p.encode()) for i, p in zip(ids[1:-1], shown, strict=True)
            ]
        stop = np.cumsum(size)
        if stop[-1] != len(data):
            raise ValueError(f"pieces cover {stop[-1]} of {len(data)} normalised bytes")
        return align[stop - size], align[stop]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


FIELDS = {
    "ids": ("ids array<int>", pa.list_(pa.int32())),
    "spans": ("begins array<long>, ends array<long>", None),
    "decoded": ("decoded string", pa.string()),
    "digests": ("ids_sha256 string, decoded_sha256 string, spans_sha256 string", None),
}


def encode(
    docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "spans", "decoded"),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and the asked outputs.

    ``ids`` are the library's ids with begin and end; ``spans`` are ``begins`` and ``ends``, byte offsets into
    the UTF-8 original, one pair per id; ``decoded`` is the library's text for the ids; ``digests`` are SHA-256
    of the ids as little-endian unsigned 32-bit integers, of the decoded UTF-8 and of the spans as pairs of
    little-endian unsigned 64-bit integers, begin before end. Digests need the spans, so every text is
    normalised and its pieces are checked to cover it. A null text counts as empty: begin and end id only.
    Repeated rows give repeated rows, no rows give none.
    """
    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    if "ids" in outputs:
        columns.append(("ids", pa.list_(pa.int32())))
    if "spans" in outputs:
        columns += [("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    if "decoded" in outputs:
        columns.append(("decoded", pa.string()))
    if "digests" in outputs:
        columns += [(f"{name}_sha256", pa.string()) for name in ("ids", "decoded", "spans")]
    schema = pa.schema(columns)
    ddl = ", ".join(["doc_id long", "n_tokens long", *(FIELDS[name][0] for name in FIELDS if name in outputs)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        out: dict[str, list] = {name: [] for name in schema.names}
        held = 0
        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                text = text or ""
                listed = pieces.encode(text)
                ids = np.array(listed, dtype=np.int64)
                found = {"doc_id": doc_id, "n_tokens": len(ids)}
                if "ids" in outputs:
                    found["ids"] = ids
                if "spans" in outputs or "digests" in outputs:
                    found["begins"], found["ends"] = pieces.spans(text, ids)
                if "decoded" in outputs or "digests" in outputs:
                    decoded = pieces.model.decode(listed)
                    found["decoded"] = decoded
                    if "digests" in outputs:
                        found["ids_sha256"] = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
                        found["decoded_sha256"] = hashlib.sha256(decoded.encode("utf-8")).hexdigest()
                        pairs = np.column_stack([found["begins"], found["ends"]])
                        found["spans_sha256"] = hashlib.sha256(pairs.astype("<u8").tobytes()).hexdigest()
                for name in out:
                    out[name].append(found[name])
                held += len(ids) if len(outputs) > 1 or "digests" not in outputs else 1
                if held >= PIECES_PER_BATCH:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, held = {name: [] for name in schema.names}, 0
        if out["doc_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, ddl)
