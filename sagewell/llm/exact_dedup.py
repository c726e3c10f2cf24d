"""Exact deduplication by Grace hashing.

Two texts are equal when they are identical after the white-space characters are deleted. Map tasks first
collapse the equal texts they meet in a bounded table, so a group of copies of any size sends one
representative per task. Representatives are dealt to spill buckets by a hash of their content. A bucket whose
distinct contents exceed the budget is dealt again with another seed into further spill files, until each
bucket fits. Every bucket is then resolved in an open-addressing table which compares complete contents; a
hash only says where to look.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import aside, batch, partitions_for, stored, texts_of

#: Fixed by the definition of equality: the characters that are deleted, 0x20 and 0x09 to 0x0D.
DELETED = " \t\n\x0b\x0c\r"
TABLE_BYTES = 32 << 20
BUCKET_BYTES = 48 << 20

SPILL = pa.schema([
    ("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("chars", pa.int64()),
    ("members", pa.int64()), ("best_id", pa.int64()), ("content", pa.binary()), ("winner", pa.bool_()),
])
SPILL_SQL = (
    "doc_id long, rep long, sha string, chars long, members long, best_id long, content binary, winner boolean"
)
RESOLVED = pa.schema([
    ("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keeps", pa.bool_()),
])


class OpenTable:
    """Contents in an open-addressing table with linear probing; equality is that of the whole bytes."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def place(self, digest: int, content: bytes) -> int:
        """The number of this content, which is added when it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = digest & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == digest and self.contents[found] == content:
                return int(found)
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(digest)
        self.contents.append(content)
        self.bytes += len(content) + 64
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for number, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _better(chars: int, doc_id: int | None, than: tuple) -> bool:
    """More code points first, then the smaller id; a null id loses every tie."""
    if chars != than[0]:
        return chars > than[0]
    if doc_id is None or than[1] is None:
        return doc_id is not None and than[1] is None
    return doc_id < than[1]


def _collapse(table_bytes: int):
    """Map side: one row per document, the best row of each local group also carrying the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, emitted = TaskContext.get().partitionId() << 33, 0
        table, best, members, rows, shas = OpenTable(), [], [], [], []

        def flush(start):
            out = {name: [] for name in SPILL.names}
            for row, (doc_id, group, chars) in enumerate(rows):
                wins = best[group][2] == row
                for name, value in zip(SPILL.names, (
                    doc_id, start + group, shas[group], chars, members[group], best[group][1],
                    table.contents[group] if wins else None, wins,
                ), strict=True):
                    out[name].append(value)
                if len(out["rep"]) >= 2000:
                    yield batch(SPILL, out)
                    out = {name: [] for name in SPILL.names}
            yield batch(SPILL, out)

        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                text = text or ""
                content = text.encode("utf-8").translate(None, DELETED.encode())
                sha = hashlib.sha256(content)
                group = table.place(int.from_bytes(sha.digest()[:8], "little"), content)
                if group == len(best):
                    best.append((len(text), doc_id, len(rows)))
                    members.append(0)
                    shas.append(sha.hexdigest())
                elif _better(len(text), doc_id, best[group]):
                    best[group] = (len(text), doc_id, len(rows))
                members[group] += 1
                rows.append((doc_id, group, len(text)))
                if table.bytes > table_bytes or len(rows) > 100_000:
                    yield from flush(base + emitted)
                    emitted += len(table)
                    table, best, members, rows, shas = OpenTable(), [], [], [], []
        yield from flush(base + emitted)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the buckets of a partition one after the other, each in its own table."""
    state: dict = {"bucket": None}

    def flush():
        out = {name: [] for name in RESOLVED.names}
        for rep, group in state["reps"]:
            _, keep_id, keep_rep = state["best"][group]
            for name, value in zip(
                RESOLVED.names, (rep, keep_id, state["size"][group], rep == keep_rep), strict=True
            ):
                out[name].append(value)
        return batch(RESOLVED, out)

    for part in batches:
        narrow = part.select(["bucket", "rep", "sha", "chars", "members", "best_id"]).to_pylist()
        for row, content in zip(narrow, part.column("content"), strict=True):
            if row["bucket"] != state["bucket"]:
                if state["bucket"] is not None:
                    yield flush()
                state = {"bucket": row["bucket"], "table": OpenTable(), "best": [], "size": [], "reps": []}
            digest = int(row["sha"][:16], 16)
            group = state["table"].place(digest, content.as_py())
            if group == len(state["best"]):
                state["best"].append((row["chars"], row["best_id"], row["rep"]))
                state["size"].append(0)
            elif _better(row["chars"], row["best_id"], state["best"][group]):
                state["best"][group] = (row["chars"], row["best_id"], row["rep"])
            state["size"][group] += row["members"]
            state["reps"].append((row["rep"], group))
    if state["bucket"] is not None:
        yield flush()


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    table_bytes: int = TABLE_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id. A null
    text counts as empty; all empty texts are equal. A null id takes part and loses ties. Of repeated rows
    with one id exactly one has ``kept``. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    spill = stored(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
        .mapInArrow(_collapse(table_bytes), SPILL_SQL),
        "grace-spill",
    )
    reps = spill.where("winner").withColumn("size", F.octet_length("content"))
    total = reps.agg(F.sum("size")).first()[0] or 0
    fanout = partitions_for(total, bucket_bytes // 2, spark)
    level, done = reps.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(fanout))), None
    seed = 0
    while True:
        # What a bucket's table holds is its distinct contents; many copies of one text are one entry.
        distinct = level.groupBy("bucket", "sha").agg(F.max("size").alias("size"))
        sizes = distinct.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("texts"))
        over = stored(sizes.where((F.col("size") > bucket_bytes) & (F.col("texts") > 1)), "grace-sizes")
        crowded = over.count()
        fits = level.join(over, "bucket", "left_anti") if crowded else level
        part = fits.select("bucket", "rep", "sha", "chars", "members", "best_id", "content")
        answers = (
            part.repartition(fanout, "bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_resolve, "rep long, keep_id long, group_size long, keeps boolean")
        )
        done = answers if done is None else done.unionByName(answers)
        if not crowded:
            break
        seed += 1
        level = stored(level.join(over.select("bucket"), "bucket", "left_semi"), "grace-spill")
        fanout = partitions_for(level.agg(F.sum("size")).first()[0] or 0, bucket_bytes // 4, spark)
        level = level.withColumn("bucket", F.pmod(F.xxhash64("sha", F.lit(seed)), F.lit(fanout)))
    return (
        spill.select("doc_id", "rep", "sha", "winner")
        .join(stored(done, "grace-groups"), "rep")
        .select(
            "doc_id", "keep_id", "group_size", (F.col("winner") & F.col("keeps")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept row of each group of equal texts; columns and their order are unchanged."""
    names, docs = docs.columns, aside(docs, "doc_id", "text")
    kept = stored(exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "grace-kept")
    sha = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), DELETED, "").cast("binary"), 256)
    marked = docs.withColumns({"__sha": sha, "__chars": F.char_length(F.coalesce(F.col("text"), F.lit("")))})
    found = marked.join(
        kept.withColumnRenamed("__sha", "__kept_sha"),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi",
    )
    # Only a table in which an id occurs twice can hold more rows than were kept.
    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    if repeated.isEmpty():
        return found.select(*docs.columns).toDF(*names)
    repeated = stored(repeated, "grace-repeated")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = found.join(repeated, same, "left_anti")
    longest = found.join(repeated, same, "left_semi").groupBy("doc_id", "__sha").agg(
        F.max_by(F.struct(*docs.columns), F.col("__chars")).alias("__row"))
    whole = once.select(*docs.columns).unionByName(longest.select("__row.*").select(*docs.columns))
    return whole.toDF(*names)
