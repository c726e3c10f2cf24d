"""Similarity join on word n-grams by Jaccard, with MinHash LSH banding.

Documents with the same set of n-grams are one class and are represented once. Every class gets a signature,
cut into bands of one depth: the longest with which all bands together reach the target recall at the
threshold. Classes with an equal band are candidates. Candidate clusters are brought together once, tile by tile, and
every pair in a tile is verified exactly by counting common n-grams, without making pairs into rows.
N-grams are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagewell.llm.graph import components
from sagewell.llm.shared import aside, batch, stored, texts_of

WORDS = 5
SIMILARITY = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
#: A tile holds clusters, or parts of one, of about so much text.
TILE_BYTES = 4 << 20
#: Words whose fingerprints a task remembers, and list entries of shared n-grams it counts at once.
KNOWN_WORDS = 200_000
ENTRIES = 1 << 19
MIX, STEP, FINAL = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
NODES = pa.schema([
    ("doc_id", pa.int64()), ("node", pa.binary()), ("grams", pa.int64()), ("bytes", pa.int64()),
    ("keys", pa.list_(pa.int64())),
])


def prefix_depth(trees: int, similarity: float, recall: float, depth: int = DEPTH) -> int:
    """The longest prefix whose trees still find a pair at the threshold with the wanted probability."""
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


class Shingler:
    """Distinct n-grams of a text as 64-bit fingerprints; a text shorter than n words is one n-gram."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for token in tokens:
            if token not in known:
                known[token] = xxhash.xxh3_64_intdigest(token)
        ids = np.fromiter((known[t] for t in tokens), dtype=np.uint64, count=len(tokens))
        width = min(self.words, len(ids))
        size = len(ids) - width + 1
        grams = np.full(size, width, dtype=np.uint64)
        for offset in range(width):
            grams = (grams ^ ids[offset: offset + size]) * MIX
            grams ^= grams >> np.uint64(31)
            grams += STEP
        grams ^= grams >> np.uint64(29)
        grams *= FINAL
        grams ^= grams >> np.uint64(32)
        return np.unique(grams)


def signature(grams: np.ndarray, values: int) -> np.ndarray:
    """The smallest of every seeded permutation of the fingerprints, in slices of bounded size."""
    rng = np.random.default_rng(11)
    flips = rng.integers(0, 2 ** 63, values, dtype=np.uint64)
    odds = rng.integers(0, 2 ** 63, values, dtype=np.uint64) | np.uint64(1)
    least = np.full(values, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(grams), 4096):
        part = (grams[None, start: start + 4096] ^ flips[:, None]) * odds[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least >> np.uint64(32)


def trie_nodes(least: np.ndarray, trees: int, depth: int, stride: int) -> list[int]:
    """For every tree the key of the trie node at ``depth`` on the path of this signature."""
    return [
        int.from_bytes(xxhash.xxh3_64_digest(
            tree.to_bytes(4, "little") + least[tree * stride: tree * stride + depth].astype("<u4").tobytes()
        ), "little", signed=True)
        for tree in range(trees)
    ]


def describe(docs: DataFrame, words: int, trees: int, depth: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: the class (digest of its n-gram set; null without n-grams) and its trie nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(words), {}
        for part in batches:
            out = {name: [] for name in NODES.names}
            for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                grams = shingle(text)
                node, keys = None, None
                if len(grams):
                    node = xxhash.xxh3_128_digest(grams.tobytes())
                    keys = seen.get(node)
                    if keys is None:
                        keys = trie_nodes(signature(grams, trees * depth), trees, depth, depth)
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[node] = keys
                for name, value in zip(
                    NODES.names, (doc_id, node, len(grams), len(text or ""), keys), strict=True
                ):
                    out[name].append(value)
            yield batch(NODES, out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, node binary, grams long, bytes long, keys array<long>")


class Forest:
    """Union-find over small integers."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def verifier(words: int, similarity: float):
    """Verify all pairs of a tile that belong to one cluster; degrees and a spanning forest come out.

    A tile is one side of a cluster's members against the other; on the diagonal both sides are the same.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        shingle = Shingler(words)
        for _, rows in tile.groupby("cluster", sort=False):
            rows = rows.sort_values("node", kind="stable")
            nodes, docs = rows["node"].to_numpy(), rows["docs"].to_numpy()
            left, right = (rows["side"] != 1).to_numpy(), (rows["side"] != 0).to_numpy()
            sets = [shingle(text) for text in rows["text"]]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
            values = flat[order]
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            slot = np.empty(len(flat), dtype=np.int32)
            slot[order] = np.repeat(
                np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(values))))
            ends = np.append(starts[1:], len(values))
            del flat, order, values, sets
            at = np.concatenate([[0], np.cumsum(size)])
            n = len(size)
            links, forest = np.zeros(n, dtype=np.int64), Forest(n)
            for i in range(n):
                if not left[i]:
                    continue
                own = slot[at[i]: at[i + 1]]
                common = np.zeros(n, dtype=np.int64)
                # No list is longer than n, so a step holds a bounded number of entries.
                step = max(1, ENTRIES // n)
                for first in range(0, len(own), step):
                    some = own[first: first + step]
                    lengths = ends[some] - starts[some]
                    offsets = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
                    common += np.bincount(owner[offsets + np.arange(lengths.sum())], minlength=n)
                # Each pair once: on a diagonal tile by order, else left against right.
                other = right.copy()
                other[i] = False
                if right[i]:
                    other[: i + 1] = False
                near = np.flatnonzero(other & (common >= similarity * (size + size[i] - common) - 1e-9))
                links[i] += docs[near].sum()
                links[near] += docs[i]
                for j in near:
                    if forest.join(i, int(j)):
                        out["a"].append(nodes[i])
                        out["b"].append(nodes[j])
                        out["links"].append(0)
            for i in np.flatnonzero(links):
                out["a"].append(nodes[i])
                out["b"].append(None)
                out["links"].append(links[i])
        return pd.DataFrame(out).astype({"links": "int64"})

    return run


def similar_documents(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES,
    recall: float = RECALL, tile_bytes: int = TILE_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_links, node.

    Two documents are linked when the Jaccard similarity of their sets of lower-cased word n-grams is at least
    ``similarity``. ``n_links`` counts the other documents it is linked to, copies included; ``class_id`` is the
    smallest doc_id it is connected to through links, ``class_size`` how many documents are. A null or empty
    text has no n-grams: it is linked to nothing and is its own class. Null ids take part; a class of null ids
    only has a null class_id. Repeated rows are documents of their own. No rows give no rows.
    """
    depth = prefix_depth(trees, similarity, recall)
    rows = stored(describe(docs, words, trees, depth, id_col, text_col), "ngram-rows")
    nodes = stored(
        rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("docs"), F.max("bytes").alias("bytes"),
            F.first("keys").alias("keys")),
        "ngram-nodes")
    # Trie nodes with two classes or more; the smallest class stands for the node, so stars replace all pairs.
    reached = nodes.select("node", F.explode("keys").alias("key"))
    shared = reached.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    stars = reached.join(shared, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars).withColumnRenamed("root", "cluster")
    members = stored(clusters.join(nodes.drop("keys"), "node"), "ngram-members")
    sizes = members.groupBy("cluster").agg(F.sum("bytes").alias("held"))
    sides = F.ceil(F.col("held") / tile_bytes).cast("int")
    placed = members.join(sizes.select("cluster", "held", F.greatest(sides, F.lit(1)).alias("sides")), "cluster")
    mine = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    # Part p of a cluster meets every part q: tiles (min, max), where it is the left or the right side.
    # Each row of a small cluster goes to one tile; clusters are packed into tiles by their hash.
    tiles = placed.withColumn("part", mine).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    ).select(
        "node", "docs", "cluster",
        F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"),
        F.when(F.col("part") == F.col("q"), 2).when(F.col("part") < F.col("q"), 0).otherwise(1).alias("side"))
    total = members.agg(F.sum("bytes")).first()[0] or 0
    packs = max(1, int(total // (tile_bytes // 2)) + 1)
    tiles = tiles.withColumn(
        "tile", F.when((F.col("lo") == 0) & (F.col("hi") == 0), F.pmod(F.xxhash64("cluster"), F.lit(packs)))
        .otherwise(F.xxhash64("cluster", "lo", "hi")))
    texts = node_texts(docs, rows, members, id_col, text_col, words)
    edges = stored(
        tiles.join(texts, "node").select("tile", F.concat_ws("-", F.hex("cluster"), "lo", "hi").alias("cluster"),
                                         "node", "docs", "side", "text")
        .groupBy("tile").applyInPandas(verifier(words, similarity), "a binary, b binary, links long"),
        "ngram-links")
    degrees = edges.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(edges.where("b is not null"))
    roots = nodes.select("node", "least", "docs").join(linked, "node", "left").join(degrees, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "least", "docs", F.coalesce("links", F.lit(0)).alias("links"))
    whole = roots.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("docs").alias("class_size"))
    found = stored(
        roots.join(whole, "root").select(
            "node", "class_id", "class_size", (F.col("links") + F.col("docs") - 1).alias("n_links"),
            F.col("root")), "ngram-classes")
    return rows.select("doc_id", "node").join(found, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "root")


def with_node(rows: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """``rows`` with ``__node``, the class of each row."""
    at = rows.columns.index(text_col)

    def run(batches):
        shingle = Shingler(words)
        for part in batches:
            found = [shingle(text) for text in texts_of(part.column(at))]
            yield part.append_column("__node", pa.array(
                [xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in found], pa.binary()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__node", T.BinaryType())]))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids that do not tell rows apart: null, or on several rows."""
    ids = rows.groupBy(F.col("doc_id").alias("__twice")).agg(F.count("*").alias("__n"))
    return stored(ids.where("__n > 1 or __twice is null").select("__twice"), "ngram-repeated")


def node_texts(
    docs: DataFrame, rows: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int = WORDS
) -> DataFrame:
    """``node, text``: one text of every class that has candidates, found by the id of its first document."""
    wanted = members.select("node", F.col("least").alias("__id"))
    plain = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    twice = repeated_ids(rows)
    # The ids grow with the documents: the join is by key at every size.
    if twice.isEmpty():
        return plain.join(wanted.hint("merge"), "__id").select("node", "text")
    same = F.col("__id").eqNullSafe(F.col("__twice"))
    # Where an id does not tell rows apart, the class is worked out again from the text.
    again = with_node(plain.join(twice, same, "left_semi"), "text", words).select(F.col("__node").alias("node"), "text")
    again = again.join(wanted.join(twice, same, "left_semi").select("node"), "node", "left_semi")
    return (
        plain.join(wanted.join(twice, same, "left_anti"), "__id").select("node", "text")
        .unionByName(again.groupBy("node").agg(F.max("text").alias("text")))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of connected near copies: the one with the smallest doc_id.

    Rows without any word are all kept. Columns and their order are unchanged.
    """
    names, docs = docs.columns, aside(docs, "doc_id", "text")
    found = stored(similar_documents(docs), "ngram-groups")
    kept = found.where("root is null or doc_id = class_id or class_id is null").select(F.col("doc_id").alias("__id"))
    twice = repeated_ids(found)
    if twice.isEmpty():
        return docs.join(kept, F.col("doc_id") == F.col("__id"), "left_semi").select(*docs.columns).toDF(*names)
    once = kept.join(twice, F.col("__id").eqNullSafe(F.col("__twice")), "left_anti")
    clear = docs.join(once, F.col("doc_id") == F.col("__id"), "left_semi").select(*docs.columns)
    unclear = with_node(docs.join(twice, F.col("doc_id").eqNullSafe(F.col("__twice")), "left_semi"), "text")
    classes = found.where("root is not null").select(
        F.col("node").alias("__node"), F.col("root").alias("__root"), F.col("class_id").alias("__class")).distinct()
    chosen = (
        unclear.join(classes, "__node").where(F.col("doc_id").eqNullSafe(F.col("__class")))
        .groupBy("__root").agg(F.min_by(F.struct(*docs.columns), F.col("__node")).alias("__row"))
        .select("__row.*").select(*docs.columns)
    )
    wordless = unclear.where("__node is null").select(*docs.columns)
    return clear.unionByName(wordless).unionByName(chosen).toDF(*names)
