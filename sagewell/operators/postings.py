"""Stored postings: lexical retrieval that reads the lists of the asked words and no other.

The inverted table is partitioned by a hash of the word. A list is cut into blocks of entries in falling order of how
often the word occurs in a chunk, and every block carries its largest count, so a reader knows what a block can add
before opening it; the lists of frequent words are salted over several tasks. Reads are equi-joins with the query words
and the partitions no query word falls into are pruned.

Shared words are counted over a query's rarer lists only: a few candidates of the rare words give a score that the best
``k`` reach, and as many of the most frequent lists stay closed as cannot lift a chunk to it (as in MaxScore). All-words matches
start from the rarest list and open further blocks only while their largest count can still reach the ``k``-th best.
Both end with exact scores of the few candidates from the chunk table. No step runs Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.functions.text import let
from sagewell.operators.rank import top_k
from sagewell.operators.scan import PHRASE_BONUS
from sagewell.session import materialized, scratch_folder

#: Entries of a block; entries of a word before its list takes another salt; entries of a stored partition.
BLOCK, SALT_ROWS, SHARD_ROWS = 128, 32_768, 4_000_000
#: Tasks that write a stored partition.
SLOTS = 8
#: A word in at most this share of the chunks is rare enough to look for first candidates by.
RARE = 0.01
#: Lists are opened until a chunk needs more than this many words of the open ones.
SLACK = 5
#: Candidates scored early to learn the k-th best score, as a multiple of k.
SEEDS = 4
#: Rows (a word or a candidate, some 100 bytes each) that may travel to the stored tables instead of a shuffle.
CARRIED_ROWS = 200_000


@dataclass(frozen=True)
class Postings:
    """``lists``: shard, term, salt, block, most, entries (chunk keys); ``terms``: shard, term, df; number of chunks."""

    lists: DataFrame
    terms: DataFrame
    chunks: int


def chunk_key() -> Column:
    """The short name of a chunk in the lists. Two ids of one key only make each other candidates: scores are exact."""
    return F.xxhash64("chunk_id").alias("chunk")


def build_postings(chunks: DataFrame, path: str | None = None, *, text: str = "search_text") -> Postings:
    """Write the inverted table of ``chunks`` (``chunk_id`` and a blank-separated text) and read it back."""
    spark = chunks.sparkSession
    path = path or scratch_folder(spark, "postings")
    words = chunks.select(chunk_key(), F.explode(F.split(text, " ")).alias("term")).where("term <> ''")
    rows = materialized(words.groupBy("term", "chunk").agg(F.count("*").cast("int").alias("n")), "posting-rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("shard", shard).sortWithinPartitions("shard", "term").write.partitionBy(
        "shard").parquet(f"{path}/terms")
    terms = _read_terms(spark, path)
    busy = terms.where(F.col("df") > SALT_ROWS).select("term", F.ceil(F.col("df") / SALT_ROWS).alias("salts"))
    busy = F.broadcast(busy) if busy.count() <= CARRIED_ROWS else busy
    salt = F.pmod(F.col("chunk"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(busy, "term", "left").select(shard.alias("shard"), "term", salt.alias("salt"), "n", "chunk")
    # A slot is a share of a shard: its task holds some SHARD_ROWS / SLOTS entries, whatever the size of the table, and
    # serves the window, the blocks and the folders of the written table alike.
    slot = (F.col("shard") * SLOTS + F.pmod(F.xxhash64("term", "salt"), F.lit(SLOTS))).cast("int")
    slotted = salted.withColumn("slot", slot).repartitionById(shards * SLOTS, F.col("slot"))
    lists = ["slot", "shard", "term", "salt"]
    numbered = top_k(slotted, lists, [F.desc("n"), F.asc("chunk")], 2 ** 31 - 1, "place")
    blocks = numbered.groupBy(*lists, F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("block")).agg(
        F.max("n").alias("most"), F.collect_list("chunk").alias("entries"))
    blocks.drop("slot").write.partitionBy("shard").parquet(f"{path}/lists")
    chunks.select("chunk_id").agg(F.count("*").alias("n")).write.parquet(f"{path}/size")
    return read_postings(spark, path)


def _read_terms(spark: SparkSession, path: str) -> DataFrame:
    # The schema is given: a table without a word has folders without files.
    return spark.read.schema("term string, df long, shard int").parquet(f"{path}/terms")


def read_postings(spark: SparkSession, path: str) -> Postings:
    """A stored inverted table."""
    lists = spark.read.schema("term string, salt int, block int, most int, entries array<long>, shard int").parquet(f"{path}/lists")
    return Postings(lists, _read_terms(spark, path), spark.read.parquet(f"{path}/size").first()["n"])


def _few(table: DataFrame) -> bool:
    return table.count() <= CARRIED_ROWS


def _carried(few: DataFrame) -> DataFrame:
    """A written table, sent to the other side of a join up to a counted size, else shuffled by its key."""
    few = materialized(few, "asked")
    return F.broadcast(few) if _few(few) else few


def _asked_terms(queries: DataFrame, postings: Postings) -> DataFrame:
    """``query_id, term, shard, df, needed, known, place`` of the query words that occur, rarest first."""
    words = queries.select("query_id", F.size("terms").alias("needed"), F.explode("terms").alias("term"))
    shards = postings.terms.select("term", "df", "shard")
    found = shards.join(_carried(words), "term")
    placed = top_k(found, ["query_id"], [F.asc("df"), F.asc("term")], 2 ** 31 - 1, "place")
    known = placed.groupBy("query_id").agg(F.count("*").alias("known"))
    return materialized(placed.join(known, "query_id"), "asked-terms")


def _lists_of(words: DataFrame, postings: Postings) -> DataFrame:
    """The blocks of the lists of a stored table of words; only the partitions that hold one of the words are read."""
    # A condition that always holds marks the word side as one worth pruning the partitions for.
    side = words.where(F.col("shard") >= 0)
    return postings.lists.join(F.broadcast(side) if _few(words) else side, ["shard", "term"])


def _shared_counts(words: DataFrame, postings: Postings) -> DataFrame:
    """``query_id, chunk, shared``: how many of the words' lists hold the chunk."""
    return _lists_of(words.select("query_id", "shard", "term"), postings).select(
        "query_id", F.explode("entries").alias("chunk")).groupBy("query_id", "chunk").agg(
            F.count("*").alias("shared"))


def _described(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    """Candidates (query_id, chunk) with the text and id of the chunks of that key and the query's words."""
    asked = queries.select("query_id", "normalized", "terms")
    held = chunks.select("chunk_id", chunk_key(), F.col(text).alias("held"))
    return held.join(_carried(candidates), "chunk").drop("chunk").join(asked, "query_id")


def _overlap_scores(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    rows = _described(candidates, queries, chunks, text)
    shared = F.size(F.array_intersect("terms", F.split("held", " ")))
    phrase = F.when(F.col("held").contains(F.col("normalized")), PHRASE_BONUS).otherwise(0.0)
    return rows.select("query_id", "chunk_id", (shared + phrase).alias("lexical")).where("lexical > 0")


def _phrase_only(queries: DataFrame, postings: Postings) -> DataFrame:
    """Chunks that may hold a short query inside longer words, without sharing one of its words.

    Only queries whose words of two letters and more stand at the ends can do so. Their longest word is looked up inside
    the words of the table by suffix: an equi-join on the first two letters of every suffix.
    """
    split = F.split("normalized", " ")
    inner = F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda w: F.length(w) >= 2)
    short = queries.where((F.size("terms").between(1, 2)) & (F.size(inner) == 0)).select(
        "query_id", F.element_at(F.array_sort(F.transform("terms", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"].alias("anchor"))
    short = materialized(short, "short-queries")
    if short.isEmpty():
        return short.select("query_id", F.lit(0).cast("long").alias("chunk"))
    suffixes = postings.terms.where(F.length("term") >= 2).select("term", "shard", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substr("term", i))).alias("suffix"))
    holding = suffixes.withColumn("start", F.left("suffix", F.lit(2))).join(
        _carried(short.withColumn("start", F.left("anchor", F.lit(2)))), "start").where(
            F.col("suffix").startswith(F.col("anchor"))).select("query_id", "shard", "term").distinct()
    return _shared_counts(materialized(holding, "holding-words"), postings).select("query_id", "chunk")


def token_overlap(
    queries: DataFrame, chunks: DataFrame, postings: Postings, k: int, *, text: str = "search_text", rare: float = RARE,
) -> DataFrame:
    """Best ``k`` chunks by shared words, 2 more for a chunk holding the whole question: query_id, chunk_id, lexical, rank.

    ``queries`` has ``query_id, normalized`` and distinct ``terms``. The result is exact, ties by chunk id; ``rare`` only
    says which lists find the first candidates.
    """
    queries = materialized(queries.select("query_id", "normalized", "terms"), "lexical-queries")
    words = _asked_terms(queries, postings)
    order = [F.desc("lexical"), F.asc("chunk_id")]

    def reached(counts: DataFrame) -> DataFrame:
        """A score that the best ``k`` of every query reach: 1 where fewer were found, for a word or the phrase is needed."""
        seeds = top_k(counts, ["query_id"], [F.desc("shared"), F.asc("chunk")], SEEDS * k, "_seed").select("query_id", "chunk")
        kth = top_k(_overlap_scores(seeds, queries, chunks, text), ["query_id"], order, k).where(F.col("rank") == k)
        asked = words.select("query_id", "needed").distinct().join(kth.select("query_id", "lexical"), "query_id", "left")
        return asked.withColumn("least", F.coalesce("lexical", F.lit(1.0))).drop("lexical")

    def may_win(counts: DataFrame) -> DataFrame:
        # Inner words of a contained phrase are shared words, so at most the two outer ones are not.
        most = F.col("shared") + F.col("closed")
        return counts.where((most >= F.col("least")) | (
            (most + PHRASE_BONUS >= F.col("least")) & (most >= F.col("needed") - 2)))

    rare_words = words.where((F.col("df") <= rare * postings.chunks) | (F.col("place") == 1))
    # So many of the most frequent lists stay closed: alone they lift no chunk to the score, nor to a whole phrase.
    closed = F.greatest(F.lit(0), F.least(F.floor("least") - 1 - SLACK, F.col("needed") - 3)).cast("int")
    bounds = materialized(reached(_shared_counts(rare_words, postings)).withColumn("closed", closed), "bounds")
    opened = materialized(words.drop("needed").join(bounds, "query_id").where(F.col("place") <= F.col("known") - F.col("closed")), "opened")
    side = F.broadcast(bounds) if _few(bounds) else bounds
    counted = materialized(may_win(_shared_counts(opened, postings).join(side, "query_id")), "shared-counts")
    better = reached(counted).select("query_id", "least")
    candidates = may_win(counted.drop("least").join(better, "query_id")).select("query_id", "chunk")
    found = candidates.unionByName(_phrase_only(queries, postings)).distinct()
    return top_k(_overlap_scores(found, queries, chunks, text), ["query_id"], order, k)


def cover_density(held: Column, terms: Column) -> Column:
    """Sum over the minimal covers (spans that hold every term) of 0.1 / (1 + words that are not needed)."""

    def spans(hits: Column) -> Column:
        """For every place of a term, the latest start of a span that ends there and holds all terms (0: none)."""
        return F.transform(hits, lambda hit: F.struct(hit["place"].alias("end"), F.array_min(F.transform(
            terms, lambda w: F.coalesce(F.array_max(F.filter(hits, lambda h: (h["place"] <= hit["place"]) & (h["word"] == w)))["place"],
                                        F.lit(0)))).alias("start")))

    def total(ends: Column) -> Column:
        covers = F.filter(ends, lambda c, i: (c["start"] > 0) & (
            (i == 0) | (c["start"] > F.coalesce(F.get(ends, i - 1)["start"], F.lit(0)))))
        return F.aggregate(covers, F.lit(0.0), lambda sum_, c: sum_ + F.lit(0.1) / (
            F.lit(1.0) + (c["end"] - c["start"]) - (F.size(terms) - 1)))

    hits = F.filter(
        F.transform(held, lambda w, i: F.struct((i + 1).alias("place"), w.alias("word"))), lambda h: F.array_contains(terms, h["word"]))
    return let(hits, lambda found: let(spans(found), total))


def all_terms(queries: DataFrame, chunks: DataFrame, postings: Postings, k: int, *, text: str = "search_text") -> DataFrame:
    """Best ``k`` of the chunks that hold every query word, by cover density: query_id, chunk_id, lexical, rank.

    An occurrence of the rarest word lies in at most one cover that begins with it and one for each other word, so ``n`` of
    them make at most ``n`` times the words covers of at most 0.1 each: first the head of every list is scored, then the
    blocks whose largest count can still reach the ``k``-th best. Exact, ties by chunk id.
    """
    queries = materialized(queries.select("query_id", "normalized", "terms"), "lexical-queries")
    words = _asked_terms(queries, postings)
    driver = words.where("known = needed AND place = 1").select("query_id", "shard", "term", "needed")

    def densities(blocks: DataFrame) -> DataFrame:
        rows = _described(blocks.select("query_id", F.explode("entries").alias("chunk")), queries, chunks, text)
        held = rows.withColumn("held", F.split("held", " ")).where(F.size(F.array_except("terms", "held")) == 0)
        return held.select("query_id", "chunk_id", F.round(cover_density(F.col("held"), F.col("terms")), 9).alias("lexical"))

    order = [F.desc("lexical"), F.asc("chunk_id")]
    blocks = _lists_of(driver, postings)
    heads = materialized(top_k(densities(blocks.where("block = 0")), ["query_id"], order, k), "heads")
    kth = heads.where(F.col("rank") == k).select("query_id", F.col("lexical").alias("kth"))
    later = blocks.where("block > 0").join(kth, "query_id", "left").where(
        F.col("kth").isNull() | (F.round(0.1 * F.col("most") * F.col("needed"), 9) >= F.col("kth")))
    return top_k(heads.drop("rank").unionByName(densities(later)), ["query_id"], order, k)
