"""Query preparation, relevance boosts, rank fusion and hybrid search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sagewell.functions import vocab
from sagewell.functions.text import contains_any, let, matching_rules, normalized, search_tokens, words
from sagewell.operators.cells import VectorLists, search_lists
from sagewell.operators.postings import Postings, all_terms, token_overlap
from sagewell.operators.rank import top_k
from sagewell.operators.scan import LEXICAL_CAP, LEXICAL_STEP, TOKEN_BOOST, scan_ranks, scan_topk
from sagewell.operators.vectors import with_vectors
from sagewell.session import ensure_checkpoint_dir

# Score weights.
CATEGORY_BOOST, KEYWORD_BOOST = 0.45, 0.25
ALIAS_BOOST, MARKER_BOOST, LANGUAGE_BOOST, OFFER_PENALTY, OFF_TOPIC_PENALTY = 0.85, 0.45, 0.12, 0.35, 0.70
RRF_K = 60
DIGITS = 6


@dataclass(frozen=True)
class SiteProfile:
    """What makes a hit relevant for one site."""

    site_id: str
    aliases: tuple = ()
    url_markers: tuple = ()
    off_topic: tuple = ()
    offer_path: str | None = None


@dataclass(frozen=True)
class HomeLanguage:
    """Language that earns a small boost when the question looks written in it."""

    code: str = "fr"
    letters: str = "éèêç"
    words: tuple = ("pour", "avec")


#: Candidates (query, chunk id, a few numbers: some 150 bytes each) that may travel to the chunks.
CARRIED_ROWS = 200_000


def candidate_limit(limit: int) -> int:
    return max(6 * limit, 20)


def prepare_queries(queries: DataFrame, rules=None, text: str = "text", least_chars: int = 2) -> DataFrame:
    """``raw, normalized, terms, lower, long_tokens, wanted`` of each query."""
    rules = rules or vocab.SEARCH_RULES
    lowered = F.lower(text)
    return (
        queries.withColumn("raw", F.col(text))
        .withColumn("normalized", normalized(F.col(text)))
        .withColumn("terms", search_tokens(F.col("normalized"), least_chars))
        .withColumn("lower", lowered)
        .withColumn("long_tokens", F.filter(F.array_distinct(words(lowered)), lambda w: F.length(w) >= 4))
        .withColumn("wanted", matching_rules(lowered, rules))
    )


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", "title", "section", "category", "content", "source_url"))


def keyword_boost(rules=None) -> Column:
    """Boost of a (query, chunk) row; needs ``wanted, long_tokens, hay, category``."""
    total = F.lit(0.0)
    for name, keywords in rules or vocab.SEARCH_RULES:
        gain = F.when(F.col("category") == name, CATEGORY_BOOST).otherwise(0.0) + F.when(
            contains_any(F.col("hay"), keywords), KEYWORD_BOOST
        ).otherwise(0.0)
        total = total + F.when(F.array_contains("wanted", name), gain).otherwise(0.0)
    shared = F.size(F.filter("long_tokens", lambda w: F.col("hay").contains(w)))
    return total + shared * F.lit(TOKEN_BOOST)


def profile_id(profiles, hay: Column) -> Column:
    """First profile whose site matches or whose alias or marker occurs in the text."""
    text = F.concat_ws(" ", hay, F.lower("source_url"))
    chain = F.lit(None).cast("string")
    for p in reversed(list(profiles)):
        hit = (F.lower("site_id") == p.site_id) | contains_any(text, p.aliases + p.url_markers)
        chain = F.when(hit, p.site_id).otherwise(chain)
    return chain


def _site_parts(profiles, home: HomeLanguage):
    """Chunk-side site score and language gain per profile; configured aliases count for all."""
    hay, url = F.col("hay"), F.lower("source_url")
    configured = F.exists("site_aliases", lambda a: hay.contains(F.lower(a)))
    for p in list(profiles) + [SiteProfile("")]:
        chosen = (F.col("profile_id") == p.site_id) if p.site_id else F.col("profile_id").isNull()
        usable = chosen if p.aliases else chosen & (F.size("site_aliases") > 0)
        alias = configured | contains_any(hay, p.aliases)
        score = F.when(alias, ALIAS_BOOST).otherwise(0.0) + F.when(
            contains_any(url, p.url_markers), MARKER_BOOST
        ).otherwise(0.0)
        if p.offer_path:
            score = score - F.when(url.contains(p.offer_path) & ~alias, OFFER_PENALTY).otherwise(0.0)
        score = score - F.when(contains_any(hay, p.off_topic) & ~alias, OFF_TOPIC_PENALTY).otherwise(0.0)
        gain = F.when(F.col("language") == home.code, LANGUAGE_BOOST).otherwise(0.0)
        yield p, F.when(usable, score).otherwise(0.0), F.when(usable, gain).otherwise(0.0)


def _looks_home(lowered: Column, home: HomeLanguage) -> Column:
    return contains_any(lowered, tuple(home.letters) + tuple(home.words))


def site_boost(profiles, home: HomeLanguage = HomeLanguage()) -> Column:
    """Site relevance of a (query, chunk) row; needs ``lower, hay, source_url, site_aliases, profile_id``."""
    total = F.lit(0.0)
    for p, score, gain in _site_parts(profiles, home):
        on_topic = ~contains_any(F.col("lower"), p.off_topic)
        spoken = F.when(_looks_home(F.col("lower"), home), gain).otherwise(0.0)
        total = total + F.when(on_topic, score + spoken).otherwise(0.0)
    return total


def chunk_features(chunks: DataFrame, profiles, rules=None, home: HomeLanguage = HomeLanguage()) -> DataFrame:
    """The chunk half of the boosts as a sparse vector.

    Every boost is a product of something known of the query and something known of the chunk, so
    a full-rank search adds them to the same matrix product as the cosine.
    """
    entries = []
    for name, keywords in rules or vocab.SEARCH_RULES:
        value = F.when(F.col("category") == name, CATEGORY_BOOST).otherwise(0.0) + F.when(
            contains_any(F.col("hay"), keywords), KEYWORD_BOOST
        ).otherwise(0.0)
        entries.append((f"rule:{name}", value))
    for p, score, gain in _site_parts(profiles, home):
        entries += [(f"site:{p.site_id}", score), (f"lang:{p.site_id}", gain)]
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), v.alias("w")) for k, v in entries]), lambda e: e["w"] != 0
    )
    return (
        chunks.withColumn("hay", haystack())
        .withColumn("profile_id", profile_id(profiles, F.col("hay")))
        .withColumn("_f", pairs)
        .withColumn("features", F.transform("_f", lambda e: e["k"]))
        .withColumn("feature_weights", F.transform("_f", lambda e: e["w"]))
        .withColumnRenamed("hay", "haystack")
        .drop("_f", "profile_id")
    )


def query_features(queries: DataFrame, profiles, home: HomeLanguage = HomeLanguage()) -> DataFrame:
    keys = [F.transform("wanted", lambda name: F.concat(F.lit("rule:"), name))]
    for p in list(profiles) + [SiteProfile("")]:
        on_topic = ~contains_any(F.col("lower"), p.off_topic)
        named = [F.when(on_topic, F.lit(f"site:{p.site_id}"))]
        named.append(F.when(on_topic & _looks_home(F.col("lower"), home), F.lit(f"lang:{p.site_id}")))
        keys.append(F.filter(F.array(*named), lambda k: k.isNotNull()))
    return queries.withColumn("features", F.concat(*keys)).withColumn(
        "feature_weights", F.transform("features", lambda _: F.lit(1.0))
    )


def adjusted(pairs: DataFrame, profiles, rules=None, home: HomeLanguage = HomeLanguage()) -> DataFrame:
    """``adjusted``: cosine plus boosts of scored (query, chunk) rows."""
    ready = pairs.withColumn("hay", haystack()).withColumn("profile_id", profile_id(profiles, F.col("hay")))
    return (
        ready.withColumn("_site", site_boost(profiles, home))
        .withColumn("adjusted", F.round(F.col("base") + keyword_boost(rules) + F.col("_site"), DIGITS))
        .drop("hay", "profile_id", "_site")
    )


def relevance(pairs: DataFrame, profiles, rules=None, home: HomeLanguage = HomeLanguage()) -> DataFrame:
    """Confidence of scored (query, channel, chunk) rows: ``adjusted`` plus the capped lexical share."""
    boosted = adjusted(pairs, profiles, rules, home)
    share = F.when(
        F.col("channel") == "lexical",
        F.least(F.greatest("lexical", F.lit(0.0)) * LEXICAL_STEP, F.lit(LEXICAL_CAP)),
    ).otherwise(0.0)
    return boosted.withColumn("confidence", F.round(F.col("adjusted") + share, DIGITS)).drop("adjusted")


def channel_ranks(channels: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id", "channel").orderBy(F.desc("confidence"), F.asc("chunk_id"))
    return channels.withColumn("channel_rank", F.row_number().over(order))


def rrf(channels: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fuse ranked channels (``query_id, channel, chunk_id, confidence, channel_rank``).

    The order is by the best confidence; the reciprocal-rank sum only breaks ties.
    """
    fused = channels.groupBy("query_id", "chunk_id").agg(
        F.max("confidence").alias("score"),
        F.round(F.sum(1.0 / (F.lit(k) + F.col("channel_rank"))), 9).alias("fusion_score"),
    )
    order = [F.desc("score"), F.desc("fusion_score"), F.asc("chunk_id")]
    return top_k(fused, ["query_id"], order, limit, "fused_rank")


def fuse_pairs(pairs: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """``rrf`` on one row per (query, chunk): ``adjusted, lexical, in_vector, in_lexical``.

    Both channel ranks, the fusion and the cut are windows over the query, so hits keep their text
    and the candidates are neither shuffled again nor joined to themselves.
    """
    share = F.least(F.greatest("lexical", F.lit(0.0)) * LEXICAL_STEP, F.lit(LEXICAL_CAP))
    rows = pairs.withColumn("_vector", F.when(F.col("in_vector"), F.col("adjusted"))).withColumn(
        "_lexical", F.when(F.col("in_lexical"), F.round(F.col("adjusted") + share, DIGITS))
    )

    def part(channel: str) -> Column:
        order = W.partitionBy("query_id").orderBy(F.desc_nulls_last(channel), F.asc("chunk_id"))
        rank = F.row_number().over(order)
        return F.when(F.col(channel).isNotNull(), 1.0 / (F.lit(k) + rank)).otherwise(0.0)

    fused = rows.withColumn("_v", part("_vector")).withColumn("_l", part("_lexical"))
    fused = fused.withColumn("score", F.greatest("_vector", "_lexical")).withColumn(
        "fusion_score", F.round(F.col("_v") + F.col("_l"), 9)
    )
    order = [F.desc("score"), F.desc("fusion_score"), F.asc("chunk_id")]
    return top_k(fused, ["query_id"], order, limit, "fused_rank").drop("_vector", "_lexical", "_v", "_l")


def diversify(fused: DataFrame, limit: int) -> DataFrame:
    """Best hit of every wanted category first, in rule order, then the rest by rank."""
    best = F.row_number().over(W.partitionBy("query_id", "category").orderBy("fused_rank")) == 1
    place = F.array_position("wanted", F.col("category"))
    order = [F.asc_nulls_last("_place"), F.asc("fused_rank")]
    placed = fused.withColumn("_place", F.when(best & (place > 0), place))
    return top_k(placed, ["query_id"], order, limit).drop("_place")


def with_site_aliases(chunks: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Left join of the configured site aliases; no site row means no alias."""
    if sites is None:
        return chunks.withColumn("site_aliases", F.array().cast("array<string>"))
    return chunks.join(sites.select("site_id", "site_aliases"), "site_id", "left").withColumn(
        "site_aliases", F.coalesce("site_aliases", F.array().cast("array<string>"))
    )


def scoped(chunks: DataFrame, site_id: str | None) -> DataFrame:
    """Chunks of one site; no id, blank or ``default`` means all."""
    if site_id is None or site_id.strip().lower() in ("", "default"):
        return chunks
    return chunks.filter(F.col("site_id") == site_id.strip())


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """Chunk table with what the scan needs; stored vectors (``dims, weights, norm``) are used as they are."""
    return chunks if "dims" in chunks.columns else chunks.withColumn("vector_text", F.col("content"))


def asked_vectors(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """Prepared queries in the form of the chunks: with vectors, or with the text a scan embeds."""
    return with_vectors(prepared, "raw") if "dims" in chunks.columns else prepared.withColumn("vector_text", F.col("raw"))


QUERY_COLUMNS = ["query_id", "dims", "weights", "norm", "terms", "normalized", "lower", "long_tokens", "wanted"]
HIT_COLUMNS = [
    "query_id", "rank", "chunk_id", "site_id", "title", "section", "category", "content", "source_url",
    "language", "crawled_at", "valid_until", "score", "fusion_score",
]


def with_details(candidates: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """``candidates`` with columns of their chunks.

    The candidates are written and counted first. Up to ``CARRIED_ROWS`` they are sent to the chunks, so the
    text of the other chunks stays where it is; beyond, both sides meet by chunk id.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    candidates = candidates.checkpoint()
    carried = F.broadcast(candidates) if candidates.count() <= CARRIED_ROWS else candidates
    return chunks.select(*columns).join(carried, "chunk_id")


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    sites: DataFrame | None = None,
    *,
    profiles=(),
    rules=None,
    home: HomeLanguage = HomeLanguage(),
    limit: int = 5,
    site_id: str | None = None,
    candidate_mode: str = "per_channel",
    lexical: str = "overlap",
    postings: Postings | None = None,
    vector_lists: VectorLists | None = None,
    probes: int = 8,
    exact: bool = True,
    near: DataFrame | None = None,
) -> DataFrame:
    """Hits of every query (``query_id, text``) in a chunk table keyed by ``chunk_id``.

    ``per_channel`` cuts each channel by its raw score before the boosts; ``all`` ranks every chunk
    by its boosted confidence. ``lexical`` scores words by ``overlap`` or, among chunks that hold all
    query words, by cover density (``all_terms``). Text columns are joined back for candidates only.

    With ``postings`` and ``vector_lists`` of the same chunks the channels of the ``per_channel`` mode come from these stored tables instead of a scan. ``probes`` cells are read for each query and, if
    the search is ``exact``, those whose bound says so; the hits are then the scan's. A site needs tables of its own.
    ``near`` is the stored result of ``cells.search_lists`` for these cells, if it is known.
    """
    stored = postings is not None and vector_lists is not None
    if stored and (candidate_mode != "per_channel" or scoped(chunks, site_id) is not chunks):
        raise ValueError("stored tables serve the per_channel mode over all chunks they were built from")
    cut = candidate_limit(limit)
    least = 1 if lexical == "all_terms" else 2
    prepared = prepare_queries(queries, rules, least_chars=least)
    table = scoped(chunks, site_id)
    asked = prepared.select("query_id", "lower", "long_tokens", "wanted")
    details = ["chunk_id", "site_id", "title", "section", "category", "content", "source_url", "language",
               "crawled_at", "valid_until"]
    if candidate_mode == "per_channel":
        if stored:
            prepared = with_vectors(prepared, "raw").select(*QUERY_COLUMNS)
            found = stored_channels(prepared, table, postings, vector_lists, cut, lexical, probes, exact, near)
        else:
            found = scan_topk(chunk_vectors(table), asked_vectors(prepared, table), cut, lexical=lexical)
        pairs = found.groupBy("query_id", "chunk_id").agg(
            F.max("base").alias("base"),
            F.max("lexical").alias("lexical"),
            F.bool_or(F.col("channel") == "vector").alias("in_vector"),
            F.bool_or(F.col("channel") == "lexical").alias("in_lexical"),
        )
        if stored:
            kept = [name for name in ("dims", "weights", "norm") if name in table.columns]
            detailed = with_details(pairs, table, details + kept)
            detailed = detailed if kept else with_vectors(detailed, "content")
            named = prepared.select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("dims", "weights", "norm")])
            described = detailed.join(named, "query_id").withColumn("base", F.coalesce("base", cosine()))
        else:
            described = with_details(pairs, table, details)
        described = with_site_aliases(described, sites).join(asked, "query_id")
        hits = fuse_pairs(adjusted(described, profiles, rules, home), cut)
    else:
        ready = chunk_features(chunk_vectors(with_site_aliases(table, sites)), profiles, rules, home)
        featured = query_features(asked_vectors(prepared, table), profiles, home)
        fused = rrf(full_ranks(ready, featured, cut), cut)
        hits = with_details(fused, table, details).join(asked.select("query_id", "wanted"), "query_id")
    return diversify(hits, limit).select(*HIT_COLUMNS)


def cosine() -> Column:
    """Rounded cosine of the sparse vectors ``dims, weights, norm`` and ``q_dims, q_weights, q_norm`` of one row."""
    # Bound once: inside the sum the map would be made anew for every entry of the query.
    dot = let(F.map_from_arrays("dims", "weights"), lambda held: F.aggregate(
        F.arrays_zip("q_dims", "q_weights"), F.lit(0.0),
        lambda total, q: total + F.coalesce(F.try_element_at(held, q["q_dims"]), F.lit(0.0)) * q["q_weights"]))
    return F.round(dot / (F.col("norm") * F.col("q_norm")), DIGITS)


def stored_channels(
    queries: DataFrame, chunks: DataFrame, postings: Postings, lists: VectorLists, cut: int, lexical: str, probes: int,
    exact: bool, near: DataFrame | None = None,
) -> DataFrame:
    """The best ``cut`` chunks of each channel from the stored tables; the cosine of lexical candidates is left open."""
    near = search_lists(queries, lists, cut, probes=probes, exact=exact, near=near)
    match = all_terms if lexical == "all_terms" else token_overlap
    worded = match(queries, chunks.select("chunk_id", "search_text"), postings, cut)
    return near.select(
        "query_id", F.lit("vector").alias("channel"), "chunk_id", F.col("score").alias("base"),
        F.lit(None).cast("double").alias("lexical"),
    ).unionByName(worded.select(
        "query_id", F.lit("lexical").alias("channel"), "chunk_id", F.lit(None).cast("double").alias("base"), "lexical"))


def full_ranks(chunks: DataFrame, queries: DataFrame, cut: int) -> DataFrame:
    """Candidates of the full ranking with their exact rank in each channel they belong to.

    The first scan finds the best chunks per channel. A chunk found by one channel also has a rank
    in the other, possibly far down; the second scan counts it.
    """
    found = scan_topk(
        chunks, queries, cut, lexical="overlap", boosts=True, rank_by={"vector": "confidence", "lexical": "confidence"}
    )
    share = F.least(F.greatest("lexical", F.lit(0.0)) * LEXICAL_STEP, F.lit(LEXICAL_CAP))
    vector_side = F.when(F.col("channel") == "vector", F.col("confidence")).otherwise(
        F.round(F.col("confidence") - share, DIGITS)
    )
    both = found.select(
        "query_id",
        "chunk_id",
        F.explode(
            F.array(
                F.struct(F.lit("vector").alias("channel"), vector_side.alias("confidence")),
                F.struct(
                    F.lit("lexical").alias("channel"),
                    F.when(F.col("lexical") > 0, F.round(vector_side + share, DIGITS)).alias("confidence"),
                ),
            )
        ).alias("c"),
    ).select("query_id", "chunk_id", "c.channel", "c.confidence")
    members = both.filter(F.col("confidence").isNotNull()).dropDuplicates(["query_id", "channel", "chunk_id"])
    ensure_checkpoint_dir(chunks.sparkSession)
    members = members.checkpoint()  # a few dozen rows per query, read three times below
    ranks = scan_ranks(chunks, queries, members)
    return members.join(ranks.withColumnRenamed("rank", "channel_rank"), ["query_id", "channel", "chunk_id"])


def retrieval_summary(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: hit count, best score (0 without hits), category and URL of the first hit."""
    per_query = hits.groupBy("query_id").agg(
        F.count("*").alias("hit_count"),
        F.max("score").alias("top_score"),
        F.min_by("category", "rank").alias("top_category"),
        F.min_by("source_url", "rank").alias("top_source_url"),
    )
    return (
        queries.select("query_id")
        .join(per_query, "query_id", "left")
        .withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
        .withColumn("confidence", F.coalesce("top_score", F.lit(0.0)))
    )


def deduplicated_search(queries: DataFrame, search) -> DataFrame:
    """Run one search per distinct normalised question and join the hits back.

    ``queries`` needs ``query_id, text``; the question is case-folded with blanks collapsed. Where ``queries`` has a
    ``site_id`` or a ``doc_set_hash``, equal questions are one only within a site and a state of its documents, and
    ``search`` gets these columns too.
    """
    from sagewell.functions.text import collapse

    scope = [name for name in ("site_id", "doc_set_hash") if name in queries.columns]
    # Null is a value of a scope like any other, so the key is one string that tells null and text apart.
    key = F.to_json(F.array(collapse(F.lower("text")), *[F.col(name).cast("string") for name in scope]))
    keyed = queries.withColumn("question_key", key)
    distinct = keyed.groupBy("question_key").agg(F.min(F.struct("query_id", "text", *scope)).alias("q")).select(
        "q.*", "question_key"
    )
    hits = search(distinct.select("query_id", "text", *scope))
    answered = distinct.select("question_key", F.col("query_id").alias("asked_id"))
    return (
        keyed.select("query_id", "question_key")
        .join(answered, "question_key")
        .join(hits.withColumnRenamed("query_id", "asked_id"), "asked_id")
        .drop("question_key")
    )
