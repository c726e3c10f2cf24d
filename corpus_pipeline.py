"""From documents to training pieces: language, exact copies, near copies, mixture, pieces.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes every stage as Parquet and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sagewell.llm import exact_dedup, langid, mixing, ngram_join, pieces
from sagewell.llm.queries import mix_levels, mix_weights
from sagewell.llm.shared import aside, fold, prepare, stored
from sagewell.sources.tables import table

#: The mixture takes this share of the tokens it is given, each document once at most.
MIX_SHARE = (4, 5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be determined: null texts and texts without a letter.

    The model learns from the labelled rows of the ``documents`` table outside the held-out fold.
    """
    prepare(spark)
    labelled = table(spark, sf_dir, "documents").where(fold("doc_id", 4) != 2).select("lang", "text")
    return langid.known_language(docs, langid.fit(labelled))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group connected by similarity of 0.8 or more."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents so that domains, languages and sources approach their target weights."""
    prepare(spark)
    plain = aside(docs, "doc_id", "text", "lang", "source")
    mixed = mixing.mix(plain, mix_levels(), mix_weights(), share=MIX_SHARE, epochs=1)
    return mixing.taken(mixed, plain.columns).toDF(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids, decoding and spans of every document that is left."""
    prepare(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("digests",))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]
#: SQL has no form for the classifier, the similarity clusters and the piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
