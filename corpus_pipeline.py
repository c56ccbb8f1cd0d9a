"""A corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return the columns of ``documents``, the
last one the piece ids of each document. The runner writes each stage's result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import exact, langid, mixing, near, pieces, store

VOCABULARY = "piece_bpe_32k.model"
#: A document goes if its language can't be told, or is less likely than this.
LEAST_LIKELY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tell each document's language, which becomes its ``lang``; those without one go.

    Rows with a null or empty text, one without a letter, or one that no language
    makes likely go; ids and sources may be null. Each row is told for itself, so
    repeated rows stay or go together. An empty table, or one without a known
    language to learn from, gives an empty result.
    """
    path = public_tokenizers.path(VOCABULARY)
    told = langid.predict(docs, langid.train(docs, path), path)
    sure = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_LIKELY))
    return sure.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays.

    White-space runs count as one space and null texts as empty. The smallest id
    stays, rows without one come last, ties and repeated rows go by the row's hash.
    An empty table gives an empty result.
    """
    return exact.exact_dedup(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity one stays: five-word shingles, 0.8 or more.

    The one with the smallest id stays. Null texts and texts without words are like
    no other and stay, as do rows without an id; rows that share an id stay or go
    together. An empty table gives an empty result.
    """
    return near.near_dedup(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to the square root of their sizes, in shuffled order.

    A document comes out no time, once or several times, then with the same id each
    time; so ids repeat from here on. A null source is the source ''. Null ids and
    texts are drawn like others, rows equal in id, source and text draw the same
    number. An empty table gives an empty result.
    """
    return mixing.mix_sources(docs, power=0.5, seed=17).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, checked by decoding them again.

    A row for each row: null and empty texts have no pieces, ids may be null or
    repeat. An empty table gives an empty result.
    """
    return pieces.encode_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("encoding", encoding)]

#: The first, third and last stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
