"""A corpus pipeline: language, quality, near-duplicates, mixture, token ids.

Every stage takes the documents its predecessor kept and is written as Parquet
and read again; all but the last return the columns of `documents`. Models are
fitted on a bounded sample of the stage's own documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, language, line_crf, mixing, near_copies
from parley.llm.queries import vocabulary_path
from parley.llm.shared import id_remainder, landed, table

# Fitted models, fingerprints, permutations and token ids have no form in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter or in no learned language go."""
    learn = F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False))
    model, known = language.fit(docs, learn), language.fit_known(docs, learn)
    return docs.where(language.is_known(F.col("text"), model, known))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for good."""
    labels = table(spark, sf_dir, "labels")
    model = line_crf.fit(docs, labels, F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False)))
    return docs.where(line_crf.score(F.col("text"), model) >= line_crf.GOOD_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose five-word shingles are alike (0.8)."""
    return near_copies.drop(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: a row per document and epoch, with the words taken."""
    return mixing.mixed_texts(docs, mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (32 bit little endian) and their number."""
    return docs.withColumn("ids", bpe.encode(F.col("text").cast("string"), vocabulary_path())).select(
        "doc_id", "lang", "source", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids"
    )


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
