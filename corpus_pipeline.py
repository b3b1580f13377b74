"""A corpus pipeline: toxicity, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last keep the columns
of documents. Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import common
from redactory.llm.dedup import exact_groups
from redactory.llm.langid import reject_unknown
from redactory.llm.neardup import drop_near_duplicates
from redactory.llm.packing import pack_documents
from redactory.llm.queries import vocabulary
from redactory.llm.toxicity import reject_toxic

#: A text whose language is less certain than this goes; ordinary texts, mixed ones too, score well above.
LEAST_LANGUAGE_SCORE = 0.3
#: Chunks of texts whose ids a worker keeps in packing: after four stages its executor's heap is as large as it gets.
PACK_CHUNKS = 300_000

#: No SQL says the classifier, the language parser and the packing plan.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    common.ship(spark)
    return reject_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no certain language, go."""
    common.ship(spark)
    return reject_unknown(docs, LEAST_LANGUAGE_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; of rows that also share its doc_id, one.

    Rows are chosen by doc_id and text together, so texts that share a doc_id, or
    have none, are each kept or dropped on their own.
    """
    common.ship(spark)
    ids = exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    rows = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    kept = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_sha") == F.col("kept_sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (three-word shingles, 0.85).

    Rows are told apart by doc_id and text, as in the stage before.
    """
    common.ship(spark)
    return drop_near_duplicates(docs, width=3, percent=85)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 4096 tokens: one row per piece."""
    common.ship(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), most=PACK_CHUNKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to shared storage and read back."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
