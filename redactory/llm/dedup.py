"""Exact de-duplication by 128-bit content hash with a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import attach, materialise


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Grouping goes by
    hash and text together, so Spark compares whole texts within a hash and two
    texts that share one never meet; copies collapse before the shuffle, which a
    group of any size passes as one row per map task. The largest doc_id stays.
    Rows that repeat a doc_id and its text share one decision; a null doc_id is
    never chosen while its group has another. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    groups = rows.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.select("h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size", F.xxhash64("text").alias("t")), "dedup-groups")
    #: The second hash tells the texts of one hash apart, should such a pair ever come up.
    members = rows.select("doc_id", "h", F.xxhash64("text").alias("t"))
    found = attach(members, groups, ["h", "t"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
