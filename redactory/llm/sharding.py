"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import materialise

#: Rows that one range of ids should hold, so that a range is sorted in memory.
RANGE_ROWS = 200_000


def byte_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Cut the documents, in doc_id order, into shards of near-equal bytes.

    Size is the UTF-8 length of the text (null: none) plus 8. Ranges of ids are
    summed apart; the running total of these sums places each range, a running
    sum inside the range places each row, and the shard is the equal share of the
    whole in which the middle of the row falls. Rows of equal doc_id are ordered
    by size and crc; null ids come first; an empty table gives no rows. Extra
    columns are not carried.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").count() // RANGE_ROWS + 1)
    rows = materialise(sized.repartitionByRange(parts, "doc_id", "size").withColumn("range", F.spark_partition_id()), "shard-sizes")
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    placed = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("range").orderBy("doc_id", "size", "text_crc32")
    ranked = (
        rows.withColumn("own_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("own_rank", F.row_number().over(inside))
        .join(F.broadcast(placed), "range")  # as many rows as ranges, which the setting above bounds
        .withColumn("middle", F.col("bytes_before") + F.col("own_end") - F.expr("size div 2") - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast((middle * {shards}) div all_bytes as int)")).cast("int"))
        .withColumn("rank", F.col("rows_before") + F.col("own_rank") - 1)
    )
    ranked = materialise(ranked.select("doc_id", "size", "text_crc32", "shard", "rank"), "shard-ranks")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
