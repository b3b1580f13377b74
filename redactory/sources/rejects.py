"""Reject tables: rows that could not be decoded, parsed or matched, with their reason, beside the rows that were kept."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.sources.storage import scratch


class Divided(NamedTuple):
    """Both sides of a table that was written once: nothing is read or tested twice, and no row is in both or in neither."""

    kept: DataFrame
    rejected: DataFrame  # with reason
    path: str

    def counts(self) -> DataFrame:
        """reason (null: kept) and n: together as many rows as were read."""
        every = self.kept.select(F.lit(None).cast("string").alias("reason")).unionByName(self.rejected.select("reason"))
        return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def divided(df: DataFrame, faults: list[tuple[str, Column]], tag: str, path: str | None = None) -> Divided:
    """Write df to path (else a shared scratch folder) in two parts, by the first fault that a row has.

    A test that gives null does not hold. df must not have columns named reason or is_rejected.
    """
    if {"reason", "is_rejected"} & set(df.columns):
        raise ValueError("reason and is_rejected are names of the reject table")
    reason = F.coalesce(*(F.when(test, F.lit(name)) for name, test in faults), F.lit(None).cast("string"))
    path = path or scratch(df.sparkSession, f"divided-{tag}")
    marked = df.withColumn("reason", reason).withColumn("is_rejected", F.col("reason").isNotNull())
    marked.write.partitionBy("is_rejected").parquet(path)
    back = df.sparkSession.read.schema(marked.schema).parquet(path)
    return Divided(back.where("NOT is_rejected").drop("reason", "is_rejected"), back.where("is_rejected").drop("is_rejected"), path)
