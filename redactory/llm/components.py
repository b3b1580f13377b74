"""Connected components of an edge list, label by label, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import materialise

#: Edge lists up to this length are contracted inside one task (16 bytes an edge); longer ones by shuffles.
FEW_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); component is the smallest node reachable.

    Large-star and small-star steps: each node hands its larger neighbours, then
    its smaller ones, to the least node it knows, until the edges are stars.
    The edge list never grows, each round's is written to shared storage, and
    rounds end when one changes nothing.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    short, before = edges.count() <= FEW_EDGES, None
    while True:
        edges = edges.coalesce(1) if short else edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialise(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
