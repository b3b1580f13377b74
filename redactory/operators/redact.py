"""Masked and protected texts, rebuilt from disjoint spans in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rebuild(text: Column, parts: Column) -> Column:
    """The text with each part (start, stop, replacement; ascending, disjoint) replaced, left to right."""
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, p["start"] - acc["at"])
        return F.struct(p["stop"].alias("at"), F.concat(acc["out"], gap, p["replacement"]).alias("out"))

    return F.aggregate(parts, begun, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redacted(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with its spans replaced, all inside the row. Of overlapping spans the first, then the longer, stays.

    spans: array of structs with start and stop and what replacement reads; an empty
    or null array leaves the text as it is.
    """
    parts = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("n"), s["stop"].alias("stop"), replacement(s).alias("replacement"))))
    begun = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,n:int,stop:int,replacement:string>>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.when(p["start"] >= acc["at"], F.struct(p["stop"].alias("at"), F.concat(acc["out"], F.array(p)).alias("out"))).otherwise(acc)

    return rebuild(text, F.coalesce(F.aggregate(parts, begun, step, lambda acc: acc["out"]), begun["out"]))


def resolve_value(text: Column, start: Column, stop: Column) -> Column:
    """The span's characters, or null if it does not lie in the text."""
    return F.when((start >= 0) & (stop > start) & (stop <= F.length(text)), F.substr(text, start + 1, stop - start))


def chosen(replacement: Column) -> Column:
    return F.when(F.trim(F.coalesce(replacement, F.lit(""))) == "", "original").when(replacement.rlike(r"^\[.*\]\z"), "masked").otherwise("dummy")
