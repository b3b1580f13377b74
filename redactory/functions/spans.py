"""Spans: all places where a pattern matches, as an array in the row, without Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.dialect import java, quoted, re2, screen

EMPTY = "cast(array() as array<struct<start:int,stop:int,value:string>>)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters of a piece.
PIECE = 1024


def pieces(text: Column) -> Column:
    """The text as an array of pieces, from which windows are cut without a walk from the text's begin."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substr(text, i * PIECE + 1, F.lit(PIECE)))


def window(parts: Column, begin: Column, stop: Column) -> Column:
    """Characters begin (0 or more) to stop, as far as the text goes, out of its pieces."""
    first = F.floor(begin / PIECE).cast("int")
    count = F.floor(F.greatest(stop - 1, begin) / PIECE).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(parts, first + 1, count), ""), begin - first * PIECE + 1, F.greatest(stop - begin, F.lit(0)))


def screened(text: Column, patterns: Iterable[tuple[str, bool]]) -> Column:
    """array<int>: places of those of the patterns (and whether case is ignored) that a text may hold, by Arrow's linear matcher.

    It finds whatever the JVM's matcher does, at a small part of its cost a sign, so only texts
    that hold a pattern go through that one. What must follow a match stands in the pattern
    as a plain group. A pattern that Arrow refuses is looked for in every text; null texts hold none.
    The column is a Python function's, so it must not stand inside a lambda.
    """

    def usable(pattern: str) -> str | None:
        try:
            pc.match_substring_regex(pa.array([""]), pattern=pattern)
        except pa.ArrowInvalid:
            return None
        return pattern

    tests = [usable(screen(p, i)) for p, i in patterns]

    def held(texts: pa.Array) -> pa.Array:
        sure = pc.is_valid(texts)
        hits = [sure if t is None else pc.fill_null(pc.match_substring_regex(texts, pattern=t), False) for t in tests]
        by_text = np.array([h.to_numpy(zero_copy_only=False) for h in hits], dtype=bool).T
        offsets = np.concatenate([[0], np.cumsum(by_text.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(by_text.nonzero()[1].astype(np.int32)))

    return F.arrow_udf(held, "array<int>")(F.make_valid_utf8(text))


def spans(text: Column, pattern: str, ignore_case: bool = False, needs: str | None = None, held: Column | None = None) -> Column:
    """array<struct<start, stop, value>> of the non-empty matches, left to right, 0-based, stop exclusive.

    Matches and the gaps between them alternate, so a match starts after all gaps
    up to it and all matches before it. Rows without a match stop at the first test,
    or where held, which screened has found, is false.
    """
    p = F.lit(java(pattern, ignore_case))
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, java(pattern, ignore_case), -1)
    begun = F.struct(F.lit(0).alias("at"), F.expr(EMPTY).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["g"])
        stop = start + F.length(pair["m"])
        one = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), pair["m"].alias("value"))
        return F.when(pair["m"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    # the gap after the last match has no partner; found and gaps stand here once, so each is worked out once
    paired = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    every = F.aggregate(paired, begun, step, lambda acc: acc["out"])
    hit = text.rlike(java(pattern, ignore_case)) if held is None else held
    if needs and held is None:
        hit = (text.rlike(needs) if set(needs) & set("[(\\") else F.contains(text, F.lit(needs))) & hit
    return F.when(hit, every).otherwise(F.expr(EMPTY))


def exploded(df: DataFrame, *columns: str, array: Column | str, alias: str) -> DataFrame:
    """The columns and one row per element of an array.

    An inner explode makes the optimizer filter on the array's size below it, so that
    the array is worked out twice, the first time in the scan's tasks before rows are
    dealt out. The outer one has no such filter; the rows of empty arrays go after it.
    """
    return df.select(*columns, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())


def explode_spans(df: DataFrame, column: str = "spans") -> DataFrame:
    """Long form: the columns of df without column, and start, stop, value."""
    rest = [c for c in df.columns if c != column]
    return exploded(df, *rest, array=column, alias="_s").select(*rest, F.col("_s.start").alias("span_start"), F.col("_s.stop").alias("span_end"), F.col("_s.value").alias("value"))


def sql_spans(source: str, pattern: str, ignore_case: bool = False, carry: str = "doc_id, text") -> str:
    """The same rows as a DuckDB query over a relation with a text column."""
    p = quoted(re2(pattern, ignore_case))
    return f"""
        SELECT {carry}, CAST(s.b AS INTEGER) AS span_start, CAST(s.b + length(s.v) AS INTEGER) AS span_end, s.v AS value FROM (
          SELECT {carry}, unnest(list_transform(m, lambda x, i: {{'b': list_sum(list_transform(g[1:i], lambda y: length(y)))
                 + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0), 'v': x}})) AS s
          FROM (SELECT {carry}, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS g FROM ({source})))"""
