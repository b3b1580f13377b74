"""Merging and de-duplication of spans inside one document's array."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.spans import bound, exploded

SPAN = "struct<start:int,stop:int,type:string,source:string,confidence:double,ord:int>"
EMPTY = f"cast(array() as array<{SPAN}>)"


def as_spans(df: DataFrame, *keys: str) -> DataFrame:
    """Long form to one array per group, in the order of ord; a document's spans only."""
    one = F.struct("ord", F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("stop"), "type", "source", "confidence")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["type"].alias("type"), s["source"].alias("source"), s["confidence"].alias("confidence"), s["ord"].alias("ord")))
    return df.groupBy(*keys).agg(ordered.alias("spans"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (a["stop"] > b["start"])


_PLACED = f"array<struct<i:int,s:{SPAN}>>"


def clusters(spans: Column) -> Column:
    """Runs of spans that overlap each other, from left to right, each an array of structs i (place in spans) and s in the order of spans.

    Spans of different runs share no character, so a fold that asks about overlaps
    may work on each run alone: its cost follows the runs, not the whole text's spans.
    """
    ordered = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    begun = F.struct(F.lit(None).cast("int").alias("reach"), F.expr(f"cast(array() as {_PLACED})").alias("run"), F.expr(f"cast(array() as array<{_PLACED}>)").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["i"].alias("i"), x["s"].alias("s")))
        joins = x["a"] <= acc["reach"]
        return F.when(joins, F.struct(F.greatest(acc["reach"], x["s"]["stop"]).alias("reach"), F.concat(acc["run"], one).alias("run"), acc["runs"].alias("runs"))).otherwise(
            F.struct(x["s"]["stop"].alias("reach"), one.alias("run"), F.concat(acc["runs"], F.array(acc["run"])).alias("runs"))
        )

    runs = F.aggregate(ordered, begun, step, lambda acc: F.concat(acc["runs"], F.array(acc["run"])))
    return F.transform(runs, lambda run: F.when(F.size(run) > 1, F.sort_array(run)).otherwise(run))


def merge_same_type(spans: Column) -> Column:
    """Spans of one type that share more than half of the shorter: the higher confidence stays, in place."""

    def clash(s: Column, o: Column) -> Column:
        shared = F.least(s["stop"], o["stop"]) - F.greatest(s["start"], o["start"])
        return (s["type"] == o["type"]) & (shared > 0) & (shared / F.least(s["stop"] - s["start"], o["stop"] - o["start"]) > 0.5)

    def step(acc: Column, s: Column) -> Column:
        def settled(at: Column) -> Column:
            replaced = F.transform(acc, lambda o, i: F.when((i + 1 == at) & (s["confidence"] > o["confidence"]), s).otherwise(o))
            return F.when(at > 0, replaced).otherwise(F.concat(acc, F.array(s)))

        # the first span kept so far that clashes decides
        return bound(F.array_position(F.transform(acc, lambda o: clash(s, o)), F.lit(True)), settled)

    def fold(run: Column) -> Column:
        own = F.transform(run, lambda x: x["s"])
        return F.when(F.size(run) > 1, F.aggregate(own, F.expr(EMPTY), step)).otherwise(own)

    return by_start(F.flatten(F.transform(clusters(spans), fold)))


def first_writer_wins(spans: Column) -> Column:
    """A span stays only if it overlaps none kept before it."""

    def fold(run: Column) -> Column:
        kept = F.aggregate(run, F.expr(f"cast(array() as {_PLACED})"), lambda acc, x: F.when(F.exists(acc, lambda o: overlaps(x["s"], o["s"])), acc).otherwise(F.concat(acc, F.array(x))))
        return F.when(F.size(run) > 1, kept).otherwise(run)

    kept = F.flatten(F.transform(clusters(spans), fold))
    return F.transform(F.sort_array(kept), lambda x: x["s"])


def added(spans: Column, extra: Column) -> Column:
    """The spans of extra, in order, that overlap none of spans and none of extra that was added before."""
    return F.aggregate(extra, F.expr(EMPTY), lambda acc, s: F.when(F.exists(spans, lambda o: overlaps(s, o)) | F.exists(acc, lambda o: overlaps(s, o)), acc).otherwise(F.concat(acc, F.array(s))))


def sweep(spans: Column) -> Column:
    """From left to right: disjoint spans stay, an overlap that reaches further replaces only with more confidence."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["confidence"]).alias("b"), s["ord"].alias("c"), s.alias("s")))), lambda x: x["s"])

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        swap = (s["stop"] > last["stop"]) & (s["confidence"] > last["confidence"])
        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(s["start"] >= last["stop"], F.concat(acc, F.array(s)))
            .when(swap, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s)))
            .otherwise(acc)
        )

    return F.aggregate(ordered, F.expr(EMPTY), step)


def settled(df: DataFrame, column: str = "spans") -> DataFrame:
    """df with sweep over first_writer_wins of each kind (ord) of the column's spans, none of which may be empty.

    The folds copy what they have kept at every step, so a text's cost grows with the square of its
    spans; this Arrow function finds a span's neighbours by bisection. Null arrays stay null.
    """

    def kept(places: list[tuple[int, int, float, int]]) -> list[int]:
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
        first = []
        for i, (start, stop, _, kind) in enumerate(places):
            own = taken[kind]
            at = bisect_left(own, (stop,))
            if not at or own[at - 1][1] <= start:
                insort(own, (start, stop))
                first.append(i)
        out: list[int] = []
        for i in sorted(first, key=lambda i: (places[i][0], -places[i][2], places[i][3])):
            start, stop, confidence, _ = places[i]
            last = places[out[-1]] if out else None
            if last is None or start >= last[1]:
                out.append(i)
            elif stop > last[1] and confidence > last[2]:
                out[-1] = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(column)
            flat = spans.flatten()
            places = list(zip(*(pc.struct_field(flat, n).to_pylist() for n in ("start", "stop", "confidence", "ord")), strict=True))
            chosen, offsets, at = [], [0], 0
            for n in pc.fill_null(pc.list_value_length(spans), 0).to_pylist():
                chosen += [at + i for i in kept(places[at : at + n])]
                offsets.append(len(chosen))
                at += n
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(chosen, pa.int64())), mask=spans.is_null())
            yield pa.RecordBatch.from_arrays([made if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def by_start(spans: Column) -> Column:
    """Ascending by start; equal starts keep their order."""
    return F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))), lambda x: x["s"])


def unfold(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "spans"]
    return exploded(df, *rest, array="spans", alias="s").select(*rest, F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), "s.type", "s.source", "s.confidence")


def disjoint(df: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of df whose span overlaps none of others in the same document."""
    o = others.select(F.col("doc_id").alias("o_doc"), F.col("span_start").alias("o_start"), F.col("span_end").alias("o_end"))
    return df.join(o, (F.col("doc_id") == F.col("o_doc")) & (F.col("span_start") < F.col("o_end")) & (F.col("span_end") > F.col("o_start")), "left_anti")
