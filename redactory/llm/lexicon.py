"""Exact word counts of a corpus, and the bounded head of frequent words that is sent to all tasks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import parts_of

#: Entries that a task's counter holds before it hands them on.
FLUSH = 400_000
_ROWS = 50_000
#: Levels of frequency in each doubling of a count.
_LEVELS = 16


def tallied(rows: DataFrame, items: Callable[[], Callable[[bytes], Iterable]], kind: str = "word binary") -> DataFrame:
    """(item, n, learned): how often each item comes in all rows, and in those with learn.

    rows: text binary, learn boolean; null texts hold nothing. items() is called
    once in a task; its result gives the items of one text. A task counts in
    memory of bounded size and hands on one row for each distinct item, so a word
    of any frequency reaches the shuffle as one row a task.
    """
    name = kind.split()[0]

    def flush(counters: dict[bool, Counter]) -> Iterator[pa.RecordBatch]:
        for learn, counter in counters.items():
            every, counts = list(counter), list(counter.values())
            counter.clear()
            for at in range(0, len(every), _ROWS):
                n = counts[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(every[at : at + _ROWS], pa.binary() if kind.endswith("binary") else pa.int64()), pa.array(n, pa.int64()), pa.array(n if learn else [0] * len(n), pa.int64())], [name, "n", "learned"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counters = items(), {True: Counter(), False: Counter()}
        for batch in batches:
            for part in parts_of(batch):
                for text, learn in zip(part.column("text").to_pylist(), part.column("learn").to_pylist(), strict=True):
                    if text:
                        counters[bool(learn)].update(of(text))
                        if sum(map(len, counters.values())) > FLUSH:
                            yield from flush(counters)
        yield from flush(counters)

    return rows.select("text", "learn").mapInArrow(run, f"{kind}, n long, learned long")


def summed(tallies: DataFrame) -> DataFrame:
    """One row per item, over all tasks."""
    name = tallies.columns[0]
    return tallies.groupBy(name).agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The items of the highest counts, at most that many of them.

    Levels of frequency are filled from the top while they fit whole, so that no
    sort is needed and equal counts are taken or left together.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * _LEVELS)
    room, cut = most, math.inf
    for at, items in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):  # at most 64 * _LEVELS rows
        room -= items
        if room < 0:
            break
        cut = at
    return counts.where(level >= cut) if cut < math.inf else counts.limit(0)
