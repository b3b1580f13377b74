"""Importance resampling of documents towards a target's distribution of hashed word runs.

A feature's bucket is its bytes' CRC-32. The head of the vocabulary is exact: the
CRC states of frequent words, from which longer runs continue, and the buckets of
frequent pairs are sent to all tasks; what is not in the head is hashed directly.
Both give the same bucket, so the totals are exact whatever the head holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import materialise, parts_of, per_batch
from redactory.llm.lexicon import frequent, summed, tallied

#: Most words and pairs of the head.
HEAD_WORDS, HEAD_PAIRS = 65_536, 262_144
#: Rows that one range of scores should hold, so that a range is sorted in memory.
RANGE_ROWS = 200_000
#: ASCII letters in lower case, digits and all bytes beyond ASCII; the rest parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, lower-cased in A-Z only."""
    return text.translate(_WORD_BYTES).split()


class Hasher:
    """Buckets of all runs of up to width words."""

    def __init__(self, words: dict[bytes, int], pairs: dict[bytes, int], width: int, buckets: int):
        self.states, self.pairs, self.width, self.buckets = words, pairs, width, buckets

    def state(self, word: bytes) -> int:
        known = self.states.get(word)
        return crc32(word) if known is None else known

    def of(self, words: list[bytes]) -> np.ndarray:
        """All features of a text, repeats too; order does not matter."""
        get, pairs, n = self.states.get, self.pairs, self.buckets
        states = [crc32(w) if s is None else s for w, s in zip(words, map(get, words), strict=True)]
        out = [np.array(states, np.int64) % n]
        if self.width > 1:
            known = [pairs.get(a + b" " + b) for a, b in zip(words, words[1:])]
            out.append(np.array([crc32(b" " + b, s) % n if k is None else k for k, b, s in zip(known, words[1:], states)], np.int64))
        for size in range(3, self.width + 1):
            if size == 3:  # the states of pairs, from which longer runs go on
                states = [crc32(b" " + b, s) for b, s in zip(words[1:], states)]
            states = [crc32(b" " + w, s) for w, s in zip(words[size - 1 :], states)]
            out.append(np.array(states, np.int64) % n)
        return np.concatenate(out) if len(out) > 1 else out[0]


def head(docs: DataFrame, width: int, buckets: int, head_words: int, head_pairs: int) -> Hasher:
    """The exact head: frequent words' CRC states and frequent pairs' buckets, both of bounded number."""
    counts = materialise(summed(tallied(docs, lambda: words_of)), "resample-words")
    words = {bytes(r.word): crc32(r.word) for r in frequent(counts, head_words).select("word").collect()}
    if width < 2:
        return Hasher(words, {}, width, buckets)
    known = frozenset(words)

    def pairs_of(text: bytes) -> list[bytes]:
        own = words_of(text)
        return [a + b" " + b for a, b in zip(own, own[1:]) if a in known and b in known]

    counts = materialise(summed(tallied(docs, lambda: pairs_of)), "resample-pairs")
    return Hasher(words, {bytes(r.word): crc32(r.word) % buckets for r in frequent(counts, head_pairs).select("word").collect()}, width, buckets)


def bucket_totals(docs: DataFrame, hasher: Hasher) -> np.ndarray:
    """How many features of all texts fall into each bucket: one vector a task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(hasher.buckets, np.int64)
        for batch in batches:
            for part in parts_of(batch):
                for text in part.column("text").to_pylist():
                    if text and (words := words_of(text)):
                        totals += np.bincount(hasher.of(words), minlength=hasher.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["bucket", "n"])

    found = np.zeros(hasher.buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        found[r.bucket] = r.n
    return found


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    n, all_own, all_target = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_own + n)) / ((s + 1) * (all_target + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, hasher: Hasher, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text) if text else []
                found = hasher.of(words) if words else ()
                out.append((len(words), len(found), int(gain[found].sum()) if words else 0))
            n_words, n_features, weight = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

        return step

    return per_batch(docs.select("doc_id", "text"), start, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Weights are sums of the gains of a document's features, over exact totals of
    all documents and all target texts; Gumbel noise from the seed and doc_id makes
    the highest scores a draw without replacement. percent of the documents with at
    least least_words words are drawn and ranked from 1; others have no rank.
    Equal scores go by doc_id, then by the row's place. Null texts have no features;
    a null doc_id counts as an empty one and comes first among equals; rows that
    repeat a doc_id are ranked each. Empty tables give no rows. Other columns of
    either table are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.lit(True).alias("learn"))
    hasher = head(own, width, buckets, head_words, head_pairs)
    gain = gains(bucket_totals(own, hasher), bucket_totals(target.select(F.col("text").cast("binary").alias("text")), hasher))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296)))
    rows = materialise(weighed(own, hasher, gain).withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    able = rows.where(F.col("n_words") >= least_words)
    count = able.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // RANGE_ROWS + 1)
    # ranges of the order, then each row's place in its range after all rows of the ranges before
    ranged = materialise(able.repartitionByRange(parts, F.desc("score"), F.asc("doc_id"), F.asc("row")).withColumn("range", F.spark_partition_id()), "resample-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    place = F.row_number().over(inside)
    ranked = ranged.withColumn("place", place).join(F.broadcast(offsets), "range").withColumn("place", (F.col("place") + F.col("before")).cast("long"))  # as many rows as ranges
    result = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked.select(*result, F.when(F.col("place") <= percent * count // 100, F.col("place")).alias("rank"))
    return drawn.unionByName(rows.where(F.col("n_words") < least_words).select(*result, F.lit(None).cast("long").alias("rank")))
