"""Sequence packing as a cutting-stock problem, solved by column generation.

Each document's ids are cut into full sequences, one piece of a whole number of
grains and one shorter rest. So lengths fall into few classes however large the
corpus is: the histogram, the linear program and the plan have a fixed size, and
pieces are matched to the plan by their rank within their class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import materialise, per_batch, texts_of
from redactory.llm.tokenids import CACHE_CHUNKS, id_coder

GRAIN = 64
#: Pieces that one (class, block) group should hold.
BLOCK_PIECES = 50_000


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling of one sequence: dynamic programming over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = sizes <= c
        gain = np.where(fit, best[np.maximum(c - sizes, 0)] + values, -1.0)
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], took[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional counts of a relaxed cutting-stock optimum.

    A simplex over patterns: the basis starts with one-class patterns, the knapsack
    prices new ones. Stopping early only leaves a worse plan, never a wrong one.
    """
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = knapsack(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        at, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(at, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = pattern
    return list(zip(basis.T, np.linalg.solve(basis, demand), strict=True))


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan rows (size, first rank, end rank, first sequence, pieces in a sequence, offset) for a histogram of lengths.

    Patterns rounded down come first; what they leave over is packed largest first.
    """
    left = dict(histogram)
    patterns: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], most: int) -> None:
        n = min([most, *(left[s] // k for s, k in pattern.items())])
        if n > 0:
            patterns.append((pattern, n))
            for s, k in pattern.items():
                left[s] -= k * n

    use({capacity: 1}, left.get(capacity, 0)) if left.get(capacity) else None
    for sizes, grain in (([s for s in left if s >= GRAIN and s % GRAIN == 0 and s < capacity], GRAIN), ([s for s in left if s < GRAIN], 1)):
        sizes = np.array(sorted(s for s in sizes if left[s]), dtype=int)
        if len(sizes):
            for pattern, n in column_generation(sizes // grain, np.array([left[int(s)] for s in sizes], float), capacity // grain):
                use({int(s): round(k) for s, k in zip(sizes, pattern, strict=True) if k > 0.5}, int(n + 1e-6))
    while any(left.values()):
        room, pattern = capacity, {}
        for s in sorted((s for s in left if left[s]), reverse=True):
            if k := min(left[s], room // s):
                pattern[s] = k
                room -= k * s
        use(pattern, 1 << 62)
    rows, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for pattern, n in patterns:
        offset = 0
        for s in sorted(pattern, reverse=True):
            rows.append((s, rank[s], rank[s] + n * pattern[s], sequence, pattern[s], offset))
            rank[s] += n * pattern[s]
            offset += s * pattern[s]
        sequence += n
    return rows


def cut(total: int, capacity: int) -> list[int]:
    """Piece lengths of a document of total ids."""
    full, rest = divmod(total, capacity)
    grains, small = divmod(rest, GRAIN)
    return [capacity] * full + [grains * GRAIN] * bool(grains) + [small] * bool(small)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, keep: bool = False, most: int = CACHE_CHUNKS) -> DataFrame:
    """Tokenise whole texts, append end_id and cut: one row per piece, with its ids if keep; a worker keeps about most chunks."""

    def setup():
        coder, end = id_coder(path, most), np.array([end_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for d, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = memoryview(coder.ids(text) + end)
                start = 0
                for n in cut(len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((d, start, n, zlib.crc32(part), len(ids) // 4, np.frombuffer(part, "<u4") if keep else None))
                    start += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * keep
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: 5 + keep], kinds, strict=True)], names)

        return step

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep else "")
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), setup, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, keep: bool = False, most: int = CACHE_CHUNKS) -> DataFrame:
    """Pack all documents: one row per piece with sequence_id and offset.

    Null texts count as empty (their only id is end_id). Repeated rows are packed
    once each; an empty table gives no rows. Only the histogram (at most
    capacity / GRAIN + GRAIN rows) reaches the driver.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, path, end_id, capacity, keep, most), "pieces")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.select("doc_id").count() // BLOCK_PIECES + 1)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    sizes = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    placed = materialise(sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_sequences(histogram, capacity), "size long, rank_from long, rank_to long, first long, per long, at long")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")))
        .join(placed.select("length", "block", "before"), ["length", "block"])
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
    )
    joined = ranked.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    copy = F.col("rank") - F.col("rank_from")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.expr("(rank - rank_from) div per")).cast("long").alias("sequence_id"),
        (F.col("at") + (copy % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep else []),
    )
