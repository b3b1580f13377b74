"""Token-id files: fixed-width bit packing with block offsets.

A file row is one block of consecutive documents (ascending doc_id). Its payload is

    magic "TIDB" | version u8 | bits per id u8 | reserved u16 | documents u32 | ids u64
    | ids of each document, u32 each | all ids, bits wide each, most significant bit first, padded to a byte

so the ids of document k start at bit (sum of earlier counts) * bits: any document,
or any id, is read without the others. Blocks live in Parquet files, one row each,
with the block's place (shard, block) and its first id's place in the whole corpus.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import materialise, texts_of
from redactory.llm.tokenids import id_coder

HEADER = struct.Struct("<4sBBHIQ")
MAGIC = b"TIDB"
#: A block closes with the document that takes it to this many ids.
BLOCK_IDS = 1 << 20


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids of fixed width, most significant bit first."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on; only their bytes are touched."""
    if bits == 16:
        return np.frombuffer(payload, ">u2", n, start * 2).astype("<u4")
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first))[start * bits - first * 8 :][: n * bits]
    out = np.zeros((n, 32), np.uint8)
    out[:, 32 - bits :] = flat.reshape(n, bits)
    return np.packbits(out, axis=1).view(">u4").ravel().astype("<u4")


def write_block(counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    return HEADER.pack(MAGIC, 1, bits, 0, len(counts), len(ids)) + np.array(counts, "<u4").tobytes() + pack_ids(ids, bits)


class Block:
    """A packed block, read lazily."""

    def __init__(self, payload: bytes):
        magic, version, self.bits, _, n, self.n_ids = HEADER.unpack_from(payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token-id block")
        self.counts = np.frombuffer(payload, "<u4", n, HEADER.size).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.payload = payload[HEADER.size + 4 * n :]

    def document(self, k: int) -> np.ndarray:
        return unpack_ids(self.payload, self.bits, int(self.starts[k]), int(self.counts[k]))

    def slice(self, start: int, n: int) -> np.ndarray:
        return unpack_ids(self.payload, self.bits, start, n)


def write_token_files(docs: DataFrame, path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode every whole text, append end_id, and write blocks in ascending doc_id order.

    Rows written: shard (range of doc_id), block (in it), doc_ids array, n_ids, payload.
    Null texts count as empty (their only id is end_id). Rows of equal doc_id are
    ordered by text; null ids come first.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")

    def run(batches):
        coder = id_coder(path)
        bits = max(1, (max(coder.size - 1, end_id)).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        shard, block, doc_ids, counts, parts, total = 0, 0, [], [], [], 0

        def flush():
            payload = write_block(counts, np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "doc_ids", "n_ids", "payload"])

        for batch in batches:
            shards = batch.column("shard").to_pylist()
            for d, s, t in zip(batch.column("doc_id").to_pylist(), shards, texts_of(batch), strict=True):
                shard = s
                ids = coder.ids(t) + end
                doc_ids.append(d)
                counts.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= BLOCK_IDS:
                    yield flush()
                    block, doc_ids, counts, parts, total = block + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    return materialise(ordered.mapInArrow(run, "shard int, block int, doc_ids array<long>, n_ids long, payload binary"), "tokenfile")


def place_blocks(files: DataFrame) -> DataFrame:
    """Add base: the number of ids in all blocks before. One small row per block is ranked, payloads are not."""
    sizes = files.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = shards.withColumn("shard_base", F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("shard_base", F.lit(0)).alias("shard_base"))
    inside = sizes.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = inside.join(before, "shard").select("shard", "block", (F.col("shard_base") + F.col("in_shard")).alias("base"))
    return files.join(F.broadcast(bases) if _few(bases) else bases, ["shard", "block"])


def _few(bases: DataFrame, most: int = 100_000) -> bool:
    """Whether the block list is small enough to be sent to all (24 bytes a row); else it is joined by shuffle."""
    return bases.count() <= most


def read_token_files(placed: DataFrame) -> DataFrame:
    """One row per document from the packed blocks: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for doc_ids, base, payload in zip(batch.column("doc_ids").to_pylist(), batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_py())
                ids = memoryview(block.slice(0, block.n_ids).tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(block.starts[:-1] + base), pa.array(block.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("doc_ids", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write, then read back. An empty table gives an empty result."""
    return read_token_files(place_blocks(write_token_files(docs, path, end_id)))
