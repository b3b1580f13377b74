"""Shared helpers of the training-data operators: tables, shared storage, workers' code."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()
#: Most bytes of an Arrow batch. Spark's own bound is several times that, and each task holds some copies on either side.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once in each application, and keep the session's Arrow batches small.

    A bound other than Spark's own has been set by the user, and stays.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    if not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="redactory-"), "redactory_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "redactory").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is absent, as in local tests, is an own folder made.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df into the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and fixes what
    partition ids and samples gave, so that a later task reads the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/redactory/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts: the fold that decides what may be learned from."""
    return F.crc32(key.cast("string").cast("binary")) % parts


#: A step works on parts of about this many bytes of a batch, so that what it builds beside them stays small.
PART_BYTES = 4 << 20


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in parts of up to PART_BYTES or one row."""
    at = 0
    while at < batch.num_rows:
        rows = batch.num_rows - at
        while rows > 1 and batch.slice(at, rows).nbytes > PART_BYTES:
            rows = (rows + 1) // 2
        yield batch.slice(at, rows)
        at += rows


def per_batch(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a per-task set-up: fn() is called once in a task, its result for each part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            for part in parts_of(batch):
                if (out := step(part)) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


#: A group is sent to all tasks if it holds at least this share of the rows: so at most 1 / HOT_SHARE groups are.
HOT_SHARE = 0.002
#: Most rows of a list of ids that is sent to all tasks; longer lists are joined by shuffle.
FEW_ROWS = 100_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows to one row per group, where a few groups may hold most rows.

    The hot groups (a bounded number) go to the rows; only other rows are shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) >= max(2, int(total * HOT_SHARE)))
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), keys, "left")
    rest = marked.where(F.col("is_hot").isNull()).select(*rows.columns).join(groups, keys)
    return marked.where("is_hot").drop("is_hot").select(*rest.columns).unionByName(rest)


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids: by broadcast if the list is counted short, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_ROWS else ids, key, "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class whole documents of each label, for fitting only.

    Only rows outside fold 1 of 3 qualify; those with the least hash of doc_id are
    taken, so the sample does not depend on order or size. Null labels are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where((fold(F.col("doc_id"), 3) != 1) & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = own.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(own.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def scored(docs: DataFrame, setup: Callable[[], Callable[[list[str]], list[float]]], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from a scorer of text batches."""

    def start():
        score = setup()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([float(s) for s in score(texts_of(batch))], pa.float64())], ["doc_id", "held_out", "score"])

        return step

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id").cast("long"), 3) == 1).alias("held_out"), "text")
    return per_batch(own, start, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_where(docs: DataFrame, setup: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """Rows of docs, all columns, whose text passes; one pass, no join."""

    def start():
        test = setup()
        return lambda batch: batch.filter(pa.array(test(batch.column("text").to_pylist()), pa.bool_()))

    return per_batch(docs, start, docs.schema)


def give_back() -> None:
    """Hand free memory of this process to the system, so that the next task or operator finds it there."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


_in_worker: dict = {}


def in_worker(key: tuple, build: Callable[[], object]):
    """What build() gives, kept in a Python worker between tasks.

    Only the last key's object is kept: a worker that turns to another operator
    lets go of the memory that the one before needed.
    """
    if key not in _in_worker:
        _in_worker.clear()
        gc.collect()  # what was kept may hold itself
        give_back()
        _in_worker[key] = build()
    return _in_worker[key]
