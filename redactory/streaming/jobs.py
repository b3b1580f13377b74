"""Streaming operators: the same transforms over message streams, and one-shot states.

Each job is a DataFrame-to-DataFrame transform; drain() runs it over what has
arrived (trigger availableNow) into a Parquet sink and returns the sink's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redactory.sources.storage import scratch

#: Answered messages that are handed over at once.
ANSWERS = 100_000


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table replayed as a stream of files; ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def dealt(events: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has, for work that costs far more than a row's way; one file may else be one task's."""
    return events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def drain(out: DataFrame, mode: str = "append", offsets: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read the sink."""
    spark = out.sparkSession
    sink = scratch(spark, "stream")
    out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", offsets or scratch(spark, "offsets")).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def audit_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hourly counters by type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def heartbeat_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of heartbeats of a user; a longer gap starts a new one."""
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("beats")).select("user_id", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "beats")


def text_with_files(messages: DataFrame, scans: DataFrame, wait: str = "30 seconds") -> DataFrame:
    """Each message with the file scans that end within the wait; without one it goes alone."""
    m = messages.withWatermark("ts", "1 minute").alias("m")
    f = scans.select(F.col("user_id").alias("f_user"), F.col("ts").alias("f_ts"), F.col("event_id").alias("scan_id")).withWatermark("f_ts", "1 minute").alias("f")
    return m.join(f, F.expr(f"user_id = f_user AND f_ts >= ts AND f_ts <= ts + INTERVAL {wait}"), "leftOuter").select("event_id", "user_id", "scan_id")


def resend_suppressed(events: DataFrame, within: str = "10 seconds") -> DataFrame:
    """Equal content of a user within the delay passes once."""
    hashed = events.withColumn("content_hash", F.sha2(F.concat_ws("|", "event_type", "props").cast("binary"), 256))
    return hashed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "content_hash"]).select("event_id", "user_id", "content_hash")


class OneShot(StatefulProcessor):
    """The last grant of each key of a bucket, until a use takes it or its time is over.

    State is one packed list of (key, time) for a bucket, read and written once a batch, so
    its cost is that of the rows and not of a call for each key. A timer in event time lets
    the oldest grants go, whether or not their keys ever come again.
    """

    def __init__(self, grants: str, uses: str, seconds: int):
        self.grants, self.uses, self.millis = grants, uses, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.granted = handle, handle.getValueState("granted", "held binary")

    def held(self) -> dict[int, int]:
        if not self.granted.exists():
            return {}
        keys, times = np.frombuffer(self.granted.get()[0], dtype="<i8").reshape(2, -1).tolist()
        return dict(zip(keys, times, strict=True))

    def hold(self, granted: dict[int, int], watermark: int) -> None:
        """Keep the grants whose time is not over and one timer for the first end, or nothing."""
        granted = {k: at for k, at in granted.items() if at + self.millis >= watermark}
        due = [min(granted.values()) + self.millis + 1] if granted else []
        timers = list(self.handle.listTimers())
        for timer in timers if timers != due else ():
            self.handle.deleteTimer(timer)
        if granted:
            self.granted.update((np.array([list(granted.keys()), list(granted.values())], dtype="<i8").tobytes(),))
            if timers != due:
                self.handle.registerTimer(due[0])
        else:
            self.granted.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """A batch's rows of a bucket in the order of their times; a use passes only after its key's grant, never before it."""
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = self.held()
        granted, uses, passes = dict(before), own["event_type"] != self.grants, []
        for k, at, use in zip(own["k"].tolist(), own["at"].tolist(), uses.tolist(), strict=True):
            last = granted.get(k)
            if not use:
                granted[k] = at if last is None else max(at, last)
            else:
                passed = last is not None and 0 <= at - last <= self.millis
                passes.append(passed)
                if passed:
                    del granted[k]
        if granted != before:
            self.hold(granted, timerValues.getCurrentWatermarkInMs())
        out = own.loc[uses.to_numpy(), ["event_id", "k"]].reset_index(drop=True)
        yield out.assign(passed=pd.Series(passes, dtype="bool")).astype({"event_id": "Int64", "k": "int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.hold(self.held(), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"event_id": pd.Series([], dtype="Int64"), "k": pd.Series([], dtype="int64"), "passed": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def one_shot(events: DataFrame, key: str, grants: str, uses: str, seconds: int = 5, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """A grant lets exactly one later use of its key through, if it comes in time.

    Rows without a key or time are left out. Of a batch, rows are taken in the order of
    their times; rows later than the watermark are dropped. Keys are dealt over buckets by
    their hash. Needs the RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = events.withWatermark("ts", late).select(F.col(key).cast("long").alias("k"), "ts", F.unix_millis("ts").alias("at"), "event_id", "event_type")
    own = own.where(F.col("event_type").isin(grants, uses) & F.col("k").isNotNull() & F.col("ts").isNotNull())
    own = own.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))
    return own.groupBy("bucket").transformWithStateInPandas(OneShot(grants, uses, seconds), "event_id long, k long, passed boolean", "Append", "EventTime")


class AsOfPolicy(StatefulProcessor):
    """Messages of a tenant wait for the watermark, then meet the versions that stood at their time.

    State is what can still matter: messages and versions above the watermark, as packed
    Arrow batches that a batch's rows are only added to, and of each part the last version
    below. One timer stands for the earliest row above.
    """

    def __init__(self, stale: dict[str, int]):
        self.stale = {part: seconds * 1_000_000 for part, seconds in stale.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getListState("versions", "part string, at long, id long, body string")
        self.waiting = handle.getListState("waiting", "packed binary")

    @staticmethod
    def table(part: object, at: object, i: object, body: object) -> pa.Table:
        columns = zip((part, at, i, body), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)
        part, at, i, body = (pa.array(c, kind, from_pandas=True) for c, kind in columns)
        return pa.table({"part": part.dictionary_encode(), "at": at, "id": i, "body": body.dictionary_encode()})

    @staticmethod
    def packed(rows: pa.Table) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(rows)
        return out.getvalue().to_pybytes()

    def wake(self, due: int | None, anew: bool = False) -> None:
        """One timer, for the earliest row that waits; anew if the rows that were there are gone."""
        timers = list(self.handle.listTimers())
        due = due if anew else min([*timers, *([] if due is None else [due])], default=None)
        if timers != [due]:
            for timer in timers:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        due = None
        for own in rows:
            first = int(own["at"].min()) // 1000
            due = first if due is None else min(first, due)
            self.waiting.appendValue((self.packed(self.table(own["part"], own["at"], own["id"], own["body"])),))
        self.wake(due)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """All messages below the watermark: rows in the order of time, a version before the messages of its time."""
        watermark = timerValues.getCurrentWatermarkInMs()
        pending = pa.concat_tables([pa.ipc.open_stream(w[0]).read_all() for w in self.waiting.get()] if self.waiting.exists() else [self.table([], [], [], [])])
        below = pending["at"].to_numpy() < watermark * 1000
        rest = pending.filter(pa.array(~below))
        stood = list(self.versions.get()) if self.versions.exists() else []
        done = pa.concat_tables([self.table(*(list(c) for c in zip(*stood, strict=True))), pending.filter(pa.array(below))] if stood else [pending.filter(pa.array(below))])
        is_message = pc.equal(done["part"].cast(pa.string()), "message").to_numpy()
        order = np.lexsort((pc.fill_null(done["id"], -1).to_numpy(), is_message, done["at"].to_numpy()))
        done = done.unify_dictionaries().combine_chunks().take(pa.array(order))
        at, part, is_message = done["at"].to_numpy(), done["part"].cast(pa.string()), is_message[order]
        body, message_at = done["body"].cast(pa.string()).combine_chunks(), at[is_message]
        out, last = {"id": done["id"].filter(pa.array(is_message)), "body": body.filter(pa.array(is_message))}, []
        for name, micros in self.stale.items():
            place = np.maximum.accumulate(np.where(pc.equal(part, name).to_numpy(), np.arange(len(at)), -1))
            last += [int(p) for p in place[-1:] if p >= 0]
            there = place[is_message]
            none = there < 0
            which = pa.array(there, mask=none)
            out |= {f"{name}_version": done["id"].take(which), f"{name}_body": body.take(which), f"{name}_stale": none | (message_at - at[there] > micros)}
        if last:
            self.versions.put([tuple(r.values()) for r in done.take(pa.array(last)).to_pylist()])
        if len(rest):
            self.waiting.put([(self.packed(rest.unify_dictionaries().combine_chunks()),)])
        else:
            self.waiting.clear()
        # a timer that stands at the watermark goes with the one that just fired
        self.wake(max(int(rest["at"].to_numpy().min()) // 1000, watermark + 1) if len(rest) else None, anew=True)
        answers = pa.table({"tenant_id": pa.array(np.full(len(message_at), key[0], dtype="int64")), **out})
        for begin in range(0, len(answers), ANSWERS):
            yield answers.slice(begin, ANSWERS).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def close(self) -> None:
        pass


def policy_as_of(messages: DataFrame, versions: DataFrame, stale: dict[str, int], late: str = "1 hour", salts: int = 8) -> DataFrame:
    """Each message with the newest version of every part that stood at its own time, however late either came.

    messages: tenant_id, ts, id, body; versions: tenant_id, ts, part, id, body, a stream or a
    table read as one. stale names the parts (other ones are ignored) with the seconds after
    which a version counts as stale: it is flagged and still used; where none stood, its id and body are null and
    the flag is set. Of versions at one time, the largest id stands. Columns: tenant_id, id,
    body, and <part>_version, <part>_body, <part>_stale.

    A message is answered once the watermark has passed it, so an earlier version that
    comes up to late after it still counts; rows of either side below the watermark are dropped, as are those without a tenant or
    time. One watermark runs over both sides, so a tenant or side that says nothing holds nobody
    up. A tenant's messages are dealt over salts keys by id, as one tenant may send a third of all; its versions,
    which are few, go to each of them.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    m = messages.select("tenant_id", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "ts", F.lit("message").alias("part"), "id", "body")
    v = versions.where(F.col("part").isin(*stale)).select("tenant_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "ts", "part", "id", "body")
    both = m.unionByName(v).where(F.col("tenant_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    own = both.select(F.col("tenant_id").cast("long").alias("tenant_id"), "salt", "ts", F.unix_micros("ts").alias("at"), "part", F.col("id").cast("long").alias("id"), F.col("body").cast("string").alias("body"))
    schema = "tenant_id long, id long, body string" + "".join(f", {p}_version long, {p}_body string, {p}_stale boolean" for p in stale)
    return own.groupBy("tenant_id", "salt").transformWithStateInPandas(AsOfPolicy(stale), schema, "Append", "EventTime")


def with_refresh(stream: DataFrame, load: Callable[[], DataFrame], handle: Callable[[DataFrame, DataFrame, int], None]) -> None:
    """Hand each micro-batch over with small tables that are read anew for it."""
    stream.writeStream.foreachBatch(lambda batch, n: handle(batch, load(), n)).option("checkpointLocation", scratch(stream.sparkSession, "offsets")).trigger(availableNow=True).start().awaitTermination()
