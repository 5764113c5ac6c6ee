"""Streaming forms: the batch operators under foreachBatch, with idempotent sinks, and stateful pressure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ENVELOPE = "id string, event_type string, schema_version string, source_service string, timestamp timestamp, correlation_id string, payload string"
#: State of processors with timers is kept in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark, path: str, per_trigger: int | None = 100) -> DataFrame:
    """Envelopes from JSON files, as a topic's stand-in; without ``per_trigger`` a trigger takes all files that are there.

    Files come by the time they were written. Within a trigger events may be in any order, but one that is behind the watermark when its
    trigger begins is late, so where order matters a trigger should take all that one writer wrote at once.
    """
    reader = spark.readStream.schema(ENVELOPE)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).json(path)


def envelopes(rows: DataFrame, event_type, source_service: str, id_col: str, at_col: str, payload: list[str]) -> DataFrame:
    """Rows as envelopes; the payload is JSON of some columns, and the id goes by type and row, so that a repeated row repeats it."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    return rows.select(
        F.concat_ws(":", kind, F.col(id_col).cast("string")).alias("id"), kind.alias("event_type"), F.lit("1").alias("schema_version"), F.lit(source_service).alias("source_service"),
        F.col(at_col).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("correlation_id"), F.to_json(F.struct(*payload)).alias("payload"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """Add envelopes to a topic's folder."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def run_batches(events: DataFrame, apply: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch once an event; a batch that is replayed overwrites its own output."""

    def write(batch: DataFrame, n: int) -> None:
        apply(batch.dropDuplicates(["id"])).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Every envelope id once, however often it comes within the time by which events may be late; older ids are forgotten."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def run_to_end(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append what a stream makes of all that is there now, and wait for it. Run again it goes on where it ended."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


FLUSHED = "key string, batch long, opened_at long, n int, reason string, first_id string, last_id string"


#: Rows that a task holds before it packs them.
PACK_ROWS = 1 << 18


def _tables(batches):
    """Arrow batches put together to tables of about ``PACK_ROWS`` rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _pack(batches):
    """(key, rows as an Arrow stream) for each key of a run of rows whose first column is the key."""
    import numpy as np
    import pyarrow as pa

    for table in _tables(batches):
        table = table.sort_by(table.column_names[0])
        keys, rows = table.column(0).combine_chunks(), table.remove_column(0)
        starts = np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1))
        blobs = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(a, b - a))
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), pa.array(blobs, pa.binary())], names=["key", "rows"])


def packed(rows: DataFrame) -> DataFrame:
    """(key, rows): what a task has of a key in few binary rows; the first column is the key.

    Spark hands a processor its input row by row, at ten times the cost of what is done with an event here.
    """
    return rows.mapInArrow(_pack, f"key {rows.schema[0].dataType.simpleString()}, rows binary")


def by_time(frames):
    """A group's packed rows as one Arrow table, by ``at``, then ``id``."""
    import pyarrow as pa

    rows = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for frame in frames for blob in frame["rows"]])
    return rows.sort_by([("at", "ascending"), ("id", "ascending")])


class FlushBatches(StatefulProcessor):
    """Gathers a key's events and lets go of them when there are ``size``, or when the first has waited for ``timeout_ms`` of event time.

    A batch that is full goes at once. One that is old goes with the timer, or before the first event that comes after its time, whichever is
    seen first; what is in it is the same. The open batch is state: its events, when it was opened, and its number. All batches that a
    trigger closes leave in one frame.
    """

    def __init__(self, size: int, timeout_ms: int):
        self.size, self.timeout_ms = size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string")
        self.open = handle.getValueState("open", "opened long, batch long")

    def _flushed(self, key, opened, batch, ids, reason):
        import pandas as pd

        return pd.DataFrame([(key[0], batch, opened, len(ids), reason, ids[0], ids[-1])], columns=[c.split()[0] for c in FLUSHED.split(", ")])

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        opened, batch = self.open.get() if self.open.exists() else (None, 0)
        ids = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        events = by_time(rows)
        at, names = events["at"].to_numpy(), events["id"]
        i = 0
        if ids:
            i = min(self.size - len(ids), int(np.searchsorted(at, opened + self.timeout_ms)))
            ids += names.slice(0, i).to_pylist()
            if len(ids) < self.size and i == len(at):
                return self._keep(opened, batch, ids)
            yield self._flushed(key, opened, batch, ids, "full" if len(ids) == self.size else "timeout")
            batch += 1
        # where a batch that starts at an event ends: at the first one that is too many or too late
        until = np.minimum(np.arange(len(at)) + self.size, np.searchsorted(at, at + self.timeout_ms))
        starts = []
        while i < len(at):
            starts.append(i)
            i = max(i + 1, int(until[i]))
        starts = np.array(starts, "int64")
        ends = np.append(starts[1:], len(at))[: len(starts)]
        if len(starts) and ends[-1] - starts[-1] < self.size:  # nothing has closed the last one yet
            opened, ids = int(at[starts[-1]]), names.slice(int(starts[-1])).to_pylist()
            starts, ends = starts[:-1], ends[:-1]
        else:
            opened, ids = int(at[-1]), []
        if len(starts):
            n = (ends - starts).astype("int32")
            reason = np.where(n == self.size, "full", "timeout")
            yield pd.DataFrame({
                "key": [key[0]] * len(n), "batch": np.arange(batch, batch + len(n)), "opened_at": at[starts], "n": n, "reason": reason,
                "first_id": names.take(starts).to_pylist(), "last_id": names.take(ends - 1).to_pylist(),
            })
        self._keep(opened, batch + len(starts), ids)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ids = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        opened, batch = self.open.get() if self.open.exists() else (None, 0)
        if ids and opened + self.timeout_ms <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._flushed(key, opened, batch, ids, "timeout")
            self._keep(opened, batch + 1, [])

    def _keep(self, opened, batch, ids):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update((opened, batch))
        if ids:
            self.waiting.put([(x,) for x in ids])
            self.handle.registerTimer(opened + self.timeout_ms)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def flushed_batches(events: DataFrame, key, size: int = 200, timeout_ms: int = 1000) -> DataFrame:
    """(key, batch, opened_at, n, reason, first_id, last_id) of a stream of envelopes with a watermark: its micro-batches by key.

    The watermark lets old batches go. An event that comes behind it isn't dropped but joins the batch that is open, or opens one.
    """
    keyed = events.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.unix_millis("timestamp").alias("at"), "id")
    return packed(keyed).groupBy("key").transformWithStateInPandas(FlushBatches(size, timeout_ms), FLUSHED, "append", "eventtime")


def failed_events(batch: DataFrame, schema: str) -> DataFrame:
    """Envelopes whose payload isn't what its schema says: the dead letters."""
    return batch.where(F.from_json("payload", schema).isNull() | F.col("payload").isNull())


def next_level(level: int, target: int, since_change: float, cooldown: float) -> tuple[int, bool]:
    """Pressure rises at once and falls one level a cooldown; the new level, and whether it changed."""
    if target > level:
        return target, True
    if target < level and since_change >= cooldown:
        return level - 1, True
    return level, False


class Hysteresis(StatefulProcessor):
    """The level of each key, which rises at once and falls by one a cooldown; state is the level and when it last changed.

    Keys come by the bucket, since a call and its state cost far more than a key's few samples: a bucket's levels are read and written at once.
    """

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "models array<string>, levels array<int>, changed array<long>")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        now = {model: (level, changed) for model, level, changed in zip(*self.now.get())} if self.now.exists() else {}
        samples, levels = by_time(rows), []
        for model, at, target in zip(*(samples[c].to_pylist() for c in ("model", "at", "target"))):
            level, changed = now.get(model, (0, -(1 << 62)))
            level, moved = next_level(level, target, at - changed, self.cooldown_ms)
            now[model] = level, at if moved else changed
            levels.append(level)
        self.now.update((list(now), *map(list, zip(*now.values()))))
        yield pd.DataFrame({"model": samples["model"].to_pylist(), "id": samples["id"].to_numpy(), "level": levels})

    def close(self) -> None:
        pass


def pressure_levels(samples: DataFrame, cooldown_ms: int = 30_000, buckets: int = 256) -> DataFrame:
    """(model, id, level) of a stream of (model, id as a number, at in milliseconds, target); samples of a trigger are taken by time, then id.

    Models are dealt into ``buckets`` by their hash. Their number belongs to the checkpoint, as the state does.
    """
    dealt = packed(samples.select(F.pmod(F.xxhash64("model"), F.lit(buckets)).alias("key"), "model", "id", "at", "target"))
    return dealt.groupBy("key").transformWithStateInPandas(Hysteresis(cooldown_ms), "model string, id long, level int", "append", "none")
