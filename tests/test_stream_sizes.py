"""What the streams' processors do with a key of many events."""

import random

import pandas as pd
import pyarrow as pa

from corvane.streaming import jobs
from tests.test_streaming import flushed


class State:
    """A processor's handle and its state in memory; writes are counted."""

    def __init__(self):
        self.values, self.timers, self.writes = {}, set(), 0

    def getValueState(self, name, schema):
        handle = self

        class Named:
            exists = lambda _: name in handle.values
            get = lambda _: handle.values[name]
            clear = lambda _: handle.values.pop(name, None)

            def update(self, value):
                handle.values[name], handle.writes = value, handle.writes + 1

            put = update

        return Named()

    getListState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def frames(key, rows, columns):
    """A group's packed rows, in two parts."""
    table = pa.Table.from_pydict({"key": [key] * len(rows), **{c: [r[i] for r in rows] for i, c in enumerate(columns)}})
    batches = [b for part in (table[: len(rows) // 2], table[len(rows) // 2 :]) for b in jobs._pack(part.to_batches())]
    return iter([b.to_pandas() for b in batches])


def test_a_triggers_batches_leave_in_one_frame():
    for size, timeout in ((1, 50), (3, 0), (5, 40), (20, 300), (7, 10_000)):
        rng, at, rows = random.Random(size), 1_700_000_000_000, []
        for i in range(3000):
            at += rng.choice([0, 1, 5, 40, 90])
            rows.append((at, f"e{i:05}", "k"))
        processor, state, got, end = jobs.FlushBatches(size, timeout), State(), [], 0
        processor.init(state)
        for part in (rows[:2], rows[2:3], rows[3:1500], rows[1500:]):
            end = part[-1][0]
            out = list(processor.handleInputRows(("k",), frames("k", rng.sample(part, len(part)), ["at", "id", "_"]), None))
            assert len(out) <= 2  # the one that was open, and all others
            for timer in [t for t in state.timers if t <= end]:
                out += processor.handleExpiredTimer(("k",), None, Expired(timer))
            got += [tuple(r) for frame in out for r in frame.itertuples(index=False)]
        assert sorted(got) == flushed(rows, size, timeout)


def test_a_late_event_joins_the_open_batch():
    processor, state = jobs.FlushBatches(3, 100), State()
    processor.init(state)
    assert list(processor.handleInputRows(("k",), frames("k", [(1000, "b"), (1010, "c")], ["at", "id"]), None)) == []
    (out,) = processor.handleInputRows(("k",), frames("k", [(900, "a"), (905, "d")], ["at", "id"]), None)
    assert out.values.tolist() == [["k", 0, 1000, 3, "full", "b", "a"]]
    assert state.values["waiting"] == [("d",)] and state.values["open"] == (905, 1) and state.timers == {1005}


def test_events_reach_a_processor_packed(spark):
    rows = spark.range(20_000, numPartitions=2).selectExpr("if(id % 3 = 0, null, concat('k', id % 3)) AS key", "id AS at", "cast(id AS string) AS id")
    found = jobs.packed(rows)
    assert found.count() == 6  # three keys in each of two tasks
    table = jobs.by_time(iter([found.where("key IS NULL").toPandas()]))
    assert table["at"].to_pylist() == list(range(0, 20_000, 3)) and table["id"].to_pylist() == [str(i) for i in range(0, 20_000, 3)]


def test_levels_of_a_bucket_are_read_and_written_at_once():
    rng, base = random.Random(9), 1_700_000_000_000
    samples = [(rng.choice([None, *(f"m{k}" for k in range(200))]), i, base + 10 * (i // 3), rng.randrange(4)) for i in range(6000)]
    processor, state, got, calls = jobs.Hysteresis(4000), State(), {}, 0
    processor.init(state)
    for part in (samples[:900], samples[900:4000], samples[4000:]):
        for frame in processor.handleInputRows((0,), frames(0, rng.sample(part, len(part)), ["model", "id", "at", "target"]), None):
            got |= {(r.id): (r.model, r.level) for r in frame.itertuples(index=False)}
        calls += 1
    assert state.writes == calls
    now, wanted = {}, {}
    for model, i, at, target in samples:
        level, changed = now.get(model, (0, -(1 << 62)))
        level, moved = jobs.next_level(level, target, at - changed, 4000)
        now[model], wanted[i] = (level, at if moved else changed), (model, level)
    assert got == wanted


def test_levels_of_more_models_than_buckets(spark, tmp_path):
    schema, found = "model string, id long, at long, target int", {}
    for run in range(2):
        rows = [(None if k == 39 else f"m{k}", 100 * run + k, 40_000 * run + k, 3 * (1 - run)) for k in range(40)]
        spark.createDataFrame(rows, schema).write.mode("append").option("ignoreNullFields", "false").json(f"{tmp_path}/samples")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/samples")
        jobs.run_to_end(jobs.pressure_levels(stream, 30_000, buckets=3), f"{tmp_path}/levels", f"{tmp_path}/state")
    for r in spark.read.parquet(f"{tmp_path}/levels").collect():
        found[r.id] = (r.model, r.level)
    assert found == {100 * run + k: (None if k == 39 else f"m{k}", 3 - run) for run in range(2) for k in range(40)}
