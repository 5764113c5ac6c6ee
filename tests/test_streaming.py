"""Stateful streams: the same in one run and in many, with restarts from the checkpoint; and bundles of mixed objects."""

import datetime
import random

from pyspark.sql import functions as F

from corvane.sources import bundles
from corvane.streaming import jobs


def flushed(rows, size, timeout_ms):
    """rows: (at in ms, id, key), each key's in order of time. What is let go of by the time of the last event."""
    out, end = [], max(at for at, _, _ in rows)
    for key in {k for _, _, k in rows}:
        batch, ids, opened = 0, [], None
        for at, i, k in sorted(rows):
            if k != key:
                continue
            if ids and at - opened >= timeout_ms:
                out.append((key, batch, opened, len(ids), "timeout", ids[0], ids[-1]))
                ids, batch = [], batch + 1
            opened = opened if ids else at
            ids.append(i)
            if len(ids) == size:
                out.append((key, batch, opened, size, "full", ids[0], ids[-1]))
                ids, batch = [], batch + 1
        if ids and opened + timeout_ms <= end:
            out.append((key, batch, opened, len(ids), "timeout", ids[0], ids[-1]))
    return sorted(out)


def test_flushed_batches_survive_restarts(spark, tmp_path):
    rng, at, rows = random.Random(3), 1_700_000_000_000, []
    for i in range(240):
        at += rng.choice([1, 50, 400, 3000])
        rows.append((at, f"e{i:04}", rng.choice("aab")))
    stamp = lambda ms: datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
    for run in range(4):  # each adds a part of the events and goes on from the checkpoint; the third finds nothing new
        if run != 2:
            part = rows[[0, 90, 0, 150][run] : [90, 150, 0, 240][run]]
            frame = spark.createDataFrame([(i, k, stamp(ms)) for ms, i, k in part], "n string, kind string, ts timestamp")
            jobs.append_events(jobs.envelopes(frame, F.col("kind"), "test", "n", "ts", ["n"]), f"{tmp_path}/topic")
        events = jobs.read_events(spark, f"{tmp_path}/topic", None).withWatermark("timestamp", "0 seconds")
        jobs.run_to_end(jobs.flushed_batches(events, "event_type", 5, 2000), f"{tmp_path}/out", f"{tmp_path}/state")
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == flushed([(ms, f"{k}:{i}", k) for ms, i, k in rows], 5, 2000)


def test_once_each_and_pressure_over_restarts(spark, tmp_path):
    base = 1_700_000_000_000
    samples = [("m", i, base + i * 10_000, t) for i, t in enumerate([0, 3, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0])] + [("n", i, base + i * 10_000, 1) for i in range(3)]
    schema = "model string, id long, at long, target int"
    for run, part in enumerate((samples[:5], samples[5:9], samples[9:])):
        spark.createDataFrame(part, schema).write.mode("append").json(f"{tmp_path}/samples")
        rows = spark.readStream.schema(schema).json(f"{tmp_path}/samples")
        jobs.run_to_end(jobs.pressure_levels(rows, 30_000), f"{tmp_path}/levels", f"{tmp_path}/levels-state")
    found = {(r.model, r.id): r.level for r in spark.read.parquet(f"{tmp_path}/levels").collect()}
    # up at once at 1; one down at 4, when thirty seconds have passed; held at 6; and down again at 7, 10
    assert [found["m", i] for i in range(12)] == [0, 3, 3, 3, 2, 2, 2, 1, 1, 1, 0, 0] and [found["n", i] for i in range(3)] == [1, 1, 1]

    event = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 1))], "n long, ts timestamp")
    for _ in range(3):
        jobs.append_events(jobs.envelopes(event, "kind", "test", "n", "ts", ["n"]), f"{tmp_path}/twice")
        jobs.run_to_end(jobs.once_each(jobs.read_events(spark, f"{tmp_path}/twice")), f"{tmp_path}/once", f"{tmp_path}/once-state")
    once = spark.read.schema(jobs.ENVELOPE).parquet(f"{tmp_path}/once").collect()
    assert sorted(r.id for r in once) == ["kind:1", "kind:2"] and all(r.schema_version == "1" and r.payload.startswith('{"n":') for r in once)


def test_bundles_tell_what_is_wrong(spark, tmp_path):
    i = "11111111-2222-5333-8444-555555555555"
    objects = [
        f'{{"type": "identity", "id": "identity--{i}", "name": ["not", "a", "name"]}}', '"text"', "null", f'{{"id": "identity--{i}"}}', '{"type": "tool", "id": "tool--1"}',
        f'{{"type": "relationship", "id": "relationship--{i}", "relationship_type": "uses", "source_ref": "identity--{i}", "target_ref": "tool--{i}"}}',
        f'{{"type": "report", "id": "report--{i}", "object_refs": ["identity--{i}"], "created_by_ref": "identity--{i}"}}', f'{{"type": "relationship", "id": "relationship--{i}", "source_ref": 5}}',
    ]
    (tmp_path / "good.json").write_text(f'{{"type": "bundle", "id": "bundle--{i}", "objects": [{", ".join(objects)}]}}')
    (tmp_path / "empty.json").write_text(f'{{"type": "bundle", "id": "bundle--{i}", "objects": []}}')
    for name, text in (("text", "no json"), ("list", "[]"), ("other", '{"type": "note"}'), ("id", '{"type": "bundle", "id": 7}'), ("none", f'{{"type": "bundle", "id": "bundle--{i}"}}'), ("many", f'{{"type": "bundle", "id": "bundle--{i}", "objects": [{", ".join("1" * 9)}]}}')):
        (tmp_path / f"{name}.json").write_text(text)
    parsed = bundles.parsed_bundles(bundles.bundle_texts(spark, f"file://{tmp_path}"), max_objects=8)
    errors = {r.bundle.rsplit("/", 1)[1]: r.error for r in parsed.collect()}
    assert errors == {"good.json": None, "empty.json": None, "text.json": "no_json", "list.json": "not_an_object", "other.json": "not_a_bundle", "id.json": "bad_id", "none.json": "no_objects", "many.json": "too_many_objects"}
    found = bundles.bundle_objects(parsed)
    verdicts = lambda stored=None: [r.verdict for r in bundles.judged_objects(found, stored).orderBy("pos").collect()]
    assert verdicts() == ["valid", "not_an_object", "not_an_object", "no_type", "bad_id", "dangling", "valid", "bad_ends"]
    assert verdicts(spark.createDataFrame([(f"tool--{i}",)], "id string"))[5] == "valid"
