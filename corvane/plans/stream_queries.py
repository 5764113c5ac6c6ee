"""Queries that stream a topic of events from files to its end: once each, in micro-batches, and under hysteresis."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.catalog import query
from corvane.session import fresh_path, table
from corvane.streaming import jobs

_SLICES, _SIZE, _HOURS, _COOLDOWN_H = 3, 20, 6, 12


def _streamed(spark, d, transform, schema, twice: bool = False):
    """What ``transform`` makes of the events as a topic: slices of time are appended, and after each the stream goes on from its checkpoint."""
    topic, out, state = (fresh_path(spark, x) for x in ("topic", "streamed", "stream-state"))
    events = table(spark, d, "events").where("ts IS NOT NULL")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [] if first is None else [first + (last - first) / _SLICES * i for i in range(1, _SLICES)]
    ts = F.col("ts")
    for a, b in zip([None, *cuts], [*cuts, None]):
        after = F.lit(True) if a is None else ts >= F.lit(a).cast("timestamp_ntz")
        part = events.where(after if b is None else after & (ts < F.lit(b).cast("timestamp_ntz")))
        for _ in range(1 + twice):
            jobs.append_events(jobs.envelopes(part, F.col("event_type"), "collector", "event_id", "ts", ["user_id", "event_id"]), topic)
        jobs.run_to_end(transform(jobs.read_events(spark, topic, None)), out, state)
    return spark.read.schema(schema).parquet(out)


@query("SELECT event_type || ':' || event_id AS id, event_type, '1' AS schema_version, user_id FROM events WHERE ts IS NOT NULL")
def stream_once_each(spark, d):
    """A topic in which every event was sent twice."""
    user = F.get_json_object("payload", "$.user_id").cast("long").alias("user_id")
    rows = lambda events: jobs.once_each(events, "40 days").select("id", "event_type", "schema_version", user)
    return _streamed(spark, d, rows, "id string, event_type string, schema_version string, user_id long", twice=True)


@query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, event_type || ':' || event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_type || ':' || event_id) AS i
        FROM events WHERE ts IS NOT NULL),
    t AS (SELECT key, ms, min(i) AS i FROM e GROUP BY key, ms),
    n AS MATERIALIZED (SELECT e.key, e.ms, e.id, e.i, least(e.i + {_SIZE}, coalesce(t.i, e.i + {_SIZE})) AS nxt FROM e ASOF LEFT JOIN t ON e.key = t.key AND e.ms + {_HOURS * 3600_000} <= t.ms),
    b(key, batch, i) AS (SELECT key, 0::BIGINT, 1::BIGINT FROM n WHERE i = 1 UNION ALL SELECT b.key, batch + 1, n.nxt FROM b JOIN n USING (key, i) JOIN e x ON x.key = n.key AND x.i = n.nxt),
    s AS (SELECT n.key, batch, n.ms AS opened_at, n.id AS first_id, least(n.nxt, (SELECT max(i) + 1 FROM e y WHERE y.key = n.key)) - i AS n, i FROM b JOIN n USING (key, i))
    SELECT s.key, batch, opened_at, CAST(n AS INT) AS n, CASE WHEN n = {_SIZE} THEN 'full' ELSE 'timeout' END AS reason, first_id, e.id AS last_id
    FROM s JOIN e ON e.key = s.key AND e.i = s.i + n - 1 WHERE n = {_SIZE} OR opened_at + {_HOURS * 3600_000} <= (SELECT max(ms) FROM e)""")
def stream_flushed_batches(spark, d):
    """Micro-batches by type: 20 events, or what came within 6 hours of event time."""
    flushed = lambda events: jobs.flushed_batches(events.withWatermark("timestamp", "0 seconds"), "event_type", _SIZE, _HOURS * 3600_000)
    return _streamed(spark, d, flushed, jobs.FLUSHED)


@query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, (event_id * 7919 % 97) % 4 AS target, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events WHERE ts IS NOT NULL),
    p(user_id, event_id, i, level, changed) AS (
        SELECT user_id, event_id, i, target, ms FROM e WHERE i = 1
        UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN target > level THEN target WHEN target < level AND ms - changed >= {_COOLDOWN_H * 3600_000} THEN level - 1 ELSE level END,
            CASE WHEN target > level OR (target < level AND ms - changed >= {_COOLDOWN_H * 3600_000}) THEN ms ELSE changed END
        FROM p JOIN e ON e.user_id = p.user_id AND e.i = p.i + 1)
    SELECT user_id, event_id, CAST(level AS INT) AS level FROM p""")
def stream_pressure_levels(spark, d):
    """Each user's level, which rises at once and falls by one in twelve hours."""
    fields = F.from_json("payload", "user_id long, event_id long")
    sample = [fields["user_id"].cast("string").alias("model"), fields["event_id"].alias("id"), F.unix_millis("timestamp").alias("at"), ((fields["event_id"] * 7919 % 97) % 4).cast("int").alias("target")]
    found = _streamed(spark, d, lambda events: jobs.pressure_levels(events.select(*sample), _COOLDOWN_H * 3600_000), "model string, id long, level int")
    return found.select(F.col("model").cast("long").alias("user_id"), F.col("id").alias("event_id"), "level")
