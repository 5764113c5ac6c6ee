"""Queries over operational figures; events stand for jobs, requests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import ops
from corvane.operators import schedule as timetable
from corvane.plans.catalog import query
from corvane.session import table


@query("SELECT event_type AS status, least(count(*), 100) AS n, count(*) >= 100 AS saturated FROM events GROUP BY event_type")
def backlog_saturated(spark, d):
    return ops.saturated_backlog(table(spark, d, "events"), "event_type")


@query("""
    WITH RECURSIVE r AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, event_id % 7 AS amount,
        row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT event_id, user_id, day, n, CASE WHEN amount <= 20 THEN amount ELSE 0 END AS used, amount <= 20 AS allowed FROM r WHERE n = 1
        UNION ALL SELECT r.event_id, r.user_id, r.day, r.n, f.used + CASE WHEN f.used + r.amount <= 20 THEN r.amount ELSE 0 END, f.used + r.amount <= 20
        FROM f JOIN r ON r.user_id = f.user_id AND r.day = f.day AND r.n = f.n + 1)
    SELECT event_id, user_id, CAST(used AS BIGINT) AS used, allowed FROM f""")
def daily_budget_running(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), (F.col("event_id") % 7).alias("amount"))
    return ops.within_budget(rows, 20, ["user_id", "day"], ["ts", "event_id"]).select("event_id", "user_id", "used", "allowed")


@query("""
    SELECT user_id AS topic, lag, CASE WHEN lag >= 50000 THEN 'pause' WHEN lag >= 5000 THEN 'throttle' ELSE 'normal' END AS state,
        CASE WHEN lag >= 50000 THEN 0 WHEN lag >= 5000 THEN 1 ELSE 8 END AS cap
    FROM (SELECT user_id % 10 AS user_id, CAST(sum(greatest(event_id * 3 - event_id, 0)) AS BIGINT) AS lag FROM events GROUP BY user_id % 10)""")
def lag_state(spark, d):
    offsets = table(spark, d, "events").select((F.col("user_id") % 10).alias("topic"), (F.col("event_id") * 3).alias("high"), F.col("event_id").alias("committed"))
    lag = ops.consumer_lag(offsets)
    state = ops.lag_state(F.col("lag"))
    return lag.select("topic", "lag", state.alias("state"), ops.dispatch_cap(state, 8).alias("cap"))


@query("""
    WITH s AS (SELECT event_type, event_id % 100 * 120 AS ms, (event_id % 13 = 0)::INT AS failed FROM events),
    r AS (SELECT event_type, ms, failed, row_number() OVER (PARTITION BY event_type ORDER BY ms) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM s),
    p AS (SELECT event_type, max(n) AS n, max(CASE WHEN r = CAST(ceil(n * 0.95) AS BIGINT) THEN ms END) AS p95_ms, sum(failed) / count(*) AS ratio FROM r GROUP BY event_type)
    SELECT event_type, n, p95_ms, CASE WHEN n < 5 THEN 'normal' WHEN p95_ms >= 10000 OR ratio >= 0.5 THEN 'critical' WHEN p95_ms >= 5000 OR ratio >= 0.25 THEN 'high'
        WHEN p95_ms >= 2000 OR ratio >= 0.1 THEN 'elevated' ELSE 'normal' END AS level FROM p""")
def latency_p95_pressure(spark, d):
    samples = table(spark, d, "events").select("event_type", (F.col("event_id") % 100 * 120).alias("ms"), (F.col("event_id") % 13 == 0).cast("int").alias("failed"))
    # counts of the values first, so that a group is as large as it has different latencies
    values = samples.groupBy("event_type", "ms").agg(F.count("*").alias("c"), F.sum("failed").alias("f"))
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    ranked = values.withColumn("upto", F.sum("c").over(w.orderBy("ms"))).withColumn("n", F.sum("c").over(w)).withColumn("bad", F.sum("f").over(w))
    p = ranked.where(F.col("upto") >= F.ceil(F.col("n") * 0.95)).groupBy("event_type", "n", "bad").agg(F.min("ms").alias("p95_ms"))
    return p.select("event_type", "n", "p95_ms", ops.pressure_level(F.col("p95_ms"), F.col("bad") / F.col("n"), F.col("n")).alias("level"))


@query("""
    WITH e AS (SELECT event_id, CAST(event_id % 12 AS INT) AS error_count FROM events)
    SELECT event_id, error_count, CASE WHEN error_count <= 0 THEN 0.0::DOUBLE
        ELSE least(least(60 * pow(2.0, error_count - 1), 3600.0) * (10000 + event_id % 2001 - 1000) / 10000, 3600.0) END AS delay_s FROM e""")
def backoff_schedule(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 12).cast("int").alias("error_count"))
    return rows.select("event_id", "error_count", ops.backoff_seconds(F.col("error_count"), jitter_of=F.col("event_id")).alias("delay_s"))


@query("""
    SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS finished FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 5000""")
def job_retention_candidates(spark, d):
    import datetime

    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("finished_at"))
    found = ops.purgeable(jobs, "1-URGENT", ("F", "P"), datetime.datetime(1997, 1, 1))
    return found.select("job_id", F.date_format("finished_at", "yyyy-MM-dd").alias("finished"))


@query("""
    SELECT o_orderpriority AS job_type, o_orderstatus AS status, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS oldest FROM orders
    WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL""")
def job_retention_counts(spark, d):
    import datetime

    jobs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("job_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("finished_at"))
    return ops.purgeable_counts(jobs, ("F", "P"), datetime.datetime(1997, 1, 1)).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


_STATES = ("queued", "running", "completed", "failed", "retrying", "cancelled")


@query("""
    WITH s AS (SELECT ['queued', 'running', 'completed', 'failed', 'retrying', 'cancelled'] AS l),
    e AS (SELECT event_id, l[event_id % 6 + 1] AS before, l[(event_id // 6) % 6 + 1] AS after FROM events, s)
    SELECT event_id, before, after, (before || '>' || after) IN ('queued>running', 'queued>cancelled', 'running>completed', 'running>failed', 'running>retrying',
        'running>cancelled', 'retrying>running', 'retrying>failed', 'retrying>cancelled', 'failed>retrying', 'failed>cancelled') AS legal FROM e""")
def job_transition_check(spark, d):
    states = F.array(*[F.lit(s) for s in _STATES])
    at = lambda i: F.get(states, (i % 6).cast("int"))
    rows = table(spark, d, "events").select("event_id", at(F.col("event_id")).alias("before"), at(F.floor(F.col("event_id") / 6)).alias("after"))
    return rows.withColumn("legal", ops.can_transition(F.col("before"), F.col("after")))


_CONNECTOR = """c AS (SELECT event_id, event_id % 17 <> 0 AS enabled, CASE WHEN event_id % 5 = 0 THEN 'running' ELSE 'idle' END AS status,
    CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS error_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS last_run,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS last_success FROM events), n AS (SELECT max(ts) AS now FROM events)"""


def _connectors(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", (e % 17 != 0).alias("enabled"), F.when(e % 5 == 0, "running").otherwise("idle").alias("status"),
        F.when(e % 11 == 0, 2).otherwise(0).alias("error_count"), F.when(e % 3 != 0, F.col("ts")).alias("last_run"),
        F.when(e % 4 != 0, F.col("ts")).alias("last_success"),
    )


@query(f"""WITH {_CONNECTOR} SELECT event_id, CASE WHEN NOT enabled THEN NULL WHEN status = 'running' AND floor(epoch(now)) - floor(epoch(last_run)) > 3600 THEN 'stuck'
    WHEN status = 'running' THEN NULL WHEN error_count > 0 THEN 'errors' WHEN last_run IS NOT NULL AND last_success IS NULL THEN 'never_succeeded'
    WHEN floor(epoch(now)) - floor(epoch(last_success)) > 86400 THEN 'stale' END AS reason FROM c, n""")
def connector_health(spark, d):
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return _connectors(spark, d).select("event_id", ops.connector_health(F.lit(now)).alias("reason"))


@query(f"""WITH {_CONNECTOR}, o AS (SELECT event_id AS id, error_count, last_success, row_number() OVER (PARTITION BY error_count > 0 ORDER BY error_count, last_success DESC NULLS LAST, event_id) AS r FROM c)
    SELECT id, CAST(row_number() OVER (ORDER BY error_count, last_success DESC NULLS LAST, id) AS INT) AS turn FROM o WHERE error_count = 0 OR r <= 8""")
def fair_dispatch(spark, d):
    due = _connectors(spark, d).select(F.col("event_id").alias("id"), "error_count", "last_success")
    return ops.fair_dispatch(due).select("id", "turn")


@query("""
    SELECT event_id AS candidate_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 = 0)::INT, ts, event_id) AS survivor FROM events""")
def candidate_survivor_window(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, "pending").otherwise("approved")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("candidate_id"), F.col("user_id").alias("collection"), F.lit("").alias("candidate_type"), F.col("event_type").alias("value_key"),
        status.alias("status"), F.col("ts").alias("created_at"),
    )
    return ops.survivors(rows)


@query("""
    SELECT event_id, ['normal', 'elevated', 'high', 'critical'][event_id % 4 + 1] AS level, CAST(user_id % 5 AS INT) AS priority,
        user_id % 5 = 0 OR user_id % 5 <= CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS admitted FROM events""")
def admission(spark, d):
    """Each event as a call at a level of pressure."""
    level = F.element_at(F.array(*map(F.lit, ops.LEVELS)), (F.col("event_id") % 4 + 1).cast("int"))
    calls = table(spark, d, "events").select("event_id", level.alias("level"), (F.col("user_id") % 5).cast("int").alias("priority"))
    return calls.withColumn("admitted", ops.admitted(F.col("priority"), F.col("level")))


@query("""
    WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, user_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 4 END AS amount, CAST(ts AS DATE) AS day, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 15 AS run,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN user_id % 3 = 0 THEN 12 ELSE 50 END AS per_run, CASE WHEN user_id % 3 = 0 THEN 4 WHEN user_id % 3 = 1 THEN 500 ELSE 5 END AS per_day FROM events),
    f(event_id, user_id, n, day, run, refused_by, used_run, used_day) AS (
        SELECT event_id, user_id, n, day, run, CASE WHEN amount IS NULL THEN 'no_amount' WHEN amount > per_run THEN 'run' WHEN amount > per_day THEN 'day' END,
            CASE WHEN amount <= per_run AND amount <= per_day THEN amount ELSE 0 END, CASE WHEN amount <= per_run AND amount <= per_day THEN amount ELSE 0 END FROM r WHERE n = 1
        UNION ALL SELECT event_id, user_id, n, day, run, refused_by, CASE WHEN refused_by IS NULL THEN run_before + amount ELSE run_before END, CASE WHEN refused_by IS NULL THEN day_before + amount ELSE day_before END FROM (
            SELECT *, CASE WHEN amount IS NULL THEN 'no_amount' WHEN run_before + amount > per_run THEN 'run' WHEN day_before + amount > per_day THEN 'day' END AS refused_by FROM (
                SELECT r.*, CASE WHEN r.run = f.run THEN used_run ELSE 0 END AS run_before, CASE WHEN r.day = f.day THEN used_day ELSE 0 END AS day_before FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)))
    SELECT event_id, refused_by IS NULL AS allowed, refused_by, CAST(used_run AS BIGINT) AS used_run, CAST(used_day AS BIGINT) AS used_day FROM f""")
def run_and_day_quotas(spark, d):
    """Calls under the quotas of their run (fifteen calls in a row) and of their user's day; two thirds of the users have limits of their own."""
    from pyspark.sql import Window

    events = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e, u = F.col("event_id"), F.col("user_id")
    calls = events.select("event_id", u.alias("collection"), F.floor((n - 1) / 15).alias("run"), F.to_date("ts").alias("day"), F.when(e % 13 != 0, e % 4).alias("amount"), "ts")
    limits = events.select(u.alias("collection")).distinct().where(F.col("collection") % 3 != 1)
    mine = F.col("collection") % 3 == 0
    limits = limits.select("collection", F.when(mine, 12).alias("max_ai_calls_per_run"), F.when(mine, 4).otherwise(5).alias("daily_ai_budget"))
    return ops.within_quotas(calls, limits, ["ts", "event_id"]).select("event_id", "allowed", "refused_by", "used_run", "used_day")


_SCHEDULES = ("*/15 * * * *", "0 3 * * 1-5", "30 4 1,15 * fri", "0 0 29 2 *", "5 4 * * 7", "61 * * * *", "not cron", " ", "10 0 5 8 * *")


@query("""
    WITH n AS (SELECT max(ts) AS now, date_trunc('second', max(ts)) AS now_s FROM events),
    days AS (SELECT CAST(now AS DATE) - CAST(i AS INT) AS day FROM n, range(2930) r(i)), clock AS (SELECT m FROM range(1440) r(m)),
    s AS (SELECT 0 AS no, max(day + to_minutes(m)) AS due FROM days, clock, n WHERE m % 15 = 0 AND day > CAST(now AS DATE) - 2 AND day + to_minutes(m) <= now
        UNION ALL SELECT 1, max(day + INTERVAL 180 MINUTE) FROM days, n WHERE dayofweek(day) BETWEEN 1 AND 5 AND day + INTERVAL 180 MINUTE <= now
        UNION ALL SELECT 2, max(day + INTERVAL 270 MINUTE) FROM days, n WHERE (day(day) IN (1, 15) OR dayofweek(day) = 5) AND day + INTERVAL 270 MINUTE <= now
        UNION ALL SELECT 3, max(day) FROM days WHERE month(day) = 2 AND day(day) = 29
        UNION ALL SELECT 4, max(day + INTERVAL 245 MINUTE) FROM days, n WHERE dayofweek(day) = 0 AND day + INTERVAL 245 MINUTE <= now
        UNION ALL SELECT 8, max(day + to_seconds(5 * 3600 + 10)) FROM days, n WHERE day(day) = 8 AND day + to_seconds(5 * 3600 + 10) <= now),
    c AS (SELECT event_id, event_id % 9 AS no, event_id % 11 AS kind, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS last_run, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 0 END AS errors FROM events)
    SELECT event_id, CASE WHEN kind = 9 THEN 'import_only' WHEN kind = 10 THEN 'unknown_type' WHEN no = 7 THEN 'unscheduled' WHEN no IN (5, 6) THEN 'invalid_schedule' WHEN last_run IS NOT NULL AND NOT (last_run < now_s AND coalesce(due > last_run, false)) THEN 'not_due'
        WHEN errors > 0 AND coalesce(last_run + INTERVAL 240 SECOND > now_s, false) THEN 'backing_off' ELSE 'run' END AS plan FROM c LEFT JOIN s USING (no), n""")
def tick_plan(spark, d):
    """What a tick at the time of the last event does with each event as a connector: seven outcomes."""
    events = table(spark, d, "events")
    e = F.col("event_id")
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    now_s = events.agg(F.max(second)).first()[0] or 0
    kind = F.when(e % 11 == 9, "upload").when(e % 11 == 10, "odd").otherwise("rss")
    schedule = F.element_at(F.array(*map(F.lit, _SCHEDULES)), (e % 9 + 1).cast("int"))
    rows = events.select("event_id", kind.alias("connector_type"), schedule.alias("schedule"), F.when(e % 7 != 0, second).alias("last_run_s"), F.when(e % 5 == 0, 3).otherwise(0).alias("error_count"))
    return timetable.plan_tick(rows, now_s, ("upload",), ("rss",)).select("event_id", "plan")


@query("SELECT event_type AS projection, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS source_at FROM events GROUP BY event_type")
def projection_checkpoint(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("projection"), (F.col("event_id") % 2).alias("half")).agg(F.count("*").alias("n"), F.max("ts").alias("source_at"))
    old, new = (rows.where(f"half = {h}").drop("half") for h in (0, 1))
    return ops.checkpoint_merge(old, new).withColumn("source_at", F.date_format("source_at", "yyyy-MM-dd HH:mm"))


@query("SELECT count(*) AS pending, strftime(min(ts), '%Y-%m-%d %H:%M') AS oldest FROM events WHERE event_id % 10 = 0")
def outbox_pending(spark, d):
    rows = table(spark, d, "events").where("event_id % 10 = 0")
    return rows.agg(F.count("*").alias("pending"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("oldest"))
