"""Operational figures and decisions: backlogs, budgets, health, lag, retries, retention, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialise

# Legal changes of a job's state.
TRANSITIONS = (
    ("queued", "running"), ("queued", "cancelled"), ("running", "completed"), ("running", "failed"), ("running", "retrying"),
    ("running", "cancelled"), ("retrying", "running"), ("retrying", "failed"), ("retrying", "cancelled"),
    ("failed", "retrying"), ("failed", "cancelled"),
)
STUCK_AFTER_S, STALE_AFTER_S = 3600, 86_400
THROTTLE_LAG, PAUSE_LAG = 5000, 50_000
LEVELS = ("normal", "elevated", "high", "critical")


# What a collection may use where nothing else is set.
DEFAULT_BUDGET = {
    "max_candidates_per_run": 200, "max_requests_per_run": 500, "max_ai_calls_per_run": 50, "max_depth": 3,
    "daily_request_budget": 5000, "daily_ai_budget": 500,
}


def with_default_budget(collections: DataFrame) -> DataFrame:
    """``collections`` with all limits of DEFAULT_BUDGET: a collection's own where it has one."""
    own = {c: F.coalesce(F.col(c).cast("long"), F.lit(n).cast("long")) if c in collections.columns else F.lit(n).cast("long") for c, n in DEFAULT_BUDGET.items()}
    return collections.withColumns(own)


def can_transition(before: Column, after: Column) -> Column:
    return F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def saturated_backlog(rows: DataFrame, status_col: str = "status", most: int = 100) -> DataFrame:
    """(status, n, saturated): counts that stop at ``most``."""
    n = F.count("*")
    return rows.groupBy(F.col(status_col).alias("status")).agg(F.least(n, F.lit(most)).alias("n"), (n >= most).alias("saturated"))


def _fold(by: list[str], amount: str, budget: int):
    def run(batches):
        import pyarrow as pa

        group, used = None, 0
        for b in batches:
            totals, passed = [], []
            keys = zip(*[b.column(c).to_pylist() for c in by]) if by else [()] * b.num_rows
            for key, asked in zip(keys, b.column(amount).to_pylist()):
                if key != group:
                    group, used = key, 0
                ok = asked is not None and used + asked <= budget
                used += asked if ok else 0
                totals.append(used)
                passed.append(ok)
            arrays = [*b.columns, pa.array(totals, pa.int64()), pa.array(passed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "used", "allowed"])

    return run


def within_budget(requests: DataFrame, budget: int, by: list[str], order: list[str], amount: str = "amount") -> DataFrame:
    """``requests`` with ``used`` and ``allowed``: in order, each is let through if it still fits the group's budget.

    Only what is let through is used, so a small request after a refused large one may pass, and whether one passes rests on all before it:
    a fold, for which each group's rows are streamed in order through one task, with nothing held but the sum. Amounts are
    whole; a request without one is refused. Columns are not called used or allowed.
    """
    sorted_rows = requests.repartition(*by).sortWithinPartitions(*by, *order) if by else requests.orderBy(*order).coalesce(1)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return sorted_rows.mapInArrow(_fold(by, amount, budget), f"{columns}, used long, allowed boolean")


def _quota_fold(collection: str, run: str, day: str, amount: str, per_run: str, per_day: str):
    def fold(batches):
        import pyarrow as pa

        group, today, used_day, runs = object(), None, 0, {}
        for b in batches:
            out = []
            for key, run_id, date, asked, run_limit, day_limit in zip(*[b.column(c).to_pylist() for c in (collection, run, day, amount, per_run, per_day)]):
                if key is None:  # the system's own calls have no quota
                    out.append((True, None, None, None))
                    continue
                if key != group:
                    group, runs, today = key, {}, None
                if date != today:
                    today, used_day = date, 0
                used_run = runs.get(run_id, 0)
                refused = "no_amount" if asked is None else "run" if run_id is not None and used_run + asked > run_limit else "day" if used_day + asked > day_limit else None
                if refused is None:
                    used_day += asked
                    if run_id is not None:
                        used_run = runs[run_id] = used_run + asked
                out.append((refused is None, refused, used_run if run_id is not None else None, used_day))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "allowed", "refused_by", "used_run", "used_day"])

    return fold


def within_quotas(
    calls: DataFrame, limits: DataFrame, order: list[str], collection: str = "collection", run: str = "run", day: str = "day", amount: str = "amount"
) -> DataFrame:
    """``calls`` with ``allowed``, ``refused_by`` (run, day or no_amount), ``used_run`` and ``used_day``, in order, ``day`` first.

    A call passes if it fits what is left of its run and of its collection's day; only what passes is used, and a call that its run
    refuses uses nothing of the day. ``limits`` has (collection, max_ai_calls_per_run, daily_ai_budget); what it lacks is by default. Calls without an amount
    are refused, those without a run have the day's quota alone, and those without a collection, the system's own, pass. A collection's
    calls stream through one task, which holds a count for each of its runs.
    """
    own = limits.select(F.col(collection).alias("_of"), F.col("max_ai_calls_per_run").cast("long").alias("_per_run"), F.col("daily_ai_budget").cast("long").alias("_per_day"))
    known = calls.join(own, calls[collection] == own["_of"], "left").drop("_of")
    known = known.withColumns({"_per_run": F.coalesce("_per_run", F.lit(DEFAULT_BUDGET["max_ai_calls_per_run"])), "_per_day": F.coalesce("_per_day", F.lit(DEFAULT_BUDGET["daily_ai_budget"]))})
    ranged = known.withColumn("_spread", F.when(F.col(collection).isNull(), F.xxhash64(*calls.columns)))  # the system's calls need not meet
    streamed = ranged.repartition(collection, "_spread").drop("_spread").sortWithinPartitions(collection, day, *order)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streamed.schema)
    folded = streamed.mapInArrow(_quota_fold(collection, run, day, amount, "_per_run", "_per_day"), f"{columns}, allowed boolean, refused_by string, used_run long, used_day long")
    return folded.drop("_per_run", "_per_day")


def daily_usage(rows: DataFrame, day, limit: int = 20) -> DataFrame:
    """Collections with any usage on a day, by calls, then requests, then id."""
    return rows.where((F.col("day") == F.lit(day)) & (F.col("ai_calls") + F.col("requests") > 0)).orderBy(F.desc("ai_calls"), F.desc("requests"), "collection").limit(limit)


def lag_state(lag: Column) -> Column:
    return F.when(lag >= PAUSE_LAG, "pause").when(lag >= THROTTLE_LAG, "throttle").otherwise("normal")


def lag_sleep_factor(lag: Column, threshold: int, most: int = 8) -> Column:
    """By how many rests a consumer slows down: none up to the threshold, then one for each time it is reached, to a bound."""
    return F.when(lag <= threshold, 0).otherwise(F.least(F.greatest(F.floor(lag / max(1, threshold)), F.lit(1)), F.lit(most))).cast("long")


def token_cost(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Cost of a request; prices are for a thousand tokens."""
    return prompt / 1000.0 * prompt_price + completion / 1000.0 * completion_price


def reclaim_orphans(jobs: DataFrame, job_types: tuple[str, ...], now, error: str) -> DataFrame:
    """``jobs`` where those of some types that still run have failed: after a restart nobody works on them."""
    orphan = F.col("job_type").isin(*job_types) & (F.col("status") == "running")
    new = {"status": F.lit("failed"), "completed_at": F.lit(now).cast("timestamp"), "error": F.lit(error)}
    return jobs.withColumns({c: F.when(orphan, v).otherwise(F.col(c)) for c, v in new.items()}) if job_types else jobs


def dispatch_cap(state: Column, most: int) -> Column:
    return F.when(state == "pause", 0).when(state == "throttle", 1).otherwise(max(1, most))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """(topic, lag): by topic, what partitions (high, committed) have not read; never under 0."""
    return offsets.groupBy("topic").agg(F.sum(F.greatest(F.col("high") - F.coalesce("committed", F.lit(0)), F.lit(0))).alias("lag"))


def p95(values: Column) -> Column:
    """Nearest-rank 95th percentile of a group, from the exact counts of its values."""
    return F.element_at(F.sort_array(F.collect_list(values)), F.ceil(F.count(values) * 0.95).cast("int"))


def pressure_level(p95_ms: Column, error_ratio: Column, n: Column, p95_bounds=(2000, 5000, 10_000), ratio_bounds=(0.1, 0.25, 0.5), least: int = 5) -> Column:
    """The highest level whose bound either figure reaches; normal with too few samples."""
    level = F.lit("normal")
    for name, ms, ratio in zip(LEVELS[1:], p95_bounds, ratio_bounds):
        level = F.when((p95_ms >= ms) | (error_ratio >= ratio), name).otherwise(level)
    return F.when(n < least, "normal").otherwise(level)


def admitted(priority: Column, level: Column) -> Column:
    """Requests of priority 0 always pass; under pressure only the more urgent do."""
    worst = F.when(level == "critical", 0).when(level == "high", 1).when(level == "elevated", 3).otherwise(4)
    return (priority == 0) | (priority <= worst)


def backoff_seconds(error_count: Column, base: int = 60, most: int = 3600, jitter_of: Column | None = None) -> Column:
    """base * 2^(n - 1) up to ``most``, moved by up to a tenth either way by an id, so that reruns agree."""
    delay = F.least(base * F.pow(F.lit(2.0), F.least(error_count, F.lit(62)) - 1), F.lit(float(most)))
    if jitter_of is not None:
        delay = F.least(delay * (10_000 + F.pmod(jitter_of, F.lit(2001)) - 1000) / 10_000, F.lit(float(most)))
    return F.when(error_count <= 0, 0.0).otherwise(delay)


def connector_health(now: Column) -> Column:
    """Why a connector is unhealthy (null if it isn't), the reason that says most first.

    Over columns enabled, status, error_count, last_run and last_success.
    """
    age = lambda c: (now.cast("timestamp").cast("long") - F.col(c).cast("timestamp").cast("long"))
    running = F.col("status") == "running"
    return (
        F.when(~F.col("enabled"), None)
        .when(running & (age("last_run") > STUCK_AFTER_S), "stuck")
        .when(running, None)
        .when(F.col("error_count") > 0, "errors")
        .when(F.col("last_run").isNotNull() & F.col("last_success").isNull(), "never_succeeded")
        .when(age("last_success") > STALE_AFTER_S, "stale")
    )


def fair_dispatch(due: DataFrame, most_failing: int = 8) -> DataFrame:
    """``due`` in fair order (``turn``), with at most so many failing ones, and as many whose errors aren't known.

    Turns are numbered by shares of the order and prefix sums of their sizes, so no task holds all.
    """
    order = [F.col("error_count"), F.col("last_success").desc_nulls_last(), F.col("id")]
    kept = due.where("error_count <= 0")
    for some in ("error_count > 0", "error_count IS NULL"):
        kept = kept.unionByName(due.where(some).orderBy(*order).limit(most_failing))
    # written before it is numbered, so that a share is what it was when it was counted
    dealt = materialise(kept.repartitionByRange(*order).withColumn("share", F.spark_partition_id()), "turns")
    ahead = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("share").count().select("share", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("share").orderBy(*order))
    numbered = dealt.withColumn("own", own).join(F.broadcast(bases), "share")
    return numbered.withColumn("turn", (F.col("base") + F.col("own")).cast("int")).drop("share", "own", "base")


def purgeable_counts(jobs: DataFrame, statuses: tuple[str, ...], before) -> DataFrame:
    """(job_type, status, n, oldest): finished jobs of before a time, by type and status: what a purge would take in all."""
    old = jobs.where(F.col("status").isin(*statuses) & (F.col("finished_at") < F.lit(before)))
    return old.groupBy("job_type", "status").agg(F.count("*").alias("n"), F.min("finished_at").alias("oldest"))


def purgeable(jobs: DataFrame, job_type: str, statuses: tuple[str, ...], before, limit: int = 5000) -> DataFrame:
    """The oldest jobs of a type and of some states that ended before a time."""
    return jobs.where((F.col("job_type") == job_type) & F.col("status").isin(*statuses) & (F.col("finished_at") < F.lit(before))).orderBy("finished_at", "job_id").limit(limit)


def survivors(candidates: DataFrame) -> DataFrame:
    """(candidate_id, survivor): of candidates with one natural key the decided one before the pending, then the oldest."""
    order = Window.partitionBy("collection", "candidate_type", "value_key").orderBy((F.col("status") == "pending").cast("int"), "created_at", "candidate_id")
    return candidates.select("candidate_id", F.first("candidate_id").over(order).alias("survivor"))


def checkpoint_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(projection, n, source_at): counts add up, the source's time never goes back."""
    return old.unionByName(new).groupBy("projection").agg(F.sum("n").alias("n"), F.max("source_at").alias("source_at"))
