"""Cron schedules in column expressions: fields as bit masks, the last time at which one was due, and what a tick does with each connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.addresses import _let as let
from corvane.operators.ops import backoff_seconds

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
#: Days that are searched backwards: over eight years, as 29 February may be so far apart.
DAYS_BACK = 2930


def field_mask(field: Column, low: int, high: int, names: tuple[str, ...] = ()) -> Column:
    """Bits of the values that a field (``*``, numbers, names, ranges, steps, lists) allows; null if it can't be read."""
    text = F.replace(F.lower(field), F.lit("?"), F.lit("*"))
    for i, name in enumerate(names):
        text = F.replace(text, F.lit(name), F.lit(str(i + low)))

    def bits(part: Column) -> Column:
        base, step = F.substring_index(part, "/", 1), F.when(part.contains("/"), F.substring_index(part, "/", -1).try_cast("int")).otherwise(1)
        first = F.when(base == "*", low).otherwise(F.substring_index(base, "-", 1).try_cast("int"))
        last = F.when(base == "*", high).when(base.contains("-"), F.substring_index(base, "-", -1).try_cast("int")).when(part.contains("/"), high).otherwise(first)
        ok = part.rlike(r"^(\*|\d{1,2}(-\d{1,2})?)(/\d{1,2})?$") & (first >= low) & (last <= high) & (first <= last) & (step >= 1)
        each = let(F.struct(first.alias("a"), last.alias("b"), step.alias("s")), lambda x: F.sequence(x["a"], x["b"], x["s"]))
        return F.when(ok, F.aggregate(each, F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v))))

    return F.aggregate(F.split(text, ","), F.lit(0).cast("long"), lambda m, part: m.bitwiseOR(bits(part)))


def cron_masks(schedule: Column) -> Column:
    """The masks of a schedule of five fields, or six with seconds first; null if it can't be read. Sunday is 0 or 7."""

    def masks(f: Column) -> Column:
        at = lambda i: F.get(f, F.size(f) - 5 + i)
        week = let(field_mask(at(4), 0, 7, WEEKDAYS), lambda m: m.bitwiseAND(F.lit(127)).bitwiseOR(F.shiftright(m, 7)))
        found = F.struct(
            F.when(F.size(f) == 6, field_mask(F.get(f, F.lit(0)), 0, 59)).otherwise(F.lit(1).cast("long")).alias("second"), field_mask(at(0), 0, 59).alias("minute"), field_mask(at(1), 0, 23).alias("hour"),
            field_mask(at(2), 1, 31).alias("day"), field_mask(at(3), 1, 12, MONTHS).alias("month"), week.alias("weekday"), at(2).rlike(r"^[*?]").alias("any_day"), at(4).rlike(r"^[*?]").alias("any_weekday"),
        )
        whole = lambda x: F.when(F.forall(F.array(*[x[c] for c in ("second", "minute", "hour", "day", "month", "weekday")]), lambda m: m.isNotNull()), x)
        return F.when(F.size(f).isin(5, 6), let(found, whole))

    return let(F.split(F.trim(F.regexp_replace(schedule, r"\s+", " ")), " "), masks)


def _highest(mask: Column, upto: Column) -> Column:
    """The highest bit of a mask that is no higher than ``upto``; null if there is none."""
    kept = mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), upto + 1) - 1)
    return let(kept, lambda k: F.when(k != 0, F.length(F.bin(k)) - 1))


def _time_upto(m: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds of the day of the latest time that the masks allow up to one; null if there is none."""
    has = lambda mask, n: F.call_function("shiftright", mask, n).bitwiseAND(F.lit(1)) == 1
    top = lambda mask: _highest(mask, F.lit(59))
    same = F.when(has(m["hour"], hour) & has(m["minute"], minute), hour * 3600 + minute * 60 + _highest(m["second"], second))
    earlier_minute = F.when(has(m["hour"], hour), hour * 3600 + _highest(m["minute"], minute - 1) * 60 + top(m["second"]))
    earlier_hour = _highest(m["hour"], hour - 1) * 3600 + top(m["minute"]) * 60 + top(m["second"])
    return F.coalesce(same, earlier_minute, earlier_hour)


def _day_matches(m: Column, day: Column) -> Column:
    has = lambda mask, n: F.call_function("shiftright", m[mask], n).bitwiseAND(F.lit(1)) == 1
    of_month, of_week = has("day", F.dayofmonth(day)), has("weekday", F.dayofweek(day) - 1)
    either = F.when(m["any_day"], of_week).when(m["any_weekday"], of_month).otherwise(of_month | of_week)
    return has("month", F.month(day)) & either


def last_due(masks: Column, now_s: Column) -> Column:
    """Epoch second, in UTC, of the last time up to ``now_s`` at which a schedule was due; null if none was in eight years.

    Where both days of the month and of the week are given, either will do.
    """
    days, rest = F.floor(now_s / 86400).cast("int"), F.pmod(now_s, F.lit(86400)).cast("int")
    today = F.date_from_unix_date(days)
    on_day = _time_upto(masks, F.floor(rest / 3600).cast("int"), F.floor(rest % 3600 / 60).cast("int"), rest % 60)
    here = F.when(_day_matches(masks, today), days.cast("long") * 86400 + on_day)
    back = F.filter(F.sequence(days - 1, days - DAYS_BACK, F.lit(-1)), lambda d: _day_matches(masks, F.date_from_unix_date(d)))
    before = F.get(back, F.lit(0)).cast("long") * 86400 + _time_upto(masks, F.lit(23), F.lit(59), F.lit(59))
    return F.coalesce(here, before)


def due_times(schedules: DataFrame, now_s: int) -> DataFrame:
    """(schedule, readable, due_at) of every distinct schedule: looked up once, however many connectors have it."""
    masks = cron_masks(F.col("schedule"))
    once = schedules.select("schedule").where("schedule IS NOT NULL AND trim(schedule) <> ''").distinct().withColumn("masks", masks)
    return once.select("schedule", F.col("masks").isNotNull().alias("readable"), F.when(F.col("masks").isNotNull(), last_due(F.col("masks"), F.lit(now_s))).alias("due_at"))


def plan_tick(connectors: DataFrame, now_s: int, import_types: tuple[str, ...], known_types: tuple[str, ...], base: int = 60, most: int = 3600) -> DataFrame:
    """``connectors`` (connector_type, schedule, last_run_s, error_count, others) with ``plan`` and, of those that back off, ``until_s``.

    In this order: import_only, unknown_type, unscheduled, invalid_schedule, not_due, backing_off, run. One that has never run is due; else it is
    where the schedule was due after its last run. After errors the next attempt waits for the back-off from the last run.
    """
    due = due_times(connectors, now_s)
    rows = connectors.join(due, "schedule", "left")
    last = F.col("last_run_s")
    is_due = last.isNull() | ((last < now_s) & F.coalesce(F.col("due_at") > last, F.lit(False)))
    until = last + backoff_seconds(F.col("error_count"), base, most)
    waiting = (F.col("error_count") > 0) & F.coalesce(until > now_s, F.lit(False))
    plan = (
        F.when(F.col("connector_type").isin(*import_types), "import_only").when(~F.coalesce(F.col("connector_type").isin(*known_types), F.lit(False)), "unknown_type")
        .when(F.trim(F.coalesce("schedule", F.lit(""))) == "", "unscheduled").when(~F.col("readable"), "invalid_schedule").when(~is_due, "not_due").when(waiting, "backing_off").otherwise("run")
    )
    return rows.select(*[rows[c] for c in connectors.columns], plan.alias("plan"), F.when(plan == "backing_off", until).alias("until_s"))
