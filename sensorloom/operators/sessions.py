"""Operators over the ordered status sequence of a device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import wall_seconds
from sensorloom.operators.ordered import (
    HOT_ROWS,
    GroupSizes,
    OrderedGroups,
    by_size,
    measure_groups,
)

DEVICE_DAY = ("date", "deviceid")
DAY_SECONDS = 86_400
# Supply voltage while a device runs, and watt seconds per kilowatt hour.
VOLTAGE = 10_000
WATT_SECONDS = 1_000 * 3_600


def round_cents(amount: Column) -> Column:
    """Two decimals, decided by the stored binary value: 1.005 is slightly less and gives 1.0.

    round(amount, 2) would decide by the shortest decimal text instead.
    """
    return F.round(amount * 100) / 100


def energy(avg_current: Column, runtime: Column) -> Column:
    """Kilowatt hours, to two decimals, of a mean current over some seconds."""
    return round_cents(VOLTAGE * avg_current * runtime / WATT_SECONDS)


def restart_count(
    readings: DataFrame,
    status_sensor: str,
    keys: Sequence[str] = DEVICE_DAY,
    open_start: bool = False,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Restarts and time between recorded transitions, per group.

    Going from 0 to a positive state records that row's time, going from a positive state to 0 the
    time of the row before. Recorded times are paired in order and the gaps of the pairs are added;
    an unpaired last time counts up to the next midnight and as one more restart. Without any
    transition the time is a whole day if the last state is positive, else 0.

    If a group starts in a positive state its first recorded time is a stop, and the pairs then
    measure the idle time. ``open_start`` records the first row's time in that case.

    Counts the status rows per group at call unless the ``sizes`` of the groups are given.
    """
    keys = list(keys)
    status = readings.filter(F.col("sensor") == status_sensor).select(
        *dict.fromkeys([*keys, "local_ts", "seq", "measure"])
    )
    before, now = F.col("_before"), F.col("measure")
    started = (before == 0) & (now > 0)
    if open_start:
        started = started | (before.isNull() & (now > 0))
    recorded = F.when(started, wall_seconds(F.col("local_ts"))).when(
        (before > 0) & (now == 0), wall_seconds(F.col("_before_ts"))
    )
    # The index counts from 0: openings of a pair are even, closings odd.
    signed = F.when(F.col("_index") % 2 == 0, -F.col("_time")).otherwise(F.col("_time"))

    def summarise(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        numbered = (
            OrderedGroups.of(part, keys, ["local_ts", "seq"], hot)
            .previous_row(_before="measure", _before_ts="local_ts")
            .map(lambda rows: rows.withColumn("_time", recorded))
            .running_total(F.col("_time").isNotNull().cast("long"), "_index")
        )
        return numbered.rows.groupBy(*keys).agg(
            F.count("_time").alias("_times"),
            F.sum(signed).alias("_paired"),
            F.max("_time").alias("_last_time"),
            F.max_by("measure", F.struct("local_ts", "seq")).alias("_last_state"),
            F.max("local_ts").cast("date").alias("_last_day"),
        )

    summary = by_size(status, keys, sizes or measure_groups(status, keys, hot_rows), summarise)
    times = F.col("_times")
    midnight = (F.floor(F.col("_last_time") / DAY_SECONDS) + 1) * DAY_SECONDS
    spent = (
        F.when(times == 0, F.when(F.col("_last_state") > 0, DAY_SECONDS).otherwise(0))
        .when(times % 2 == 0, F.col("_paired"))
        .otherwise(F.col("_paired") + midnight)
    )
    result = summary.withColumns(
        {
            "date": F.col("_last_day"),
            "restart_count": F.ceil(times / 2).cast("long"),
            "spendtime": spent.cast("long"),
        }
    )
    return result.select(*dict.fromkeys(["date", *keys, "restart_count", "spendtime"]))


def _runs(status: DataFrame, keys: list[str], hot: GroupSizes | None) -> DataFrame:
    """One row per run: it starts at the first row with a state other than 0 and stops at the next
    row with state 0, or at the group's last row when there is none."""
    running = F.col("measure") != 0
    starts = running & ~F.coalesce(F.col("_before") != 0, F.lit(False))
    rows = (
        OrderedGroups.of(status, keys, ["ts", "seq"], hot)
        .previous_row(_before="measure")
        .map(lambda rows: rows.withColumn("_starts", starts.cast("long")))
        .running_total(F.col("_starts"), "_earlier_runs")
        .rows.withColumn("run", F.col("_earlier_runs") + F.col("_starts"))
    )
    stopped = F.min(F.when(~running, F.col("ts")))
    return (
        rows.filter("run > 0")
        .groupBy(*keys, "run")
        .agg(
            F.min("ts").alias("starttime"),
            F.coalesce(stopped, F.max("ts")).alias("stoptime"),
            stopped.isNotNull().alias("closed"),
        )
    )


# Order of events that fall on the same time.
START, CURRENT, STOP = 0, 1, 2

EVENT_FIELDS = {
    "run": "long",
    "open_run": "long",
    "open_until": "timestamp_ntz",
    "point_ts": "timestamp_ntz",
    "amount": "double",
    "number": "long",
    "starttime": "timestamp_ntz",
    "closed": "boolean",
}


def _with_mean_current(
    runs: DataFrame, current: DataFrame, keys: list[str], hot: GroupSizes | None
) -> DataFrame:
    """Add the mean current measured from start to stop, both ends included.

    Runs of a group follow one another, so a current reading belongs to the latest run started, if
    that has not stopped. Only where a run stops at the very time a later one starts do readings of
    that time belong to both; the stop event of the earlier run picks them up. One sorted pass over
    starts, readings and stops therefore replaces a join on overlapping times.
    """

    def event(time: str, kind: int, **fields: str) -> Column:
        """Every kind of event has all columns, and fills those that belong to it."""
        filled = (
            (F.col(fields[name]) if name in fields else F.lit(None)).cast(data_type).alias(name)
            for name, data_type in EVENT_FIELDS.items()
        )
        return F.struct(F.col(time).alias("ts"), F.lit(kind).alias("kind"), *filled)

    start = event("starttime", START, run="run", open_run="run", open_until="stoptime")
    stop = event("stoptime", STOP, run="run", starttime="starttime", closed="closed")
    point = event("ts", CURRENT, point_ts="ts", amount="_amount", number="_number")
    points = current.groupBy(*keys, "ts").agg(
        F.coalesce(F.sum("measure"), F.lit(0.0)).alias("_amount"),
        F.count("measure").alias("_number"),
    )
    events = runs.select(*keys, F.inline(F.array(start, stop))).unionByName(
        points.select(*keys, point.alias("_event")).select(*keys, "_event.*")
    )
    seen = (
        OrderedGroups.of(events, keys, ["ts", "kind", "run"], hot)
        .last_seen(
            _run="open_run", _until="open_until", _at="point_ts", _amount="amount", _number="number"
        )
        .rows
    )
    is_stop = F.col("kind") == STOP
    inside = (F.col("kind") == CURRENT) & (F.col("ts") <= F.col("_until"))
    touching = is_stop & (F.col("_run") != F.col("run")) & (F.col("_at") == F.col("ts"))
    counted = inside | touching
    credits = seen.filter(inside | is_stop).select(
        *keys,
        F.coalesce("run", "_run").alias("run"),
        "starttime",
        F.when(is_stop, F.col("ts")).alias("stoptime"),
        "closed",
        F.when(counted, F.col("_amount")).alias("amount"),
        F.when(counted, F.col("_number")).alias("number"),
    )
    return (
        credits.groupBy(*keys, "run")
        .agg(
            F.max("starttime").alias("starttime"),
            F.max("stoptime").alias("stoptime"),
            F.max("closed").alias("closed"),
            F.try_divide(F.sum("amount"), F.sum("number")).alias("avg_current"),
        )
    )


def run_sessions(
    readings: DataFrame,
    status_sensor: str,
    current_sensor: str,
    keys: Sequence[str] = DEVICE_DAY,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Run sessions with runtime in seconds, mean current and energy; one row per session.

    ``closed`` tells a session that ended with a stopped state from one that was still running at the
    group's last status row. Without current readings the energy is NULL. Counts the rows of both sensors per group
    at call unless the ``sizes`` of the groups are given.
    """
    keys = list(keys)
    used = readings.filter(F.col("sensor").isin(status_sensor, current_sensor)).select(
        *dict.fromkeys([*keys, "sensor", "ts", "seq", "measure"])
    )

    def work(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        status = part.filter(F.col("sensor") == status_sensor).drop("sensor")
        current = part.filter(F.col("sensor") == current_sensor).drop("sensor", "seq")
        return _with_mean_current(_runs(status, keys, hot), current, keys, hot)

    runs = by_size(used, keys, sizes or measure_groups(used, keys, hot_rows), work)
    runtime = wall_seconds(F.col("stoptime")) - wall_seconds(F.col("starttime"))
    return runs.withColumn("runtime", runtime).select(
        *keys,
        "run",
        "starttime",
        "stoptime",
        "runtime",
        "closed",
        "avg_current",
        energy(F.col("avg_current"), F.col("runtime")).alias("kwh"),
    )


def device_statistics(
    sessions: DataFrame, devices: DataFrame, keys: Sequence[str] = DEVICE_DAY
) -> DataFrame:
    """Stops, runtime and energy per group; zeros for groups of ``devices`` that never ran.

    Zero rows are appended before one partial aggregation, so no join is needed.
    """
    ran = sessions.select(*keys, F.col("closed").cast("long").alias("stop"), "runtime", "kwh")
    idle = devices.select(*keys).distinct().select(
        *keys,
        F.lit(0).cast("long").alias("stop"),
        F.lit(0).cast("long").alias("runtime"),
        F.lit(0.0).alias("kwh"),
    )
    return (
        ran.unionByName(idle)
        .groupBy(*keys)
        .agg(
            F.sum("stop").alias("restart_count"),
            F.sum("runtime").alias("total_runtime"),
            round_cents(F.sum("kwh")).alias("total_kwh"),
        )
    )


def device_status(
    sessions: DataFrame,
    readings: DataFrame,
    status_sensor: str,
    keys: Sequence[str] = DEVICE_DAY,
) -> DataFrame:
    """Sessions as status rows, and one row without times and 0 energy per group that never ran."""
    running = (F.col("sensor") == status_sensor) & (F.col("measure") != 0)
    idle = readings.groupBy(*keys).agg(F.bool_or(running).alias("_ran")).filter(~F.col("_ran"))
    no_time = F.lit(None).cast("timestamp_ntz")
    return sessions.select(*keys, "starttime", "stoptime", "kwh").unionByName(
        idle.select(
            *keys, no_time.alias("starttime"), no_time.alias("stoptime"), F.lit(0.0).alias("kwh")
        )
    )
