"""

The queries run over the ``events`` table as sensor readings: the user is the device, the event type
the sensor, the value the measure. ``click`` serves as the status sensor, where values under 20 count
as stopped, and ``view`` as the current sensor.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators import limits, relations, sessions, stats
from sensorloom.plans import daily
from sensorloom.session import scratch_path, stored
from sensorloom.sinks import tables
from sensorloom.sources import readings as source

Query = Callable[[SparkSession, str], DataFrame]

SENSORS = ["click", "error", "purchase", "signup", "view"]
LISTED = ["click", "purchase", "view"]
STATUS, CURRENT = "click", "view"
DAY = "2024-01-10"
DEVICE = ("deviceid",)
SENSOR = ("sensor",)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.readings_from_columns(
        _events(spark, sf_dir), "user_id", "event_type", "value", "ts", "event_id"
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose status sensor has stopped states."""
    stopped = (F.col("sensor") == STATUS) & (F.col("measure") < 20)
    return _readings(spark, sf_dir).withColumn(
        "measure", F.when(stopped, 0.0).otherwise(F.col("measure"))
    )


def _raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the text fields of a readings file. Errors carry no number and sign-ups no time."""
    kind = F.col("event_type")
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("deviceid"),
        kind.alias("sensor"),
        F.when(kind == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("measure"),
        F.when(kind == "signup", F.lit("unknown"))
        .otherwise(F.concat(F.translate(F.col("ts").cast("string"), " ", "T"), F.lit("Z")))
        .alias("timestamp"),
        F.col("event_id").alias("seq"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means and correlations to six decimals: engines add up doubles in different orders."""
    return df.withColumns({name: F.round(name, 6) for name in columns})


def _over_readings(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_readings(spark, sf_dir))


def _over_states(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_states(spark, sf_dir))


def _restarts(keys: tuple[str, ...], open_start: bool = False) -> Query:
    return _over_states(lambda r: sessions.restart_count(r, STATUS, keys, open_start))


def _sessions(r: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sessions with the energy of a mean current cut to nine decimals: engines add up doubles in different
    orders, which must not turn the rounding of the energy."""
    found = sessions.run_sessions(r, STATUS, CURRENT, keys)
    mean = F.round("avg_current", 9)
    return found.withColumns({"avg_current": mean, "kwh": sessions.energy(mean, F.col("runtime"))})


def _session_rows(keys: tuple[str, ...]) -> Query:
    return _over_states(lambda r: _rounded(_sessions(r, keys), "avg_current"))


def _statistics(keys: tuple[str, ...]) -> Query:
    return _over_states(lambda r: sessions.device_statistics(_sessions(r, keys), r, keys))


def _status_rows(r: DataFrame) -> DataFrame:
    return sessions.device_status(_sessions(r, DEVICE), r, STATUS, DEVICE)


def _parsed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = source.accepted(source.parse_readings(_raw_fields(spark, sf_dir)))
    return parsed.select("seq", "deviceid", "sensor", "measure", "ts", "date", "hour")


def _rejected_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.rejected(_raw_fields(spark, sf_dir)).select("seq", "deviceid", "sensor")


def _csv_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as readings files, read back and counted."""
    path = scratch_path(spark, "readings")
    _raw_fields(spark, sf_dir).drop("seq").write.csv(path, header=True, quote="")
    return _rounded(stats.daily_stats(source.read_readings(spark, path)), "avg")


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _events(spark, sf_dir).select(
        F.col("user_id").alias("deviceid"),
        F.col("props").alias("topic"),
        F.col("event_type").alias("sensor"),
        F.col("value").alias("measure"),
        F.col("ts").alias("timestamp"),
    )
    start, end = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 30)
    return source.ingest_documents(documents, start, end, ["error"])


def _device_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device-day slices written, read back and counted."""
    path = scratch_path(spark, "device-days")
    tables.write_device_days(_readings(spark, sf_dir), path)
    return (
        tables.read_device_days(spark, path)
        .groupBy("date", "deviceid")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def _sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, the second without the rows that are there already."""
    path, table = scratch_path(spark, "results"), "limo_max_min"
    result = stats.daily_stats(_readings(spark, sf_dir))
    tables.write_result(stats.only_sensors(result, LISTED), table, path)
    written = tables.read_result(spark, table, path)
    tables.write_result(tables.without_existing(result, written, table), table, path)
    return _rounded(tables.read_result(spark, table, path), "avg")


def _written_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a second, unchecked append of some rows would repeat."""
    counts = stats.sensor_count(_readings(spark, sf_dir))
    again = counts.filter(F.col("count") > 2)
    return tables.duplicate_keys(counts.unionByName(again), "sensor_count")


def _apart(r: DataFrame) -> DataFrame:
    """Readings in three groups of days, much farther from each other than the readings of a day."""
    return r.withColumn("measure", F.col("measure") + (F.dayofmonth("date") % 3) * 100_000)


def _clusters(r: DataFrame) -> DataFrame:
    """Centres and sizes without the cluster numbers, which mean nothing."""
    found = relations.kmeans_clusters(_apart(r), LISTED, keys=("date",))
    return _rounded(found.drop("clusterid"), "sensor1", "sensor2", "sensor3")


def _cluster_sizes(r: DataFrame) -> DataFrame:
    return relations.kmeans_clusters(_apart(r), LISTED, keys=("date",)).select("cluster_num")


def _clusters_of_days(r: DataFrame) -> DataFrame:
    """Clusters of every date, whose aligned readings are moved apart by their position."""
    place = F.row_number().over(Window.partitionBy("date", "sensor").orderBy("ts", "seq")) - 1
    apart = r.withColumn("measure", F.col("measure") + place % 3 * 100_000)
    found = relations.kmeans_by_date(apart, LISTED)
    return _rounded(found.drop("clusterid"), "sensor1", "sensor2", "sensor3")


def _day_report(name: str) -> Query:
    """One day's report from the device-day layout of all events."""

    def report(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "device-days")
        tables.write_device_days(_readings(spark, sf_dir), path)
        return _rounded(daily.compute(spark, name, path, DAY, "parquet"), "avg")

    return report


def _rerun_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device-day layout written twice: the second run replaces the days."""
    path, r = scratch_path(spark, "device-days"), _readings(spark, sf_dir)
    tables.write_device_days(r, path)
    tables.write_device_days(r, path)
    return tables.read_device_days(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def _rerun_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outliers of all days, then those of the first half of a month again in place of their days."""
    path, table = scratch_path(spark, "results"), "sensor_outliers"
    found = limits.outliers(_readings(spark, sf_dir))
    tables.replace_days(found, table, path)
    tables.replace_days(found.filter(F.dayofmonth("date") <= 15), table, path)
    return tables.read_result(spark, table, path)


def _rerun_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outliers of all days, then those of one day again after a correction that leaves it none."""
    path, table, r = scratch_path(spark, "results"), "sensor_outliers", _readings(spark, sf_dir)
    tables.replace_days(limits.outliers(r), table, path)
    corrected = r.filter(F.col("date") == F.lit(DAY).cast("date")).withColumn("measure", F.lit(1.0))
    tables.replace_days(limits.outliers(corrected), table, path, days=[DAY])
    return tables.read_result(spark, table, path)


def _read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines accepted and rejected, counted by the scan that computes the daily totals."""
    path, counts = scratch_path(spark, "readings"), Observation()
    _raw_fields(spark, sf_dir).drop("seq").write.csv(path, header=True, quote="")
    totals = stored(stats.daily_total(source.read_readings(spark, path, counts=counts), "LiMo"), "totals")
    lines, rejected = counts.get["lines"], counts.get["rejected"]
    return totals.select(
        "date", "count", F.lit(lines - rejected).cast("long").alias("accepted"), F.lit(rejected).cast("long").alias("rejected")
    )


# The reports of a day with the sensors of the events.
DAY_REPORTS = {
    "sensor-count": daily.Report("sensor_count", lambda r, sizes: stats.sensor_count(r), LISTED),
    "top-value": daily.Report(
        "sensor_top_value", lambda r, sizes: limits.top_value(r, sizes=sizes), LISTED, 2, daily.BY_GROUP
    ),
    "boxplot": daily.Report(
        "sensor_boxplot", lambda r, sizes: limits.boxplot(r, sizes=sizes), None, 2, daily.BY_SENSOR
    ),
    "outliers": daily.Report(
        "sensor_outliers", lambda r, sizes: limits.outliers(r, sizes=sizes), None, 2, daily.BY_SENSOR
    ),
    "restarts": daily.Report(
        "sensor_restart_count",
        lambda r, sizes: sessions.restart_count(r, STATUS, sizes=sizes),
        [STATUS], 2, sessions.DEVICE_DAY,
    ),
}


def _day_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several reports of a day from one parse and one count of its groups, as rows of one table."""
    path = scratch_path(spark, "readings")
    raw = _raw_fields(spark, sf_dir).drop("seq")
    raw.write.csv(path, header=True, quote="")
    results = daily.compute_day(spark, list(DAY_REPORTS), path, DAY, reports=DAY_REPORTS)
    values = {"sensor-count": "count", "top-value": "topvalue", "boxplot": "upper", "outliers": "measure", "restarts": "spendtime"}

    def shown(name: str, result: DataFrame) -> DataFrame:
        keys = (
            (F.col(key) if key in result.columns else F.lit(None)).cast("string").alias(key)
            for key in ("date", "deviceid", "sensor")
        )
        value = F.round(F.col(values[name]).cast("double"), 6).alias("value")
        return result.select(F.lit(name).alias("report"), *keys, value)

    return reduce(DataFrame.unionByName, (shown(name, result) for name, result in results.items()))


def _empty_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all days, and an append of nothing."""
    path, table = scratch_path(spark, "results"), "sensor_data_count"
    totals = stats.daily_total(_readings(spark, sf_dir), "LiMo")
    tables.write_result(totals, table, path)
    tables.write_result(totals.filter("count < 0"), table, path)
    return tables.read_result(spark, table, path)


READINGS_SQL = """
WITH readings AS (
  SELECT user_id AS deviceid, event_type AS sensor, value AS measure, ts, event_id AS seq,
         ts + INTERVAL 8 HOUR AS local_ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date,
         CAST(hour(ts + INTERVAL 8 HOUR) AS INTEGER) AS hour
  FROM events)"""

STATES_SQL = (
    READINGS_SQL
    + """,
states AS (
  SELECT * REPLACE (CASE WHEN sensor = 'click' AND measure < 20 THEN 0.0 ELSE measure END
                    AS measure)
  FROM readings)"""
)

RAW_SQL = """
WITH raw AS (
  SELECT CAST(user_id AS VARCHAR) AS deviceid, event_type AS sensor,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS measure,
         date_trunc('second', ts) AS ts, event_id AS seq
  FROM events)"""


# Raw fields as readings, without the rows that have no time.
ACCEPTED_SQL = (
    RAW_SQL
    + """,
readings AS (
  SELECT deviceid, sensor, measure, ts, seq, ts + INTERVAL 8 HOUR AS local_ts,
         CAST(ts + INTERVAL 8 HOUR AS DATE) AS date
  FROM raw WHERE sensor <> 'signup')"""
)


def _day_plan_sql() -> str:
    """The reports of one day over the accepted rows; times are whole seconds, rows of a second follow the file."""
    top = "CAST(floor(count(*) OVER g * CAST(0.001 AS DOUBLE)) AS BIGINT)"
    return f"""{ACCEPTED_SQL},
day AS (SELECT * FROM readings WHERE date = DATE '{DAY}'),
ranked AS (
  SELECT date, deviceid, sensor, measure, row_number() OVER (g ORDER BY measure DESC) AS place, {top} AS skipped
  FROM day WHERE sensor IN ({_listed_sql(LISTED)}) WINDOW g AS (PARTITION BY date, deviceid, sensor)),
fences AS (
  SELECT date, sensor, quantile_disc(measure, 0.75) + 1.5 * (quantile_disc(measure, 0.75) - quantile_disc(measure, 0.25)) AS upper
  FROM day GROUP BY date, sensor),
steps AS (
  SELECT *, lag(measure) OVER w AS before, lag(local_ts) OVER w AS before_ts
  FROM day WHERE sensor = '{STATUS}' WINDOW w AS (PARTITION BY date, deviceid ORDER BY ts, seq)),
times AS (
  SELECT *, CASE WHEN before = 0 AND measure > 0 THEN local_ts WHEN before > 0 AND measure = 0 THEN before_ts END AS t FROM steps),
restarts AS (
  SELECT date, deviceid, count(t) AS k, arg_max(measure, (ts, seq)) AS last_state,
         sum(CASE WHEN i % 2 = 0 THEN epoch(t) ELSE -epoch(t) END) AS paired, epoch(CAST(max(t) AS DATE) + INTERVAL 1 DAY) AS midnight
  FROM (SELECT *, count(t) OVER (PARTITION BY date, deviceid ORDER BY ts, seq) AS i FROM times) GROUP BY date, deviceid),
shown AS (
  SELECT 'sensor-count' AS report, date, deviceid, sensor, CAST(count(*) AS DOUBLE) AS value
  FROM day WHERE sensor IN ({_listed_sql(LISTED)}) GROUP BY ALL
  UNION ALL SELECT 'top-value', date, deviceid, sensor, measure FROM ranked WHERE place = skipped + 1
  UNION ALL SELECT 'boxplot', date, NULL, sensor, upper FROM fences
  UNION ALL SELECT 'outliers', date, NULL, sensor, measure FROM day JOIN fences USING (date, sensor) WHERE measure > upper
  UNION ALL SELECT 'restarts', date, deviceid, NULL,
         CASE WHEN k = 0 THEN CASE WHEN last_state > 0 THEN 86400 ELSE 0 END WHEN k % 2 = 0 THEN paired ELSE paired + midnight END
  FROM restarts)
SELECT report, CAST(date AS VARCHAR) AS date, deviceid, sensor, round(value, 6) AS value FROM shown"""


def _listed_sql(names: list[str]) -> str:
    return ", ".join(f"'{name}'" for name in names)


def _extremes_sql(keys: str) -> str:
    return f"""{READINGS_SQL}
SELECT {keys}, max(measure) AS max, min(measure) AS min, round(avg(measure), 6) AS avg
FROM readings GROUP BY {keys}"""


def _quartile_sql(keys: str) -> str:
    return f"""{READINGS_SQL},
quartiles AS (
  SELECT {keys}, quantile_disc(measure, 0.25) AS q1, quantile_disc(measure, 0.5) AS median,
         quantile_disc(measure, 0.75) AS q3, count(*) AS count
  FROM readings GROUP BY {keys}),
fences AS (
  SELECT {keys}, q1 - 1.5 * (q3 - q1) AS lower, q1, median, q3, q3 + 1.5 * (q3 - q1) AS upper
  FROM quartiles)"""


def _top_sql(keys: str, fraction: float) -> str:
    return f"""{READINGS_SQL},
ranked AS (
  SELECT {keys}, measure, count(*) OVER (PARTITION BY {keys}) AS n,
         row_number() OVER (PARTITION BY {keys} ORDER BY measure DESC) AS place
  FROM readings),
tops AS (
  SELECT {keys}, measure AS topvalue, n AS count FROM ranked
  WHERE place = CAST(floor(n * CAST({fraction} AS DOUBLE)) AS BIGINT) + 1)"""


def _exceed_sql(keys: str, fraction: float) -> str:
    return f"""{_top_sql(keys, fraction)}
SELECT {keys}, hour, count(*) AS count
FROM readings JOIN tops USING ({keys}) WHERE measure > topvalue GROUP BY {keys}, hour"""


def _restart_sql(keys: str, open_start: bool = False) -> str:
    opening = "WHEN before IS NULL AND measure > 0 THEN local_ts" if open_start else ""
    return f"""{STATES_SQL},
steps AS (
  SELECT *, lag(measure) OVER w AS before, lag(local_ts) OVER w AS before_ts
  FROM states WHERE sensor = 'click' WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)),
times AS (
  SELECT *, date_trunc('second', CASE {opening}
                 WHEN before = 0 AND measure > 0 THEN local_ts
                 WHEN before > 0 AND measure = 0 THEN before_ts END) AS t
  FROM steps),
numbered AS (
  SELECT {keys}, t, row_number() OVER (PARTITION BY {keys} ORDER BY ts, seq) AS i
  FROM times WHERE t IS NOT NULL),
paired AS (
  SELECT {keys}, count(*) AS k, CAST(max(t) AS DATE) + INTERVAL 1 DAY AS midnight,
         sum(CASE WHEN i % 2 = 0 THEN epoch(t) ELSE -epoch(t) END) AS paired
  FROM numbered GROUP BY {keys}),
groups AS (
  SELECT {keys}, arg_max(measure, (ts, seq)) AS last_state, CAST(max(local_ts) AS DATE) AS last_day
  FROM states WHERE sensor = 'click' GROUP BY {keys})
SELECT last_day AS date, deviceid, CAST(ceil(coalesce(k, 0) / 2) AS BIGINT) AS restart_count,
       CAST(CASE WHEN k IS NULL THEN CASE WHEN last_state > 0 THEN 86400 ELSE 0 END
                 WHEN k % 2 = 0 THEN paired
                 ELSE paired + epoch(midnight) END AS BIGINT) AS spendtime
FROM groups LEFT JOIN paired USING ({keys})"""


def _sessions_sql(keys: str) -> str:
    same = " AND ".join(f"c.{key.strip()} = runs.{key.strip()}" for key in keys.split(","))
    run_keys = ", ".join(f"runs.{key.strip()}" for key in keys.split(","))
    return f"""{STATES_SQL},
flagged AS (
  SELECT *, CASE WHEN measure <> 0 AND coalesce(lag(measure) OVER w, 0) = 0 THEN 1 ELSE 0 END AS f
  FROM states WHERE sensor = 'click' WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)),
counted AS (
  SELECT *, CAST(sum(f) OVER (PARTITION BY {keys} ORDER BY ts, seq
                              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM flagged),
runs AS (
  SELECT {keys}, run, min(ts) AS starttime,
         coalesce(min(CASE WHEN measure = 0 THEN ts END), max(ts)) AS stoptime,
         bool_or(measure = 0) AS closed
  FROM counted WHERE run > 0 GROUP BY {keys}, run),
sessions AS (
  SELECT {run_keys}, run, starttime, stoptime,
         CAST(epoch(date_trunc('second', stoptime)) - epoch(date_trunc('second', starttime))
              AS BIGINT) AS runtime,
         closed, round(avg(c.measure), 9) AS current
  FROM runs LEFT JOIN states c
    ON c.sensor = 'view' AND {same} AND c.ts BETWEEN starttime AND stoptime
  GROUP BY {run_keys}, run, starttime, stoptime, closed),
energy AS (
  SELECT {keys}, run, starttime, stoptime, runtime, closed, round(current, 6) AS avg_current,
         round(10000 * current * runtime / 3600000, 2) AS kwh
  FROM sessions)"""


def _statistics_sql(keys: str) -> str:
    return f"""{_sessions_sql(keys)}
SELECT {keys}, CAST(count(*) FILTER (closed) AS BIGINT) AS restart_count,
       CAST(coalesce(sum(runtime), 0) AS BIGINT) AS total_runtime,
       round(coalesce(sum(kwh), 0), 2) AS total_kwh
FROM (SELECT DISTINCT {keys} FROM readings) LEFT JOIN energy USING ({keys}) GROUP BY {keys}"""


def _aligned_sql(sensors: list[str], keys: str) -> str:
    """Aligned readings as view ``aligned``, one column per sensor."""
    columns = ", ".join(
        f"max(CASE WHEN sensor = '{name}' THEN measure END) AS {name}" for name in sensors
    )
    return f"""{READINGS_SQL},
grouped AS (SELECT *, 0 AS everything FROM readings WHERE sensor IN ({_listed_sql(sensors)})),
lengths AS (
  SELECT {keys}, min(n) AS shortest
  FROM (SELECT {keys}, sensor, count(*) AS n FROM grouped GROUP BY {keys}, sensor)
  GROUP BY {keys} HAVING count(*) = {len(sensors)}),
numbered AS (
  SELECT {keys}, sensor, measure,
         row_number() OVER (PARTITION BY {keys}, sensor ORDER BY ts, seq) AS place
  FROM grouped),
aligned AS (
  SELECT {keys}, place, {columns}
  FROM numbered JOIN lengths USING ({keys}) WHERE place < shortest GROUP BY {keys}, place)"""


def _corr_sql(a: str, b: str) -> str:
    return f"""CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0
            THEN round(corr({a}, {b}), 6) END"""


def _pearson_sql(keys: str, shown: str) -> str:
    return f"""{_aligned_sql(['click', 'view'], keys)}
SELECT {shown} {_corr_sql('click', 'view')} AS corr, count(*) AS pairs
FROM aligned GROUP BY {keys}"""


def _spearman_sql(keys: str, shown: str) -> str:
    def rank(name: str) -> str:
        return f"""rank() OVER (PARTITION BY {keys} ORDER BY {name})
         + (count(*) OVER (PARTITION BY {keys}, {name}) - 1) / 2.0 AS r_{name}"""

    return f"""{_aligned_sql(['click', 'view'], keys)},
ranks AS (SELECT {keys}, {rank('click')}, {rank('view')} FROM aligned)
SELECT {shown} {_corr_sql('r_click', 'r_view')} AS corr, count(*) AS pairs
FROM ranks GROUP BY {keys}"""


def _matrix_sql() -> str:
    pairs = "\nUNION ALL ".join(
        f"""SELECT date, '{a}' AS sensor_a, '{b}' AS sensor_b,
       {'CAST(1 AS DOUBLE)' if a == b else _corr_sql(a, b)} AS corr FROM aligned GROUP BY date"""
        for a in SENSORS
        for b in SENSORS
    )
    return f"{_aligned_sql(SENSORS, 'date')}\n{pairs}"


def _wide_matrix_sql() -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT date, '{a}' AS sensor, "
        + ", ".join(f"{'CAST(1 AS DOUBLE)' if a == b else _corr_sql(a, b)} AS {b}" for b in SENSORS)
        + " FROM aligned GROUP BY date"
        for a in SENSORS
    )
    return f"{_aligned_sql(SENSORS, 'date')}\n{rows}"


COUNT_SQL = f"""{READINGS_SQL}
SELECT date, deviceid, sensor, count(*) AS count FROM readings"""

# Every registered query with its SQL counterpart, or None where SQL cannot express it.
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "daily_stats": (
        _over_readings(lambda r: _rounded(stats.daily_stats(r), "avg")),
        _extremes_sql("date, deviceid, sensor"),
    ),
    "hourly_stats": (
        _over_readings(lambda r: _rounded(stats.hourly_stats(r), "avg")),
        _extremes_sql("date, hour, deviceid, sensor"),
    ),
    "sensor_count": (
        _over_readings(lambda r: stats.sensor_count(r, LISTED)),
        f"{COUNT_SQL} WHERE sensor IN ({_listed_sql(LISTED)}) GROUP BY date, deviceid, sensor",
    ),
    "sensor_count_all": (
        _over_readings(stats.sensor_count),
        f"{COUNT_SQL} GROUP BY date, deviceid, sensor",
    ),
    "sensor_count_first": (
        _over_readings(
            lambda r: stats.first_rows(stats.sensor_count(r), ["date", "deviceid", "sensor"])
        ),
        f"{COUNT_SQL} GROUP BY date, deviceid, sensor ORDER BY date, deviceid, sensor LIMIT 20",
    ),
    "daily_total": (
        _over_readings(lambda r: stats.daily_total(r, "LiMo")),
        f"{READINGS_SQL} SELECT date, 'LiMo' AS type, count(*) AS count FROM readings GROUP BY date",
    ),
    "device_type": (
        _over_readings(lambda r: stats.device_type(r, LISTED, "LiMo")),
        f"""{READINGS_SQL} SELECT DISTINCT deviceid, 'LiMo' AS type FROM readings
WHERE sensor IN ({_listed_sql(LISTED)})""",
    ),
    "device_rows": (
        _over_readings(stats.device_rows),
        f"{READINGS_SQL} SELECT deviceid, count(*) AS count FROM readings GROUP BY deviceid",
    ),
    "distinct_days": (
        _over_readings(stats.distinct_days),
        f"{READINGS_SQL} SELECT DISTINCT date FROM readings ORDER BY date",
    ),
    "quartiles": (
        _over_readings(limits.quartiles),
        f"{_quartile_sql('date, sensor')} SELECT date, sensor, q1, median, q3, count FROM quartiles",
    ),
    "quartiles_by_sensor": (
        _over_readings(lambda r: limits.quartiles(r, SENSOR)),
        f"{_quartile_sql('sensor')} SELECT sensor, q1, median, q3, count FROM quartiles",
    ),
    "boxplot": (
        _over_readings(lambda r: _rounded(limits.boxplot(r), "lower", "upper")),
        f"""{_quartile_sql('date, sensor')}
SELECT date, sensor, round(lower, 6) AS lower, q1, median, q3, round(upper, 6) AS upper
FROM fences""",
    ),
    "outliers": (
        _over_readings(limits.outliers),
        f"""{_quartile_sql('date, sensor')} SELECT date, sensor, measure
FROM readings JOIN fences USING (date, sensor) WHERE measure > upper""",
    ),
    "outliers_by_sensor": (
        _over_readings(lambda r: limits.outliers(r, SENSOR, side="both")),
        f"""{_quartile_sql('sensor')} SELECT sensor, measure
FROM readings JOIN fences USING (sensor) WHERE measure > upper OR measure < lower""",
    ),
    "top_value": (
        _over_readings(limits.top_value),
        f"{_top_sql('date, deviceid, sensor', 0.001)} SELECT * FROM tops",
    ),
    "top_value_by_sensor": (
        _over_readings(lambda r: limits.top_value(r, SENSOR)),
        f"{_top_sql('sensor', 0.001)} SELECT * FROM tops",
    ),
    "top_value_by_device": (
        _over_readings(lambda r: limits.top_value(r, ("deviceid", "sensor"), 0.1)),
        f"{_top_sql('deviceid, sensor', 0.1)} SELECT * FROM tops",
    ),
    "exceed_by_hour": (
        _over_readings(lambda r: limits.exceed_by_hour(r, ("deviceid", "sensor"), 0.1)),
        _exceed_sql("deviceid, sensor", 0.1),
    ),
    "exceed_by_hour_daily": (
        _over_readings(lambda r: limits.exceed_by_hour(r, ("date", "sensor"), 0.1)),
        _exceed_sql("date, sensor", 0.1),
    ),
    "exceed_by_hour_sensor": (
        _over_readings(lambda r: limits.exceed_by_hour(r, SENSOR)),
        _exceed_sql("sensor", 0.001),
    ),
    "restart_count": (_restarts(DEVICE), _restart_sql("deviceid")),
    "restart_count_open_start": (
        _restarts(DEVICE, open_start=True),
        _restart_sql("deviceid", open_start=True),
    ),
    "restart_count_daily": (_restarts(sessions.DEVICE_DAY), _restart_sql("date, deviceid")),
    "run_sessions": (_session_rows(DEVICE), f"{_sessions_sql('deviceid')} SELECT * FROM energy"),
    "run_sessions_daily": (
        _session_rows(sessions.DEVICE_DAY),
        f"{_sessions_sql('date, deviceid')} SELECT * FROM energy",
    ),
    "device_statistics": (_statistics(DEVICE), _statistics_sql("deviceid")),
    "device_statistics_daily": (
        _statistics(sessions.DEVICE_DAY),
        _statistics_sql("date, deviceid"),
    ),
    "device_status": (
        _over_states(_status_rows),
        f"""{_sessions_sql('deviceid')}
SELECT deviceid, starttime, stoptime, CASE WHEN run IS NULL THEN 0.0 ELSE kwh END AS kwh
FROM (SELECT DISTINCT deviceid FROM readings) LEFT JOIN energy USING (deviceid)""",
    ),
    "aligned_readings": (
        _over_readings(lambda r: relations.align(r, LISTED)),
        f"""{_aligned_sql(LISTED, 'date')}
SELECT date, place - 1 AS position, {', '.join(LISTED)} FROM aligned""",
    ),
    "pearson_pair": (
        _over_readings(lambda r: _rounded(relations.pearson(r, "click", "view"), "corr")),
        _pearson_sql("date", "date,"),
    ),
    "pearson_pair_all": (
        _over_readings(lambda r: _rounded(relations.pearson(r, "click", "view", keys=()), "corr")),
        _pearson_sql("everything", ""),
    ),
    "spearman_pair": (
        _over_readings(lambda r: _rounded(relations.spearman(r, "click", "view"), "corr")),
        _spearman_sql("date", "date,"),
    ),
    "spearman_pair_all": (
        _over_readings(lambda r: _rounded(relations.spearman(r, "click", "view", keys=()), "corr")),
        _spearman_sql("everything", ""),
    ),
    "corr_matrix": (
        _over_readings(lambda r: _rounded(relations.corr_matrix(r, SENSORS), "corr")),
        _matrix_sql(),
    ),
    "corr_matrix_wide": (
        _over_readings(
            lambda r: _rounded(
                relations.wide_matrix(relations.corr_matrix(r, SENSORS), SENSORS), *SENSORS
            )
        ),
        _wide_matrix_sql(),
    ),
    "kmeans_clusters": (
        _over_readings(_clusters),
        f"""{_aligned_sql(LISTED, 'date')},
groups AS (SELECT *, (day(date) % 3) * 100000 AS apart FROM aligned)
SELECT count(*) AS cluster_num, round(avg({LISTED[0]} + apart), 6) AS sensor1,
       round(avg({LISTED[1]} + apart), 6) AS sensor2, round(avg({LISTED[2]} + apart), 6) AS sensor3
FROM groups GROUP BY apart""",
    ),
    "kmeans_size_check": (
        _over_readings(_cluster_sizes),
        f"""{_aligned_sql(LISTED, 'date')}
SELECT count(*) AS cluster_num FROM aligned GROUP BY day(date) % 3""",
    ),
    "kmeans_by_date": (
        _over_readings(_clusters_of_days),
        f"""{_aligned_sql(LISTED, 'date')},
groups AS (SELECT *, (place - 1) % 3 * 100000 AS apart FROM aligned)
SELECT date, count(*) AS cluster_num, round(avg({LISTED[0]} + apart), 6) AS sensor1,
       round(avg({LISTED[1]} + apart), 6) AS sensor2, round(avg({LISTED[2]} + apart), 6) AS sensor3
FROM groups GROUP BY date, apart""",
    ),
    "day_plan": (_day_plan, _day_plan_sql()),
    "read_counts": (
        _read_counts,
        f"""{ACCEPTED_SQL}
SELECT date, count(*) AS count, (SELECT count(*) FROM raw WHERE sensor <> 'signup') AS accepted,
       (SELECT count(*) FROM raw WHERE sensor = 'signup') AS rejected
FROM readings GROUP BY date""",
    ),
    "outliers_rerun_empty": (
        _rerun_without_rows,
        f"""{_quartile_sql('date, sensor')} SELECT CAST(date AS VARCHAR) AS date, sensor, measure
FROM readings JOIN fences USING (date, sensor) WHERE measure > upper AND date <> DATE '{DAY}'""",
    ),
    "day_report": (
        _day_report("max-min"),
        f"""{READINGS_SQL}
SELECT date, deviceid, sensor, max(measure) AS max, min(measure) AS min, round(avg(measure), 6) AS avg
FROM readings WHERE date = DATE '{DAY}' GROUP BY ALL""",
    ),
    "device_day_rerun": (
        _rerun_of_days,
        f"{READINGS_SQL} SELECT date, count(*) AS count FROM readings GROUP BY date",
    ),
    "outliers_rerun": (
        _rerun_without_key,
        f"""{_quartile_sql('date, sensor')} SELECT CAST(date AS VARCHAR) AS date, sensor, measure
FROM readings JOIN fences USING (date, sensor) WHERE measure > upper""",
    ),
    "empty_append": (
        _empty_append,
        f"""{READINGS_SQL} SELECT CAST(date AS VARCHAR) AS date, 'LiMo' AS type, count(*) AS count
FROM readings GROUP BY date""",
    ),
    "parsed_readings": (
        _parsed_readings,
        f"""{RAW_SQL}
SELECT seq, deviceid, sensor, measure, ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date,
       CAST(hour(ts + INTERVAL 8 HOUR) AS INTEGER) AS hour
FROM raw WHERE sensor <> 'signup'""",
    ),
    "rejected_readings": (
        _rejected_readings,
        f"{RAW_SQL} SELECT seq, deviceid, sensor FROM raw WHERE sensor = 'signup'",
    ),
    "csv_readings": (
        _csv_readings,
        f"""{RAW_SQL}
SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, deviceid, sensor, max(measure) AS max,
       min(measure) AS min, round(avg(measure), 6) AS avg
FROM raw WHERE sensor <> 'signup' GROUP BY ALL""",
    ),
    "ingest_documents": (
        _ingest,
        """SELECT user_id AS deviceid, props AS topic, event_type AS sensor, value AS measure,
       ts AS timestamp
FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-30' AND event_type <> 'error'""",
    ),
    "day_windows": (
        _over_readings(source.day_windows),
        """SELECT DISTINCT CAST(ts AS DATE) AS date, CAST(ts AS DATE) - INTERVAL 8 HOUR AS start_ts,
       CAST(ts AS DATE) + INTERVAL 16 HOUR AS end_ts
FROM events""",
    ),
    "device_day_slices": (
        _device_days,
        f"""{READINGS_SQL}
SELECT date, deviceid, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts
FROM readings GROUP BY date, deviceid""",
    ),
    "sink_roundtrip": (
        _sink_roundtrip,
        f"""{READINGS_SQL}
SELECT CAST(date AS VARCHAR) AS date, CAST(deviceid AS VARCHAR) AS deviceid, sensor,
       max(measure) AS max, min(measure) AS min, round(avg(measure), 6) AS avg
FROM readings GROUP BY date, deviceid, sensor""",
    ),
    "duplicate_keys": (
        _written_keys,
        f"""{READINGS_SQL}
SELECT date, deviceid, sensor, CAST(2 AS BIGINT) AS count FROM readings
GROUP BY date, deviceid, sensor HAVING count(*) > 2""",
    ),
}


try:
    from corpus_pipeline import QUERIES as PIPELINE_QUERIES
    from sensorloom.llm.queries import QUERIES as LLM_QUERIES

    REGISTRY |= LLM_QUERIES | PIPELINE_QUERIES
except ModuleNotFoundError as missing:
    # The corpus operators are optional; anything else that is missing is an error.
    if not (missing.name or "").startswith(("sensorloom.llm", "corpus_pipeline")):
        raise


def entry(spark: SparkSession) -> DataFrame:
    """Daily maximum, minimum and mean per device and sensor."""
    return queries()["daily_stats"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
