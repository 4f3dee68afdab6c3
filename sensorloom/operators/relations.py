"""Relations between sensors: alignment, correlation and clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import combinations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import (
    HOT_ROWS,
    WEIGHT,
    WHOLE,
    GroupSizes,
    OrderedGroups,
    by_size,
    grouping,
    join_per_group,
    measure_groups,
)
from sensorloom.operators.stats import only_sensors
from sensorloom.session import stored

POSITION = "position"
# Aligned rows in one partition of a clustering, whatever the session's settings.
CLUSTER_ROWS = 1_000_000
# Dates whose models are fitted at the same time.
MODELS_AT_ONCE = 8


def align(
    readings: DataFrame,
    sensors: Sequence[str],
    keys: Sequence[str] = ("date",),
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """The i-th reading of each sensor side by side, one column per sensor, per group.

    The sequences end with the shortest one. ``drop_last`` gives up the last reading of each sensor,
    which shortens the result by one row. A group without some sensor has no rows.

    Counts the readings per group and sensor at call unless ``sizes`` of these are given; so do the correlations
    and clusters below, which align first.
    """
    rows, by = grouping(readings, keys)
    listed = only_sensors(rows, sensors)
    sizes = sizes or measure_groups(listed, [*by, "sensor"], hot_rows)
    return _align(listed, sensors, by, drop_last, sizes).drop(WHOLE)


def _align(
    listed: DataFrame, sensors: Sequence[str], by: list[str], drop_last: bool, sizes: GroupSizes
) -> DataFrame:
    order = ["ts", "seq"]
    columns = [*by, "sensor"]

    def number(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        ordered = OrderedGroups.of(part, columns, order, hot)
        one = F.lit(1).cast("long")
        numbered = ordered.running_total(one, POSITION, "_length" if drop_last else None).rows
        if drop_last:
            numbered = numbered.filter(F.col(POSITION) < F.col("_length") - 1)
        return numbered.select(*columns, POSITION, "measure")

    numbered = by_size(listed.select(*columns, *order, "measure"), columns, sizes, number)
    side_by_side = numbered.groupBy(*by, POSITION).agg(
        *(F.max(F.when(F.col("sensor") == s, F.col("measure"))).alias(s) for s in sensors)
    )
    return side_by_side.dropna(subset=list(sensors))


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation; NULL for a constant column, where corr() would raise an error."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(
    readings: DataFrame,
    a: str,
    b: str,
    keys: Sequence[str] = ("date",),
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Pearson correlation of two aligned sensors per group, and the number of pairs."""
    pairs, by = grouping(align(readings, [a, b], keys, drop_last, hot_rows, sizes), keys)
    return (
        pairs.groupBy(*by)
        .agg(_correlation(a, b).alias("corr"), F.count(F.lit(1)).alias("pairs"))
        .drop(WHOLE)
    )


def spearman(
    readings: DataFrame,
    a: str,
    b: str,
    keys: Sequence[str] = ("date",),
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Rank correlation of two aligned sensors per group; equal values share their mean rank.

    Counts the readings per group at call, unless ``sizes`` of the groups are given, and once more per group and
    sensor if there are hot ones. Hot groups are aligned and merged into tables at call, too.
    """
    rows, by = grouping(only_sensors(readings, [a, b]), keys)
    # Aligned rows are at most as many as readings, so the sizes of the readings bound theirs.
    sizes = sizes or measure_groups(rows, by, hot_rows)
    of_sensors = sizes
    if sizes.hot_groups:
        of_sensors = measure_groups(
            rows, [*by, "sensor"], sizes.limit, sizes.broadcast_rows, sizes.shuffle_chunks
        )
    aligned = _align(rows, [a, b], by, drop_last, of_sensors)
    if sizes.mixed:
        aligned = stored(aligned, "aligned")

    def correlate(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        return _spearman_whole(part, a, b, by) if hot is None else _spearman_hot(part, a, b, by, hot)

    return by_size(aligned, by, sizes, correlate).drop(WHOLE)


def _spearman_whole(aligned: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    def mean_rank(value: str) -> Column:
        # Equal values are peers in the window that ranks them, so one sort serves both.
        ranked = Window.partitionBy(*by).orderBy(value)
        peers = ranked.rangeBetween(Window.currentRow, Window.currentRow)
        return F.rank().over(ranked) + (F.count(F.lit(1)).over(peers) - 1) / 2

    return (
        aligned.withColumn("_rank_a", mean_rank(a))
        .withColumn("_rank_b", mean_rank(b))
        .groupBy(*by)
        .agg(_correlation("_rank_a", "_rank_b").alias("corr"), F.count(F.lit(1)).alias("pairs"))
    )


def _spearman_hot(
    aligned: DataFrame, a: str, b: str, by: list[str], sizes: GroupSizes
) -> DataFrame:
    """Equal pairs and equal values are merged into counts first, so a value that holds a large part
    of the rows is ranked as one row. Ranks are taken relative to the mean rank, which is known.

    The pairs are stored because the ranks start jobs of their own, which should not align again.
    """
    pairs = stored(
        aligned.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
            F.count(F.lit(1)).alias(WEIGHT)
        ),
        "pairs",
    )

    def ranked(rows: DataFrame, value: str) -> DataFrame:
        def rank(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
            ordered = OrderedGroups.of(part, by, [value], hot)
            centred = F.col("_before") + (F.col(WEIGHT) + 1) / 2 - (F.col("_n") + 1) / 2
            return ordered.running_total(F.col(WEIGHT), "_before", "_n").rows.select(
                *by, value, centred.alias(f"_rank{value}")
            )

        # The merged values tell their own sizes while they are stored.
        seen, large = Observation(), F.col("_rows") > sizes.limit
        counted = pairs.groupBy(*by, value).agg(
            F.sum(WEIGHT).alias(WEIGHT), F.count(F.lit(1)).alias("_rows")
        )
        counted = stored(
            counted.observe(
                seen,
                F.count(F.lit(1)).alias("groups"),
                F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
                F.count_if(large).alias("hot"),
                F.coalesce(F.sum(F.when(large, F.col("_rows"))), F.lit(0)).alias("hot_rows"),
            ),
            "values",
        )
        found = seen.get
        of_values = replace(
            sizes,
            groups=found["groups"],
            rows=found["rows"],
            hot=counted.filter(large).select(*by, value),
            hot_groups=found["hot"],
            hot_total=found["hot_rows"],
        )
        # The sizes of the readings bound those of the values, too.
        ranks = by_size(counted.drop("_rows"), by, sizes, rank)
        return join_per_group(rows, ranks, [*by, value], of_values)

    weight, x, y = F.col(WEIGHT), F.col("_rank_a"), F.col("_rank_b")
    spread = F.sqrt(F.sum(weight * x * x)) * F.sqrt(F.sum(weight * y * y))
    return (
        ranked(ranked(pairs, "_a"), "_b")
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(weight * x * y), spread).alias("corr"),
            F.sum(weight).alias("pairs"),
        )
    )


def corr_matrix(
    readings: DataFrame,
    sensors: Sequence[str],
    keys: Sequence[str] = ("date",),
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Pearson correlation of every pair of sensors per group, one row per ordered pair.

    All pairs are computed in one aggregation, whose state is a fixed number of moments per group.
    """
    sensors = list(sensors)
    aligned, by = grouping(align(readings, sensors, keys, drop_last, hot_rows, sizes), keys)
    pairs = list(combinations(range(len(sensors)), 2))
    moments = aligned.groupBy(*by).agg(
        *(F.stddev_pop(s).alias(f"_s{i}") for i, s in enumerate(sensors)),
        *(F.covar_pop(sensors[i], sensors[j]).alias(f"_c{i}_{j}") for i, j in pairs),
    )

    def entry(i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        if i == j:
            return F.lit(1.0)
        return F.try_divide(F.col(f"_c{low}_{high}"), F.col(f"_s{low}") * F.col(f"_s{high}"))

    entries = F.array(
        *(
            F.struct(
                F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b"), entry(i, j).alias("corr")
            )
            for i, a in enumerate(sensors)
            for j, b in enumerate(sensors)
        )
    )
    return moments.select(*keys, F.inline(entries))


def wide_matrix(
    matrix: DataFrame, sensors: Sequence[str], keys: Sequence[str] = ("date",)
) -> DataFrame:
    """A long correlation matrix as one row per sensor and one column per sensor."""
    columns = (
        F.max(F.when(F.col("sensor_b") == s, F.col("corr"))).alias(s.lower()) for s in sensors
    )
    return matrix.groupBy(*keys, F.col("sensor_a").alias("sensor")).agg(*columns)


def fit_clusters(
    aligned: DataFrame, sensors: Sequence[str], k: int = 3, max_iter: int = 10, seed: int = 1
) -> tuple[KMeansModel, DataFrame]:
    """A k-means model over aligned readings, and the rows with their cluster in ``prediction``."""
    points = VectorAssembler(inputCols=list(sensors), outputCol="features").transform(aligned)
    model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(points)
    return model, model.transform(points)


def kmeans_clusters(
    readings: DataFrame,
    sensors: Sequence[str],
    k: int = 3,
    max_iter: int = 10,
    seed: int = 1,
    keys: Sequence[str] = (),
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Centre and size of each cluster of the aligned readings.

    One model over all given readings; ``keys`` only says within which groups readings are aligned.
    The k centres pass through the driver, as Spark's own model does.
    """
    sensors = list(sensors)
    aligned = align(readings, sensors, keys, drop_last, hot_rows, sizes)
    # The fit reads its rows many times, from a table. Its start points depend on how rows lie in partitions, so
    # that is fixed by the rows alone: their number, their hash and their order.
    seen = Observation()
    aligned = stored(aligned.observe(seen, F.count(F.lit(1)).alias("rows")), "aligned")
    parts = max(1, math.ceil(seen.get["rows"] / CLUSTER_ROWS))
    place = [*keys, POSITION]
    aligned = aligned.repartition(parts, *place).sortWithinPartitions(*place)
    model, clustered = fit_clusters(aligned, sensors, k, max_iter, seed)
    names = [f"sensor{i}" for i in range(1, len(sensors) + 1)]
    centres = [
        (number, *(float(x) for x in centre)) for number, centre in enumerate(model.clusterCenters())
    ]
    schema = "clusterid int, " + ", ".join(f"{name} double" for name in names)
    frame = readings.sparkSession.createDataFrame(centres, schema)
    found = clustered.groupBy(F.col("prediction").alias("clusterid")).agg(
        F.count(F.lit(1)).alias("cluster_num")
    )
    return frame.join(found, "clusterid", "left").select(
        "clusterid", F.coalesce("cluster_num", F.lit(0).cast("long")).alias("cluster_num"), *names
    )


def kmeans_by_date(
    readings: DataFrame,
    sensors: Sequence[str],
    k: int = 3,
    max_iter: int = 10,
    seed: int = 1,
    drop_last: bool = True,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
    at_once: int = MODELS_AT_ONCE,
) -> DataFrame:
    """Centre and size of each cluster of every date, from a model of its own; one aligned table, stored by date.

    Readings are aligned within their date. A date with at most ``k`` different rows has one cluster for each. The dates pass through the driver, as do the centres; ``at_once`` models
    are fitted at the same time, each by Spark's own jobs over the folder of its date.
    """
    sensors = list(sensors)
    aligned = align(readings, sensors, ("date",), drop_last, hot_rows, sizes)
    aligned = stored(aligned.hint("rebalance", F.col("date")), "aligned", partition_by="date")
    days = aligned.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*sensors).alias("points"))
    names = [f"sensor{i}" for i in range(1, len(sensors) + 1)]

    def of_day(day: Row) -> list[tuple]:
        parts = max(1, math.ceil(day["rows"] / CLUSTER_ROWS))
        own = aligned.filter(F.col("date").eqNullSafe(F.lit(day["date"]).cast("date")))
        if day["points"] <= k:
            # No more points than clusters: each is a cluster, which needs no model, nor would one accept them.
            found = own.groupBy(*sensors).count().orderBy(*sensors).collect()
            return [(day["date"], i, row["count"], *(row[s] for s in sensors)) for i, row in enumerate(found)]
        own = own.repartition(parts, POSITION).sortWithinPartitions(POSITION)
        model, clustered = fit_clusters(own, sensors, k, max_iter, seed)
        sizes_of = dict(clustered.groupBy("prediction").count().collect())
        return [
            (day["date"], number, sizes_of.get(number, 0), *(float(x) for x in centre))
            for number, centre in enumerate(model.clusterCenters())
        ]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for found in pool.map(of_day, days.orderBy("date").collect()) for row in found]
    schema = "date date, clusterid int, cluster_num long, " + ", ".join(f"{name} double" for name in names)
    return readings.sparkSession.createDataFrame(rows, schema)
