"""Exact order statistics per group and what lies beyond them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import (
    BROADCAST_ROWS,
    HOT_ROWS,
    WEIGHT,
    WHOLE,
    GroupSizes,
    OrderedGroups,
    by_size,
    grouping,
    join_per_group,
    lookup,
    measure_groups,
)
from sensorloom.operators.ranks import Rank, select_ranks

DEVICE_DAY_SENSOR = ("date", "deviceid", "sensor")
DAY_SENSOR = ("date", "sensor")
TOP_FRACTION = 0.001
# Mean group size, in rows, from which equal measures are merged before they are sorted.
MERGE_ROWS = 50_000
# Fixed value: whisker length of a box plot in interquartile ranges.
WHISKER = 1.5

def quantile_rank(p: float) -> Rank:
    """Rank of the smallest value that at least the share ``p`` of the group does not exceed."""
    return lambda n: F.greatest(F.ceil(n * F.lit(p)).cast("long"), F.lit(1).cast("long"))


def top_rank(fraction: float) -> Rank:
    """Rank of the value that floor(n * fraction) rows precede in descending order."""
    return lambda n: n - F.floor(n * F.lit(float(fraction))).cast("long")


def _merged(rows: DataFrame, sizes: GroupSizes) -> DataFrame:
    """Rows with a weight. Equal rows of large groups become one: measures are bound to repeat there, and merging them
    shrinks the sort. For small groups it would only add a shuffle."""
    if sizes.mean_rows >= MERGE_ROWS:
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(WEIGHT))
    return rows.withColumn(WEIGHT, F.lit(1).cast("long"))


def _ranked(rows: DataFrame, keys: list[str]) -> OrderedGroups:
    """Measures in ascending order with the rows before each and the group size."""
    return OrderedGroups.of(rows, keys, ["measure"], None).running_total(
        F.col(WEIGHT), "_before", "_n"
    )


def _at(rank: Rank) -> Column:
    """The measure on the row that covers the rank, NULL elsewhere."""
    wanted = rank(F.col("_n"))
    covers = (wanted > F.col("_before")) & (wanted <= F.col("_before") + F.col(WEIGHT))
    return F.when(covers, F.col("measure"))


def _order_statistics(
    rows: DataFrame, keys: list[str], ranks: Mapping[str, Rank], sizes: GroupSizes
) -> DataFrame:
    def pick(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        if hot is not None:
            return select_ranks(part, keys, ranks, hot)
        return (
            _ranked(_merged(part, sizes), keys)
            .rows.groupBy(*keys)
            .agg(
                *(F.max(_at(rank)).alias(name) for name, rank in ranks.items()),
                F.max("_n").alias("count"),
            )
        )

    return by_size(rows.select(*keys, "measure"), keys, sizes, pick)


def order_statistics(
    readings: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, Rank],
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """The measures at the given ranks of each group, and the group size as ``count``.

    Counts the groups at call unless their ``sizes`` are given, as all operators here do.
    """
    rows, by = grouping(readings, keys)
    sizes = sizes or measure_groups(rows, by, hot_rows)
    return _order_statistics(rows, by, ranks, sizes).drop(WHOLE)


QUARTILES = {"q1": quantile_rank(0.25), "median": quantile_rank(0.5), "q3": quantile_rank(0.75)}


def _fences(rows: DataFrame, keys: list[str], sizes: GroupSizes) -> DataFrame:
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    return _order_statistics(rows, keys, QUARTILES, sizes).select(
        *keys,
        (F.col("q1") - reach).alias("lower"),
        "q1",
        "median",
        "q3",
        (F.col("q3") + reach).alias("upper"),
    )


def quartiles(
    readings: DataFrame,
    keys: Sequence[str] = DAY_SENSOR,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """First quartile, median and third quartile; each is a measure of the group."""
    return order_statistics(readings, keys, QUARTILES, hot_rows, sizes)


def boxplot(
    readings: DataFrame,
    keys: Sequence[str] = DAY_SENSOR,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Quartiles with the lower and upper fence."""
    rows, by = grouping(readings, keys)
    return _fences(rows, by, sizes or measure_groups(rows, by, hot_rows)).drop(WHOLE)


def outliers(
    readings: DataFrame,
    keys: Sequence[str] = DAY_SENSOR,
    side: str = "upper",
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Measures above the upper fence of their group or, with ``side="both"``, outside the fences."""
    if side not in ("upper", "both"):
        raise ValueError("side must be 'upper' or 'both'")
    rows, by = grouping(readings, keys)
    sizes = sizes or measure_groups(rows, by, hot_rows, broadcast_rows)
    fences = _fences(rows, by, sizes).select(*by, "lower", "upper")
    outside = F.col("measure") > F.col("upper")
    if side == "both":
        outside = outside | (F.col("measure") < F.col("lower"))
    compared = join_per_group(rows.select(*by, "measure"), fences, by, sizes)
    return compared.filter(outside).select(*keys, "measure")


def top_value(
    readings: DataFrame,
    keys: Sequence[str] = DEVICE_DAY_SENSOR,
    fraction: float = TOP_FRACTION,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Per group the measure that the share ``fraction`` of its readings precedes in descending
    order, and the number of readings."""
    return order_statistics(readings, keys, {"topvalue": top_rank(fraction)}, hot_rows, sizes)


def exceed_by_hour(
    readings: DataFrame,
    keys: Sequence[str] = DEVICE_DAY_SENSOR,
    fraction: float = TOP_FRACTION,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Readings strictly above the top value of their group, counted per hour.

    Threshold and comparison share one sorted pass; the readings are not joined to themselves. Hot groups are not
    sorted: their thresholds are found by counting, and a second pass compares with them.
    """
    rows, by = grouping(readings, keys)
    sizes = sizes or measure_groups(rows, by, hot_rows)
    hours = list(dict.fromkeys([*by, "hour"]))
    top = top_rank(fraction)

    def count(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        if hot is not None:
            tops = select_ranks(part, by, {"_top": top}, hot).drop("count")
            few = hot.few(hot.hot_groups)
            compared = lookup(part, tops, by, "inner", few, salted=True)
            weight = F.count(F.lit(1))
        else:
            compared = _ranked(_merged(part, sizes), by).group_max(_at(top), "_top").rows
            weight = F.sum(WEIGHT)
        above = compared.filter(F.col("measure") > F.col("_top"))
        return above.groupBy(*hours).agg(weight.alias("count"))

    used = rows.select(*dict.fromkeys([*hours, "measure"]))
    return by_size(used, by, sizes, count).drop(WHOLE)
