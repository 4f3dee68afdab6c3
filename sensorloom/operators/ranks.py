"""Measures at given ranks of very large groups, found by counting instead of sorting.

A measure falls into a cell that follows its order: first its sign and a part of its octave, then an equal part of the
range that is still in question. Cells are counted per group in one partial and one final aggregation, so what is exchanged are
counts, never rows. The cell that covers a rank becomes the next range, with the smallest and largest measure found in it as its ends, until
these are the same. A range with few rows is counted by value, which ends it.

The numbers of cells are exact in order though not in width: logarithm, difference, quotient and floor never decrease when
the measure grows. Order and ties are those of a sort: NULL first, then -Infinity, numbers, Infinity and NaN; -0.0 equals 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import GroupSizes, lookup
from sensorloom.session import stored

# Maps the group size to the wanted rank, counted from 1 in ascending order.
Rank = Callable[[Column], Column]

# Cells of an octave in the first round, and of a range in the later ones.
OCTAVE_CELLS = 4
RANGE_CELLS = 4_096
# Rows of a range that are counted by value.
FEW_ROWS = 50_000
# An octave has 52 bits, of which every round settles about 12; more rounds than this mean an error.
MOST_ROUNDS = 16

# Above the cell number of any finite measure, whose octaves are -1074 to 1023.
_BEYOND = 1 << 14


def octave_cell(measure: Column) -> Column:
    """Cell of any measure by sign and part of its octave."""
    step = F.floor(F.log2(F.abs(measure)) * OCTAVE_CELLS) + _BEYOND // 2
    return (
        F.when(measure.isNull(), -_BEYOND - 1)
        .when(F.isnan(measure), _BEYOND + 1)
        .when(F.abs(measure) == float("inf"), F.signum(measure) * _BEYOND)
        .when(measure == 0, 0)
        .otherwise(F.signum(measure) * step)
        .cast("double")
    )


def range_cell(measure: Column, low: Column, high: Column) -> Column:
    """Cell of a measure between two finite ends of the same sign, which fall into different cells themselves."""
    return F.floor((measure - low) / (high - low) * RANGE_CELLS).cast("double")


def _counted(rows: DataFrame, by: Sequence[str], cell: Column) -> DataFrame:
    """Cells with their rows, their ends and the rows before them."""
    cells = rows.groupBy(*by, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("measure").alias("_low"), F.max("measure").alias("_high")
    )
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _covers(rank: Column) -> Column:
    return (rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_rows"))


# Ends of the cell that covers a rank, and the rank inside it.
_FOUND = ("_name", "_rank", "_n", "_rows", "_low", "_high")


def _first_round(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank]) -> DataFrame:
    cells = _counted(rows, keys, octave_cell(F.col("measure")))
    cells = cells.withColumn("_n", F.sum("_rows").over(Window.partitionBy(*keys)))
    wanted = F.array(
        *(
            F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).alias("_wanted"))
            for name, rank in ranks.items()
        )
    )
    every = cells.select("*", F.inline(wanted)).filter(_covers(F.col("_wanted")))
    return every.withColumn("_rank", F.col("_wanted") - F.col("_before")).select(*keys, *_FOUND)


def _same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names))


def _next_round(
    rows: DataFrame, keys: Sequence[str], names: Sequence[str], found: DataFrame, sizes: GroupSizes
) -> DataFrame:
    """The found ranks with smaller ranges. A row counts in the one range of its group that holds its measure."""
    open_ = found.filter(F.col("_low") < F.col("_high"))

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("_name") == name, F.col(value)))

    ends = open_.groupBy(*keys).agg(
        *(of(name, value).alias(f"{value}_{i}") for i, name in enumerate(names) for value in ("_low", "_high", "_rows"))
    )
    beside = lookup(rows, ends, keys, "inner", sizes.few(sizes.hot_groups), salted=True)
    measure = F.col("measure")

    def inside(value: str) -> Column:
        """A value of the range that the measure is in; ranges of a group are the same or apart."""
        cases = (F.when(measure.between(F.col(f"_low_{i}"), F.col(f"_high_{i}")), F.col(f"{value}_{i}")) for i in range(len(names)))
        return F.coalesce(*cases)

    ranged = beside.select(
        *keys, "measure", inside("_low").alias("_from"), inside("_high").alias("_to"), inside("_rows").alias("_in")
    ).filter(F.col("_from").isNotNull())
    cell = F.when(F.col("_in") <= FEW_ROWS, measure).otherwise(range_cell(measure, F.col("_from"), F.col("_to")))
    by = [*keys, "_from", "_to"]
    cells = _counted(ranged, by, cell)
    asked = open_.select(
        *(F.col(name).alias(f"_of_{name}") for name in keys),
        F.col("_low").alias("_of__from"),
        F.col("_high").alias("_of__to"),
        "_name",
        F.col("_rank").alias("_wanted"),
        "_n",
    )
    smaller = cells.join(asked, _same(by)).filter(_covers(F.col("_wanted")))
    smaller = smaller.withColumn("_rank", F.col("_wanted") - F.col("_before")).select(*keys, *_FOUND)
    closed = found.filter(~F.coalesce(F.col("_low") < F.col("_high"), F.lit(False)))
    return closed.select(*keys, *_FOUND).unionByName(smaller)


def select_ranks(
    rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, Rank], sizes: GroupSizes
) -> DataFrame:
    """The measures at the given ranks of each group, and the group size as ``count``.

    ``sizes`` tells how many groups there are, all of them hot. Runs one job over the rows for each round, at call; a round stores
    one row for each group and rank.
    """
    rows, names = rows.select(*keys, "measure"), list(ranks)
    found = _first_round(rows, keys, ranks)
    for _ in range(MOST_ROUNDS):
        seen = Observation()
        left = F.count_if(F.coalesce(F.col("_low") < F.col("_high"), F.lit(False)))
        found = stored(found.observe(seen, left.alias("open")), "ranks")
        if not seen.get["open"]:
            values = (F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in names)
            return found.groupBy(*keys).agg(*values, F.max("_n").alias("count"))
        found = _next_round(rows, keys, names, found, sizes)
    raise RuntimeError(f"ranks were not settled in {MOST_ROUNDS} rounds")
