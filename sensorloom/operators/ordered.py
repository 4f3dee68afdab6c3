"""Ordered work inside groups of any size.

Ranks, running totals and previous-row lookups are windows, and a window puts a whole group into one
task. That is right for the many small groups of sensor data and wrong for a device or sensor that
holds a large part of all rows. So groups are counted first. Groups up to a row limit stay whole.
Larger ones are cut into chunks that are consecutive in the order; windows then run inside a chunk, and a small
table with one row per chunk carries totals and last rows from one chunk to the next. Both ways give the same exact result.

Groups in the order of time are cut into cells of equal width, whose width is found for each group by counting until no
cell has more rows than the limit. The cell of a row follows from its time and that width alone, so a second evaluation cuts
alike, nothing is stored, and the windows need one shuffle by group and cell however many cells there are.

Any other order, and a group of which more rows than the limit share one instant, is range-partitioned by (keys, order). These
chunk numbers come from a sample, so the rows are stored before anything is computed from them: a second evaluation could cut
elsewhere. More chunks than one shuffle should have are cut in two steps, ranges first and then the chunks of some ranges at a time.

Nothing here grows in the driver: it receives counts only. A table is broadcast if its counted rows are few, and
joined by a shuffle beyond, salted where one key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.cleaning import wall_micros
from sensorloom.session import scratch_path, stored

# Largest group, in rows, that one task may sort.
HOT_ROWS = 5_000_000
# Chunks that one shuffle cuts; its sampled bounds would be poor for many more.
SHUFFLE_CHUNKS = 5_000
# Largest table, in rows of a few numbers and keys, that is sent to every executor.
BROADCAST_ROWS = 500_000
# Widths of time cells in microseconds: a day, an hour, a minute, a second, a millisecond, and the resolution of the type.
CELL_WIDTHS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)

# Parts into which the rows of a hot key are dealt when they meet a table that is too large to broadcast.
SALTS = 32

CHUNK = "_chunk"
RANGE = "_range"
SALT = "_salt"
WEIGHT = "_weight"
WHOLE = "_whole"


def grouping(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keys to group by; the whole table becomes one group when there are none."""
    if keys:
        return df, list(keys)
    return df.withColumn(WHOLE, F.lit(0)), [WHOLE]


@dataclass(frozen=True)
class GroupSizes:
    """What counting the groups told: how many there are and which exceed the row limit."""

    groups: int
    rows: int
    limit: int
    hot: DataFrame | None = None
    hot_groups: int = 0
    hot_total: int = 0
    broadcast_rows: int = BROADCAST_ROWS
    shuffle_chunks: int = SHUFFLE_CHUNKS

    @property
    def chunks(self) -> int:
        """Chunks for the hot rows, half the row limit each."""
        return math.ceil(2 * self.hot_total / self.limit)

    def few(self, rows: int) -> bool:
        return rows <= self.broadcast_rows

    @property
    def mixed(self) -> bool:
        return 0 < self.hot_groups < self.groups

    @property
    def mean_rows(self) -> float:
        return self.rows / self.groups if self.groups else 0.0


def measure_groups(
    rows: DataFrame,
    keys: Sequence[str],
    hot_rows: int = HOT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    shuffle_chunks: int = SHUFFLE_CHUNKS,
    counted: str | None = None,
) -> GroupSizes:
    """Count the groups with one partial aggregation, a job that runs at once.

    The keys of the hot groups are stored as a table; the driver receives four numbers. ``counted`` names a column with
    the number of rows that each row stands for, such as counts by finer keys.
    """
    every, large = Observation(), Observation()
    count, total = F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))
    hot = (
        rows.groupBy(*keys)
        .agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("_rows"))
        .observe(every, count.alias("groups"), total.alias("rows"))
        .filter(F.col("_rows") > hot_rows)
        .observe(large, count.alias("groups"), total.alias("rows"))
    )
    table = stored(hot.select(*keys), "hot-keys")
    sizes = GroupSizes(
        every.get["groups"],
        every.get["rows"],
        hot_rows,
        broadcast_rows=broadcast_rows,
        shuffle_chunks=shuffle_chunks,
    )
    if not large.get["groups"]:
        return sizes
    return replace(sizes, hot=table, hot_groups=large.get["groups"], hot_total=large.get["rows"])


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast: bool = False,
    salted: bool = False,
) -> DataFrame:
    """Null-safe join with a table that has unique ``on`` columns.

    ``salted`` deals the rows of a key into parts and repeats the table for each, for keys that hold many rows.
    """
    on = list(on)
    if salted and not broadcast:
        spread = rows.withColumn(SALT, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        return lookup(spread, table.withColumn(SALT, parts), [*on, SALT], how).drop(SALT)
    renamed = table.withColumnsRenamed({name: f"_to_{name}" for name in on})
    same = reduce(
        lambda a, b: a & b, (F.col(name).eqNullSafe(F.col(f"_to_{name}")) for name in on)
    )
    joined = rows.join(F.broadcast(renamed) if broadcast else renamed, same, how)
    return joined.drop(*(f"_to_{name}" for name in on))


def _of_hot(rows: DataFrame, keys: Sequence[str], sizes: GroupSizes, how: str) -> DataFrame:
    """Rows of the hot groups, or with ``left_anti`` of the others."""
    return lookup(rows, sizes.hot, keys, how, sizes.few(sizes.hot_groups), salted=True)


def by_size(
    rows: DataFrame,
    keys: Sequence[str],
    sizes: GroupSizes,
    work: Callable[[DataFrame, GroupSizes | None], DataFrame],
) -> DataFrame:
    """Apply work that treats each group on its own: with None to the groups that may stay whole and,
    if there are any, with the sizes to the hot ones."""
    if not sizes.mixed:
        return work(rows, sizes if sizes.hot_groups else None)
    whole = work(_of_hot(rows, keys, sizes, "left_anti"), None)
    return whole.unionByName(work(_of_hot(rows, keys, sizes, "left_semi"), sizes))


def join_per_group(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], sizes: GroupSizes
) -> DataFrame:
    """Inner join of rows with a table that has one row per group, whose sizes are known.

    The table is broadcast if the groups are few. Beyond that the groups below the row limit are joined by a
    shuffle, in which no key exceeds the limit. The hot ones meet the table rows of their own, broadcast if
    these are few and by a salted shuffle otherwise.
    """
    if sizes.few(sizes.groups):
        return lookup(rows, table, keys, "inner", broadcast=True)

    def joined(part: DataFrame, hot: GroupSizes | None) -> DataFrame:
        if hot is None:
            return lookup(part, table, keys, "inner")
        of_hot = lookup(table, sizes.hot, keys, "left_semi", sizes.few(sizes.hot_groups))
        return lookup(part, of_hot, keys, "inner", sizes.few(sizes.hot_groups), salted=True)

    return by_size(rows, keys, sizes, joined)


def _instant(rows: DataFrame, time: str) -> Column:
    """Microseconds of a time column."""
    zoned = isinstance(rows.schema[time].dataType, T.TimestampType)
    return F.unix_micros(time) if zoned else wall_micros(F.col(time))


def _cell_of(instant: Column, width: Column | int) -> Column:
    return F.floor(instant / width).cast("long")


@dataclass(frozen=True)
class TimeCells:
    """For each hot group the width of its time cells. ``dense`` has the groups that no width can cut, with their rows."""

    widths: DataFrame
    cells: int
    dense: DataFrame | None = None
    dense_rows: int = 0


def measure_cells(rows: DataFrame, keys: Sequence[str], time: str, hot: GroupSizes) -> TimeCells:
    """Find the widest cells with at most the row limit for each group, by counting at call.

    Groups with fuller cells are counted again with narrower ones, at least as much narrower as the fullest cell of each asks for.
    """
    keys, instant, few = list(keys), _instant(rows, time), hot.few(hot.hot_groups)
    settled: list[DataFrame] = []
    cells, wanted, open_ = 0, CELL_WIDTHS[0], None
    for width in CELL_WIDTHS:
        if width > wanted:
            continue
        part = rows if open_ is None else lookup(rows, open_, keys, "left_semi", few, salted=True)
        full, seen = F.col("_most") > hot.limit, Observation()
        counted = (
            part.groupBy(*keys, _cell_of(instant, width).alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_rows"))
            .groupBy(*keys)
            .agg(F.max("_rows").alias("_most"), F.count(F.lit(1)).alias("_cells"), F.sum("_rows").alias("_rows"))
        )
        counted = stored(
            counted.observe(
                seen,
                F.count_if(full).alias("open"),
                F.min(F.when(full, F.col("_most"))).alias("least"),
                F.coalesce(F.sum(F.when(full, F.col("_rows"))), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(~full, F.col("_cells"))), F.lit(0)).alias("cells"),
            ),
            "cells",
        )
        settled.append(counted.filter(~full).select(*keys, F.lit(width).alias("_width")))
        cells += seen.get["cells"]
        if not seen.get["open"]:
            return TimeCells(reduce(DataFrame.unionByName, settled), cells)
        open_ = counted.filter(full).select(*keys)
        wanted = max(width * hot.limit // seen.get["least"], CELL_WIDTHS[-1])
    return TimeCells(reduce(DataFrame.unionByName, settled), cells, open_, seen.get["rows"])


def cut_by_time(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hot: GroupSizes) -> tuple[DataFrame, int]:
    """Rows of hot groups with the number of their time cell, and how many cells there are at most."""
    found, few = measure_cells(rows, keys, order[0], hot), hot.few(hot.hot_groups)
    placed = lookup(rows, found.widths, keys, "inner", few, salted=True)
    placed = placed.withColumn(CHUNK, _cell_of(_instant(rows, order[0]), F.col("_width"))).drop("_width")
    if found.dense is None:
        return placed, found.cells
    dense, of_dense = lookup(rows, found.dense, keys, "left_semi", few, salted=True), replace(hot, hot_total=found.dense_rows)
    return placed.unionByName(cut_into_chunks(dense, [*keys, *order], of_dense)), found.cells + of_dense.chunks


def cut_into_chunks(rows: DataFrame, order: list[str], hot: GroupSizes) -> DataFrame:
    """Rows with the number of their chunk, stored. Chunks follow one another in the given order."""
    if hot.chunks <= hot.shuffle_chunks:
        cut = rows.repartitionByRange(hot.chunks, *order)
        return stored(cut.withColumn(CHUNK, F.spark_partition_id().cast("long")), "chunks")
    ranges = stored(
        rows.repartitionByRange(hot.shuffle_chunks, *order).withColumn(
            RANGE, F.spark_partition_id()
        ),
        "ranges",
        partition_by=RANGE,
    )
    # Some consecutive ranges at a time are cut again, by bounds sampled from them alone.
    batches = min(math.ceil(hot.chunks / hot.shuffle_chunks), hot.shuffle_chunks)
    width = math.ceil(hot.chunks / batches)
    path = scratch_path(rows.sparkSession, "chunks")
    for batch in range(batches):
        first, end = (hot.shuffle_chunks * b // batches for b in (batch, batch + 1))
        part = ranges.filter((F.col(RANGE) >= first) & (F.col(RANGE) < end)).drop(RANGE)
        cut = part.repartitionByRange(width, *order)
        numbered = cut.withColumn(CHUNK, F.spark_partition_id().cast("long") + batch * width)
        numbered.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


@dataclass(frozen=True)
class OrderedGroups:
    """Rows whose groups are either all whole or all cut into numbered chunks."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    hot: GroupSizes | None
    cells: int = 0

    @property
    def split(self) -> bool:
        return self.hot is not None

    @classmethod
    def of(
        cls, rows: DataFrame, keys: Sequence[str], order: Sequence[str], hot: GroupSizes | None
    ) -> OrderedGroups:
        """``hot`` tells that the groups are to be cut, which counts them at once, or stores them if their order is not that
        of time; None leaves the groups whole."""
        keys, order = list(keys), list(order)
        if hot is None:
            return cls(rows, keys, order, None)
        if isinstance(rows.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
            cut, cells = cut_by_time(rows, keys, order, hot)
            return cls(cut, keys, order, hot, cells)
        return cls(cut_into_chunks(rows, [*keys, *order], hot), keys, order, hot, hot.chunks)

    @property
    def _cell(self) -> list[str]:
        return self.keys + [CHUNK] if self.split else self.keys

    @property
    def _ordered(self):
        return Window.partitionBy(*self._cell).orderBy(*self.order)

    @property
    def _chunk_order(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def _beside(self, rows: DataFrame, per_chunk: DataFrame) -> DataFrame:
        """Rows with a table that has one row per group and chunk. By a shuffle a cell of it meets one chunk."""
        few = self.hot.few(self.hot.hot_groups + self.cells)
        return lookup(rows, per_chunk, self._cell, broadcast=few)

    def _per_chunk(self, **values: Column) -> DataFrame:
        """One row per chunk."""
        aggregates = (value.alias(name) for name, value in values.items())
        return self.rows.groupBy(*self.keys, CHUNK).agg(*aggregates)

    def _with(self, rows: DataFrame) -> OrderedGroups:
        return replace(self, rows=rows)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedGroups:
        """Apply a row-wise change."""
        return self._with(change(self.rows))

    def running_total(self, amount: Column, before: str, total: str | None = None) -> OrderedGroups:
        """Sum of ``amount`` over the earlier rows of the group and, if named, over the whole group."""
        so_far = self._ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {before: F.sum(amount).over(so_far) - amount}
        if total:
            # Same order as above, so both sums come from one window pass.
            columns[total] = F.sum(amount).over(
                self._ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            )
        rows = self.rows.withColumns(columns)
        if self.split:
            earlier = self._chunk_order.rowsBetween(Window.unboundedPreceding, -1)
            offsets = self._per_chunk(_amount=F.sum(amount)).select(
                *self.keys,
                CHUNK,
                F.sum("_amount").over(earlier).alias("_earlier"),
                F.sum("_amount").over(Window.partitionBy(*self.keys)).alias("_all"),
            )
            rows = self._beside(rows, offsets)
            rows = rows.withColumn(before, F.col(before) + F.coalesce("_earlier", F.lit(0)))
            if total:
                rows = rows.withColumn(total, F.col("_all"))
            rows = rows.drop("_earlier", "_all")
        return self._with(rows)

    def previous_row(self, **fields: str) -> OrderedGroups:
        """Columns of the row before under new names; NULL on the first row of the group.

        Plain columns, because Spark would compute expressions before the shuffle and ship them too.
        """
        ordered = self._ordered
        earlier = {name: F.lag(field).over(ordered) for name, field in fields.items()}
        if not self.split:
            return self._with(self.rows.withColumns(earlier))
        values = F.struct(*(F.col(field).alias(name) for name, field in fields.items()))
        last = self._per_chunk(_last=F.max_by(values, F.struct(*self.order)))
        carried = last.withColumn("_last", F.lag("_last").over(self._chunk_order))
        rows = self.rows.withColumns({**earlier, "_place": F.row_number().over(ordered)})
        rows = self._beside(rows, carried)
        first = F.col("_place") == 1
        filled = {name: F.when(first, F.col(f"_last.{name}")).otherwise(F.col(name)) for name in fields}
        return self._with(rows.withColumns(filled).drop("_place", "_last"))

    def last_seen(self, **fields: str) -> OrderedGroups:
        """For each new name the latest non-null value of a column up to and including the row."""
        so_far = self._ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = {
            name: F.last(field, ignorenulls=True).over(so_far) for name, field in fields.items()
        }
        rows = self.rows.withColumns(seen)
        if not self.split:
            return self._with(rows)
        place = F.struct(*self.order)
        latest = self._per_chunk(
            **{
                f"_latest_{name}": F.max_by(field, F.when(F.col(field).isNotNull(), place))
                for name, field in fields.items()
            }
        )
        earlier = self._chunk_order.rowsBetween(Window.unboundedPreceding, -1)
        carried = [f"_latest_{name}" for name in fields]
        latest = latest.withColumns(
            {name: F.last(name, ignorenulls=True).over(earlier) for name in carried}
        )
        rows = self._beside(rows, latest)
        filled = {name: F.coalesce(name, f"_latest_{name}") for name in fields}
        return self._with(rows.withColumns(filled).drop(*carried))

    def group_max(self, value: Column, name: str) -> OrderedGroups:
        """Largest ``value`` of the group on each of its rows."""
        if not self.split:
            whole = Window.partitionBy(*self.keys)
            return self._with(self.rows.withColumn(name, F.max(value).over(whole)))
        largest = self.rows.groupBy(*self.keys).agg(F.max(value).alias(name))
        few = self.hot.few(self.hot.hot_groups)
        return self._with(lookup(self.rows, largest, self.keys, broadcast=few, salted=True))
