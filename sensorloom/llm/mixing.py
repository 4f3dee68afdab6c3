"""Mixing sources to target weights over a curriculum that changes with time.

Every source has a weight schedule, a piecewise-linear curve over the training time 0 to 1. Its integral is
the source's weight, which decides how many words the mix takes from it. The source's documents stand
in a fixed random order, repeated in epochs until its demand is met; the cumulative demand curve, the
integral of the schedule, is inverted at the place of each copy and gives the time at which training reads it.
The mix is the copies sorted by that time.

Demand beyond ``max_repeats`` times the words of a source goes to the others by weight. Running totals are taken
in two steps, within buckets of about the square root of all rows and over the buckets of a source, so
that a source with a large part of all documents needs no task of its own. Rows that agree in key, text and source are counted
first and told apart again when their places are known, a bounded number of them at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import apart, bucket_count, hash_digits, restored, word_count
from sensorloom.session import stored

# Rates over time of mean 1, dealt to the sources in turn like the weights: an early, an even and a late one.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WEIGHTS = (1, 2, 3)
ORDER_HEX = 15
# Equal rows that are told apart in one step.
EQUAL_ROWS = 10_000
# Sources, each with one small row, that one task puts in order; more are an error.
MOST_SOURCES = 1_000_000

Schedule = Sequence[tuple[float, float]]


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """Linear pieces as (start time, share of the integral before, rate at the start, slope), scaled
    to an integral of 1."""
    whole = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False))
    pieces, before = [], 0.0
    for (t0, r0), (t1, r1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, before, r0 / whole, (r1 - r0) / (t1 - t0) / whole))
        before += (t1 - t0) * (r0 + r1) / 2 / whole
    return pieces


def _dealt(number: Column, values: Sequence[Column]) -> Column:
    """The values in turn, by a number that counts from 0."""
    return F.element_at(F.array(*values), (number % len(values) + 1).cast("int"))


def demand_time(segments: Column, share: Column) -> Column:
    """Time at which the cumulative demand reaches a share of the whole: the inverse of the integral."""
    at = F.element_at(F.filter(segments, lambda s: s.getField("before") <= share), -1)
    rest = share - at.getField("before")
    rate, slope = at.getField("rate"), at.getField("slope")
    root = F.sqrt(F.greatest(rate * rate + 2 * slope * rest, F.lit(0.0)))
    return at.getField("start") + F.when(rest > 0, 2 * rest / (rate + root)).otherwise(0.0)


def source_targets(
    sources: DataFrame, weights: Sequence[float], schedules: Sequence[Schedule], max_repeats: int
) -> DataFrame:
    """Words to take from each source, from rows with ``_no_source``, ``_source`` and ``source_size``.

    Sources sorted by code point, NULL last, get the weights and schedules in turn. A source is full
    below the level at which all targets add up to all words; sorted by the weight at which they
    fill up, the full ones come first, so one running total finds the level. One row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy("_no_source", "_source")
    ranked = sources.withColumn("_number", F.row_number().over(by_name) - 1).withColumn(
        "_weight", _dealt(F.col("_number"), [F.lit(float(w)) for w in weights])
    )
    most = F.col("source_size") * max_repeats
    filling = everything.orderBy(most / F.col("_weight"), "_number")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(earlier), F.lit(0))
    levels = ranked.withColumn("_level", left / F.sum("_weight").over(later))
    open_level = F.when(F.col("_level") * F.col("_weight") <= most, F.col("_level"))
    # The first source that does not fill up sets the level; those before it are full.
    level = F.first(open_level, ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    curves = [
        F.array(
            *(
                F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(piece, ("start", "before", "rate", "slope"), strict=True)))
                for piece in _segments(schedule)
            )
        )
        for schedule in schedules
    ]
    return (
        levels.withColumn("_level", level)
        .withColumn(
            "target",
            F.least(most.cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.lit(0.0))),
        )
        .withColumn("_segments", _dealt(F.col("_number"), curves))
        .drop("_number", "_weight", "_level")
    )


def _name(key: Column, text: Column, source: Column) -> Column:
    """What rows of the same identifier, text and source have in common; never NULL."""
    parts = [F.md5(F.coalesce(part.cast("string"), F.lit(""))) for part in (key, text, source)]
    return F.md5(F.concat(*parts, key.isNull().cast("string"), source.isNull().cast("string")))


@dataclass(frozen=True)
class _Demand:
    """One row for all rows of the same key, text and source, with ``_rows``, their number, and the place of the first
    of them in its source's order; the largest number of equal rows."""

    rows: DataFrame
    most: int
    max_repeats: int

    def copies(self, nth: Column) -> Column:
        """Array of (epoch, words taken, position) of the nth of some equal rows."""
        place = F.col("_place") + nth * F.col("size")

        def copy(epoch: Column) -> Column:
            start = epoch * F.col("source_size") + place
            taken = F.greatest(F.least(F.col("_wanted") - start, F.col("size")), F.lit(0))
            share = F.least((start + taken / 2) / F.col("_wanted"), F.lit(1.0))
            return F.struct(
                epoch.alias("epoch"),
                taken.cast("long").alias("taken"),
                demand_time(F.col("_segments"), share).alias("position"),
            )

        every = F.transform(F.sequence(F.lit(0), F.lit(self.max_repeats - 1)), copy)
        return F.filter(every, lambda c: c.getField("taken") > 0)


def _numbered(rows: DataFrame, most: int, equal_rows: int) -> DataFrame:
    """Rows with the numbers of the equal rows that they stand for, from ``_from`` to ``_to``: all of them, or if some are too many, one
    row for each ``equal_rows`` of them."""
    last = F.col("_rows") - 1
    if most <= equal_rows:
        return rows.withColumns({"_from": F.lit(0).cast("long"), "_to": last})
    starts = F.sequence(F.lit(0).cast("long"), last, F.lit(equal_rows).cast("long"))
    return rows.withColumn("_from", F.explode(starts)).withColumn("_to", F.least(F.col("_from") + equal_rows - 1, last))


def _spread(rows: DataFrame, most: int, equal_rows: int) -> DataFrame:
    """Numbered rows over all tasks, if some stand for many."""
    return rows if most <= equal_rows else rows.repartition("_name", "_from")


def _demand(
    docs: DataFrame, weights: Sequence[float], schedules: Sequence[Schedule], max_repeats: int, key: str, text: str, source: str
) -> _Demand:
    seen, named = Observation(), F.col(source)
    sized = docs.select(
        F.col(key).alias("_id"),
        named.isNull().alias("_no_source"),
        F.coalesce(named, F.lit("")).alias("_source"),
        word_count(F.col(text)).alias("size"),
        _name(F.col(key), F.col(text), named).alias("_name"),
        hash_digits(
            F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))),
            ORDER_HEX,
        ).alias("_order"),
    )
    counted = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_rows"))
    numbers = (F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most"))
    counted = stored(counted.observe(seen, *numbers), "mix-sizes")
    width = -(-(1 << 4 * ORDER_HEX) // bucket_count(seen.get["rows"]))
    counted = counted.withColumns({"_bucket": (F.col("_order") / F.lit(width)).cast("long"), "_whole": F.col("size") * F.col("_rows")})

    same_source = ["_no_source", "_source"]
    buckets = counted.groupBy(*same_source, "_bucket").agg(F.sum("_whole").alias("_words"))
    sources, found = buckets.groupBy(*same_source).agg(F.sum("_words").alias("source_size")), Observation()
    sources = stored(sources.observe(found, F.count(F.lit(1)).alias("sources")), "mix-sources")
    if found.get["sources"] > MOST_SOURCES:
        raise ValueError(f"{found.get['sources']} sources, more than {MOST_SOURCES}")
    earlier = (
        Window.partitionBy(*same_source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    offsets = buckets.join(source_targets(sources, weights, schedules, max_repeats), same_source)

    in_bucket = Window.partitionBy(*same_source, "_bucket").orderBy("_order", "_id", "size")
    so_far = F.sum("_whole").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_whole")
    placed = (
        counted.withColumn("_place", so_far)
        .join(offsets, [*same_source, "_bucket"])
        .withColumn("_place", F.col("_place") + F.col("_before"))
        .withColumn("_wanted", F.round("target").cast("long"))
    )
    columns = ["_id", "_name", "size", "source_size", "target", "_rows", "_place", "_wanted", "_segments"]
    return _Demand(placed.select(*columns), seen.get["most"], max_repeats)


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    max_repeats: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    equal_rows: int = EQUAL_ROWS,
) -> DataFrame:
    """One row per document with what the mix takes of it.

    Returns the key, ``size`` (words, 0 for NULL text), ``source_size`` and ``target`` of its source, ``copies``
    (array of epoch, words taken, position from 0 to 1) and ``_name``, which rows with the same key, text and source share. The last
    copy that a source gives is cut where its demand ends, so the words taken add up to the target, rounded.
    NULL is a source of its own, documents without words have no copies, and rows with the same key and text
    follow each other in the order. Jobs at call: one pass that stores the sizes, and the sources.
    """
    demand = _demand(docs, weights, schedules, max_repeats, key, text, source)
    parts = _spread(_numbered(demand.rows, demand.most, equal_rows), demand.most, equal_rows)
    each = parts.withColumn("_nth", F.explode(F.sequence("_from", "_to")))
    return each.select(
        F.col("_id").alias(key), "_name", "size", "source_size", "target", demand.copies(F.col("_nth")).alias("copies")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    max_repeats: int = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    equal_rows: int = EQUAL_ROWS,
) -> DataFrame:
    """The mix: the documents' own columns once per copy, with ``epoch`` and ``position``, sorted by position.

    Documents stay whole: a copy that demand cuts is in if at least half of its words are wanted. Rows with the same
    key, text and source are one document that occurs so often; its other columns come from one of them. Texts move
    twice: to their copies, and into the order.
    """
    demand = _demand(docs, weights, schedules, max_repeats, key, text, source)
    # The first of some equal rows is wanted longest; without a copy of it there is none of the others.
    used = demand.rows.filter(F.size(demand.copies(F.lit(0))) > 0)
    rows = apart(docs, id=F.col(key), _name=_name(F.col(key), F.col(text), F.col(source)))
    same_name = Window.partitionBy("_name").orderBy(F.xxhash64("row"))
    first = rows.withColumn("_nth", F.row_number().over(same_name)).filter("_nth = 1").drop("_nth")
    parts = _spread(first.join(_numbered(used, demand.most, equal_rows), "_name"), demand.most, equal_rows)
    every = F.flatten(F.transform(F.sequence("_from", "_to"), demand.copies))
    wanted = F.filter(every, lambda c: 2 * c.getField("taken") >= F.col("size"))
    found = parts.select("row", "id", F.explode(wanted).alias("copy"))
    found = found.orderBy("copy.position", "id", "copy.epoch")
    return restored(found, docs.columns, epoch=F.col("copy.epoch"), position=F.col("copy.position"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """Words the mix takes of every document, in the order of their first use; unused ones last."""
    plan = plan_mix(docs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c.getField("taken"))
    return (
        plan.withColumn("_first", F.get("copies", F.lit(0))["position"])
        .orderBy(F.col("_first").asc_nulls_last(), "doc_id")
        .select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.round("_first", 6).alias("first_position"))
    )
