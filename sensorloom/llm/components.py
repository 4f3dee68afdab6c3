"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sensorloom.session import stored

MOST_ROUNDS = 60


def _nearest(links: DataFrame) -> DataFrame:
    """Each node ``a`` with its smallest neighbour or itself, beside every neighbour ``b``."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return links.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected to, for each node of links (a, b).

    Alternates the large-star and small-star steps until the links form stars, each round written to the
    shared folder. A round keeps at most as many links as there were, and no node's neighbours are collected.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    seen = Observation()
    links = stored(links.observe(seen, F.count(F.lit(1)).alias("rows")), "links")
    before = None if seen.get["rows"] else (0, None)
    for _ in range(MOST_ROUNDS):
        if before == (0, None):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _nearest(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b")
        # Here every link leads from a node to a smaller one; its smallest neighbour takes the others.
        star = _nearest(large)
        small = star.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            star.select("a", F.col("least").alias("b"))
        )
        small = small.filter("a <> b").distinct()
        seen = Observation()
        links = stored(
            small.observe(
                seen,
                F.count(F.lit(1)).alias("rows"),
                F.bit_xor(F.xxhash64("a", "b")).alias("content"),
            ),
            "links",
        )
        now = (seen.get["rows"], seen.get["content"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
