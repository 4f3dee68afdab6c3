"""Removal of lines that repeat across documents.

Lines are taken out of the texts, normalised and hashed to 128 bits. One aggregation counts the distinct documents
of every hash and finds the first; a document then loses the positions of its lines whose hash is in too many documents, and
the others are put together by position. Texts stay where they are until the positions are known: only hashes, keys and
positions are exchanged before.

A line that fills a large part of all rows is one key of the join that finds its positions. Hashes with more rows than a limit are
therefore broadcast if they are few, and salted if not; the rest meets their hashes by a shuffle in which no key exceeds that limit.

Cases: a NULL or empty text is one empty line, and NULL stays NULL. Rows of one key are one document; rows without a key are one
document together, after all others. Equal rows lose the same lines. An empty table gives an empty result. Lines end at ``\\n``
only, so a carriage return stays at the end of its line; it counts as white space of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorloom.llm.common import UPPER, apart, restored
from sensorloom.operators.ordered import lookup
from sensorloom.session import stored

SPACES = " \t\n\x0b\x0c\r"
# Shorter keys are never dropped.
LEAST_CHARS = 10
DOCUMENTS = 2
# Rows of one hash that may meet in one task, and keys above that limit that are broadcast at most.
HOT_LINES = 1_000
BROADCAST_KEYS = 100_000


def line_key(line: Column) -> Column:
    """White space off both ends; the text has been lower-cased before."""
    return F.btrim(line, F.lit(SPACES))


def _hashed(**values: Column) -> dict[str, Column]:
    """128 bits of a value as two columns, for each name."""
    return {
        name + half: F.xxhash64(F.lit(seed), value)
        for name, value in values.items()
        for half, seed in (("_low", "line"), ("_high", "dedup"))
    }


def _lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """Hash, document, row and position of every line that is long enough."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    every = texts.select("_id", "_row_low", "_row_high", F.posexplode(F.split(lowered, "\n", -1)).alias("_at", "_line"))
    keyed = every.withColumn("_line", line_key(F.col("_line"))).filter(F.length("_line") >= least_chars)
    return keyed.select("_id", "_row_low", "_row_high", "_at", *(c.alias(n) for n, c in _hashed(_key=F.col("_line")).items()))


def meet(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str, hot_rows: int, broadcast_keys: int) -> DataFrame:
    """Rows joined with a table of unique keys, whose ``_rows`` tells how many rows each key will meet.

    Stores the table. Keys above the limit are broadcast if they are few and meet salted rows otherwise.
    """
    seen, often = Observation(), F.col("_rows") > hot_rows
    table = stored(table.observe(seen, F.coalesce(F.count_if(often), F.lit(0)).alias("hot")), "line-keys")
    hot = seen.get["hot"]
    if not hot:
        return lookup(rows, table.drop("_rows"), on, how)
    few, frequent = hot <= broadcast_keys, table.filter(often).drop("_rows")
    met = lookup(rows, frequent, on, "inner", few, salted=True)
    rest = lookup(rows, frequent.select(*on), on, "left_anti", few, salted=True)
    return met.unionByName(lookup(rest, table.filter(~often).drop("_rows"), on, how))


def dedup_lines(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    documents: int = DOCUMENTS,
    keep_first: bool = True,
    key: str = "doc_id",
    text: str = "text",
    hot_lines: int = HOT_LINES,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """The documents without lines whose key is in at least so many ``documents``, and the numbers of lines and of
    those dropped as ``n_lines`` and ``n_dropped``.

    ``keep_first`` leaves such a line in the document with the smallest key. Two tables are stored at call.
    """
    own = [name for name in docs.columns if name != text]
    packed = apart(docs.select(*(F.col(f"`{name}`") for name in own), F.col(f"`{text}`").alias("_text")), text=F.col("_text"), _id=F.col(f"`{key}`"))
    packed = packed.withColumns(_hashed(_row=F.struct("_id", "text")))
    lines = stored(_lines(packed, least_chars), "lines")
    repeated = (
        lines.groupBy("_key_low", "_key_high")
        .agg(
            F.count_distinct(F.struct("_id")).alias("_documents"),
            F.min("_id").alias("_first"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .filter(F.col("_documents") >= documents)
        .drop("_documents")
    )
    found = meet(lines, repeated, ["_key_low", "_key_high"], "inner", hot_lines, broadcast_keys)
    if keep_first:
        found = found.filter(~F.col("_id").eqNullSafe(F.col("_first")))
    positions = found.groupBy("_row_low", "_row_high").agg(
        F.collect_set("_at").alias("_dropped"),
        # Equal rows name each position once each.
        F.count_if(F.col("_at") >= 0).alias("_named"),
    )
    positions = positions.withColumn("_rows", F.expr("_named div size(_dropped)")).drop("_named")
    split = packed.select(
        F.struct(*(F.col(f"row.`{name}`") for name in own)).alias("row") if own else F.struct().alias("row"),
        F.col("text").isNull().alias("_absent"),
        "_row_low",
        "_row_high",
        # Split before the join, so that a position is looked up in an array that exists.
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"),
    )
    beside = meet(split, positions, ["_row_low", "_row_high"], "left", hot_lines, broadcast_keys)
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    left = F.transform(F.array_except(every, F.col("_dropped")), lambda at: F.get("_lines", at))
    kept = F.array_join(F.when(F.col("_dropped").isNull(), F.col("_lines")).otherwise(left), "\n")
    added = {
        text: F.when(~F.col("_absent"), kept),
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
    }
    return restored(beside, own, **added)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document the lines it had and lost, and the SHA-256 of the text that is left."""
    clean = dedup_lines(docs.select("doc_id", "text"))
    return clean.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
