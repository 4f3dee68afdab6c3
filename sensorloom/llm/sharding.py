"""Shards of equal bytes by histogram sort.

Documents are ordered by a key: 40 bits of the text's hash, then 60 bits of the identifier's, so that
equal texts are neighbours and a group of copies of any size can still be cut between its documents.
Splitters are found by counting exact bytes below candidate boundaries: every round deals the key range
around each open splitter into 1,024 cells and keeps the cell in which the wanted byte count falls, until
the cell's lower boundary is within the tolerance. Then the rows are exchanged once.

Only the histogram, at most 1,024 cells for each open splitter, reaches the driver, whatever the size of
the input.

Within a shard rows are numbered in cells, by the sum of both key parts: neither one text nor a missing identifier fills a cell. Rows
that agree in both are dealt by the task that first stored them if they are many, so no cell takes them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import apart, bucket_count, hash_digits, restored
from sensorloom.operators.ordered import BROADCAST_ROWS, lookup
from sensorloom.session import stored

HEADER_BYTES = 16
DIGIT_BITS = 10
# Rows of the same text and identifier from which they are dealt over the cells of their shard.
EQUAL_ROWS = 10_000
# Hexadecimal digits of the two key parts: 40 and 60 bits, 4 and 6 digits of 10 bits.
TEXT_HEX, ID_HEX = 10, 15
DIGITS = [("_text_key", shift) for shift in (30, 20, 10, 0)]
DIGITS += [("_id_key", shift) for shift in (50, 40, 30, 20, 10, 0)]

Splitter = tuple[int, int]


def document_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (NULL: none) and of its record header."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + HEADER_BYTES).cast("long")


def sort_key(text: str = "text", key: str = "doc_id") -> dict[str, Column]:
    """Size and the two key parts of a document."""
    return {
        "_id": F.col(key),
        "_size": document_bytes(F.col(text)),
        "_text_key": hash_digits(F.col(text), TEXT_HEX),
        "_id_key": hash_digits(F.col(key), ID_HEX),
    }


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Identifier, size and key of each document, without the text."""
    return docs.select(*(column.alias(name) for name, column in sort_key(text, key).items()))


def _prefix(digits: int) -> Column:
    """The first digits of the key, as one array that can be grouped by."""
    return F.array(
        *(F.shiftright(name, shift).bitwiseAND((1 << DIGIT_BITS) - 1) for name, shift in DIGITS[:digits])
    )


def _key(prefix: tuple[int, ...]) -> Splitter:
    """Smallest key with these leading digits."""
    parts = {"_text_key": 0, "_id_key": 0}
    for (name, shift), digit in zip(DIGITS, prefix, strict=False):
        parts[name] |= digit << shift
    return parts["_text_key"], parts["_id_key"]


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.0) -> list[Splitter]:
    """First key of the shards 1 to ``shards`` - 1.

    A splitter is the smallest key with at least its share of all bytes before it, or the lower boundary of
    the last cell if the bytes before that are within ``tolerance`` shares of one shard. Runs one aggregation a
    round, ten at most.
    """
    total = 0
    # Open splitters: shard -> (digits found so far, bytes before the cell of those digits).
    open_cells: dict[int, tuple[tuple[int, ...], int]] = {s: ((), 0) for s in range(1, shards)}
    found: dict[int, Splitter] = {}
    end = (1 << 63) - 1
    for depth in range(1, len(DIGITS) + 1):
        if not open_cells:
            break
        wanted = {prefix for prefix, _ in open_cells.values()}
        counted = rows
        if depth > 1:
            cells = F.array(*(F.array(*(F.lit(d).cast("long") for d in p)) for p in sorted(wanted)))
            counted = rows.filter(F.array_contains(cells, _prefix(depth - 1)))
        histogram = counted.groupBy(_prefix(depth).alias("cell")).agg(F.sum("_size").alias("bytes"))
        within: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for cell, size in histogram.collect():
            within.setdefault(tuple(cell[:-1]), []).append((cell[-1], size))
        if depth == 1:
            total = sum(size for _, size in within.get((), []))
        still_open = {}
        for shard, (prefix, before) in open_cells.items():
            place = None
            for digit, size in sorted(within.get(prefix, [])):
                if shards * before >= shard * total:
                    place = ((*prefix, digit), before, True)
                    break
                if shards * (before + size) >= shard * total:
                    # The splitter lies in this cell or at its upper boundary.
                    place = ((*prefix, digit), before, False)
                    break
                before += size
            if place is None:
                found[shard] = (end, 0)
                continue
            cell, before, exact = place
            close = shards * abs(shard * total / shards - before) <= tolerance * total
            if exact or close:
                found[shard] = _key(cell)
            elif depth == len(DIGITS):
                found[shard] = _after(cell)
            else:
                still_open[shard] = (cell, before)
        open_cells = still_open
    return [found[shard] for shard in range(1, shards)]


def _after(cell: tuple[int, ...]) -> Splitter:
    text_key, id_key = _key(cell)
    return (text_key, id_key + 1) if id_key + 1 < 1 << 60 else (text_key + 1, 0)


def shard_of(splitters: list[Splitter]) -> Column:
    """Number of splitters at or below the key."""
    at_or_above = (
        (F.col("_text_key") > a) | ((F.col("_text_key") == a) & (F.col("_id_key") >= b))
        for a, b in splitters
    )
    return sum((passed.cast("int") for passed in at_or_above), F.lit(0)).cast("int")


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.0,
    text: str = "text",
    key: str = "doc_id",
    equal_rows: int = EQUAL_ROWS,
) -> DataFrame:
    """Documents with ``size``, ``shard`` and ``slot``, in shards of nearly equal bytes.

    ``slot`` numbers the rows of a shard from 0 without gaps. NULL text has no bytes but its header, NULL
    identifiers are allowed, rows with the same text and identifier stay in one shard, and an empty table gives
    an empty result. Columns named ``size``, ``shard`` or ``slot`` are replaced.

    Jobs at call: one pass that stores the rows with their keys, one over the keys for each round of the histogram, one that counts equal keys.
    """
    placed = _place(apart(docs, **sort_key(text, key)), shards, tolerance, equal_rows)
    return restored(placed, docs.columns, size=F.col("_size"), shard=F.col("shard"), slot=F.col("slot"))


def cell_of(cells: int, dealt: Column | None = None) -> Column:
    """Cell of a row within its shard, from both parts of its key and, where it is given, from where it was stored."""
    place = F.col("_text_key") + F.col("_id_key")
    return ((place if dealt is None else place + dealt) % cells).cast("int")


def _celled(rows: DataFrame, count: int, shards: int, equal_rows: int) -> DataFrame:
    """Stored rows with their cell."""
    cells = max(1, math.ceil(bucket_count(count) / shards))
    seen = Observation()
    key = ["_text_key", "_id_key"]
    equal = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > equal_rows)
    equal = stored(equal.select(*key, F.lit(True).alias("_equal")).observe(seen, F.count(F.lit(1)).alias("keys")), "equal")
    if not seen.get["keys"]:
        return rows.withColumn("_cell", cell_of(cells))
    # There are fewer of these keys than rows by the limit.
    marked = lookup(rows, equal, key, broadcast=seen.get["keys"] <= BROADCAST_ROWS)
    dealt = F.when(F.col("_equal"), F.col("_dealt")).otherwise(0)
    return marked.withColumn("_cell", cell_of(cells, dealt)).drop("_equal")


def _place(docs: DataFrame, shards: int, tolerance: float, equal_rows: int) -> DataFrame:
    """Shard and slot of rows with their key, which are stored first. A slot is the place in
    the row's cell of the shard and the rows of the cells before it, so no task numbers a whole shard."""
    seen = Observation()
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    rows = stored(docs.withColumn("_dealt", dealt).observe(seen, F.count(F.lit(1)).alias("rows")), "shard-rows")
    splitters = find_splitters(rows, shards, tolerance)
    placed = _celled(rows, seen.get["rows"], shards, equal_rows).withColumn("shard", shard_of(splitters))
    earlier = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("shard", "_cell", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    in_cell = Window.partitionBy("shard", "_cell").orderBy("_text_key", "_id_key", "_id")
    numbered = placed.withColumn("_place", F.row_number().over(in_cell))
    joined = numbered.join(before, ["shard", "_cell"])
    return joined.withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where each document goes, without its text: the operator over identifiers, sizes and checksums."""
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(*(column.alias(name) for name, column in sort_key().items()), checksum.alias("text_crc32"))
    placed = _place(rows, shards, 0.0, EQUAL_ROWS)
    return placed.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
