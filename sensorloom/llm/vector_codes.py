"""Product codes of vectors in exact integer arithmetic.

Components become integers, vectors are cut into equal parts, and every part position has a codebook that some rounds of
reassignment and means refine. Vectors are laid out along a Hilbert curve and stored in flat blocks of neighbours; a block holds its
points, the smallest and largest value of every dimension (its box) and their sums. In each round the distances from the box to the
entries leave a short list: an entry that is farther from the nearest point of the box than another is from its farthest point cannot be
nearest to anything in it. A block with one entry left gives its stored sums, any other is compared with its short list by a small integer
kernel. Ties go to the lower index, as no entry that ties for nearest is left out.

A round returns one row of sums for each entry and task, and Spark adds them up. Codebooks pass through the driver: their size
is parts times entries times the width of a part, whatever the table holds. The curve only decides the layout, so its axes and ranges come
from the first vectors alone. Rows are dealt numbers when they are first stored, which spread equal vectors, and equal rows, over partitions.

Cases: rows without a vector, with an empty one, or with a NULL or non-finite component are left out. So are vectors whose length is not
that of the first vector that is a multiple of the parts (by key, NULL keys last, then by content): they have no part positions in common
with the rest. Fewer vectors than entries make a shorter codebook, an empty table an empty result. Repeated rows count as often as they
occur. A component beyond what 64-bit distances can hold is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorloom.llm.hilbert import hilbert_index
from sensorloom.operators.ordered import BROADCAST_ROWS, lookup
from sensorloom.session import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Bytes of the points of one block.
BLOCK_BYTES = 8_192
# Axes of the curve and bits of each.
AXES = 8
BITS = 7
# Blocks whose box distances are taken at once.
BOXES = 32
# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53


def _integers(batches: Iterator[pa.RecordBatch], scale: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Key, label, packed components, number of them, and a running number."""
    dealt = 0
    for batch in batches:
        vectors = batch.column("vector")
        length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array((length > 0) & (length % parts == 0)))
        if not batch.num_rows:
            continue
        vectors = batch.column("vector")
        length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(length)])
        values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
        kept = np.logical_and.reduceat(np.isfinite(values), first[:-1])
        values = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
        if np.abs(values).max() >= 1 << 31:
            raise OverflowError("a scaled component has more than 31 bits")
        whole = values.astype("<i4").tobytes()
        packed = [whole[4 * start : 4 * end] for start, end in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("label"),
                pa.array(packed, pa.binary()),
                pa.array(length, pa.int64()),
                pa.array(np.arange(dealt, dealt + batch.num_rows), pa.int64()),
            ],
            ["key", "label", "points", "length", "dealt"],
        ).filter(pa.array(kept))
        dealt += batch.num_rows


@dataclass(frozen=True)
class Curve:
    """The axes of the curve among the dimensions, with the range that each is divided into."""

    axes: np.ndarray
    low: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray) -> Curve:
        low, high = first.min(axis=0), first.max(axis=0)
        axes = np.argsort(low - high, kind="stable")[:AXES]
        return cls(axes, low[axes], high[axes] - low[axes] + 1)

    def place(self, points: np.ndarray) -> np.ndarray:
        steps = 1 << BITS
        cells = np.floor_divide((points[:, self.axes].astype(np.int64) - self.low) * steps, self.width)
        return hilbert_index(np.clip(cells, 0, steps - 1), BITS)


def _matrix(column: pa.Array, dtype: str, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, dimensions)


def _placed(batches: Iterator[pa.RecordBatch], curve: Curve, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            place = curve.place(_matrix(batch.column("points"), "<i4", dimensions))
            yield batch.append_column("place", pa.array(place, pa.int64()))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of the curve, some at a time as one block row."""
    size = max(1, BLOCK_BYTES // (4 * dimensions))
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in ("points", "low", "high", "sums")}
        starts = range(0, batch.num_rows, size)
        offsets = pa.array([*starts, batch.num_rows], pa.int32())
        points = _matrix(batch.column("points"), "<i4", dimensions)
        for start in starts:
            block = points[start : start + size]
            columns["points"].append(block.tobytes())
            columns["low"].append(block.min(axis=0).tobytes())
            columns["high"].append(block.max(axis=0).tobytes())
            columns["sums"].append(block.sum(axis=0, dtype="<i8").tobytes())
        if len(starts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, batch.column("key")),
                    pa.ListArray.from_arrays(offsets, batch.column("label")),
                    *(pa.array(values, pa.binary()) for values in columns.values()),
                ],
                ["keys", "labels", *columns],
            )


def squared_distances(points: np.ndarray, entries: np.ndarray, largest: int) -> np.ndarray:
    """Exact squared distances of integer points and entries, none above ``largest`` in size."""
    bound = 4 * points.shape[1] * largest * largest
    if bound < EXACT:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    elif bound < 1 << 63:
        points, entries = points.astype(np.int64), entries.astype(np.int64)
    else:
        raise OverflowError("squared distances have more than 63 bits")
    own = (points * points).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :]
    return (own - 2 * (points @ entries.T)).astype(np.int64)


def short_lists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box the entries that may be nearest to a point in it, as a boolean matrix."""
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(np.abs(below), np.abs(above))
    reach = np.maximum(reach, np.maximum(entries[None] - low[:, None, :], high[:, None, :] - entries[None]))
    near, far = (gap * gap).sum(axis=2), (reach * reach).sum(axis=2)
    return near <= far.min(axis=1)[:, None]


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position, as an integer array of parts, entries and positions within a part."""

    entries: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @property
    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class _Block:
    """One part position of a block, with its short list."""

    row: int
    part: int
    points: np.ndarray
    sums: np.ndarray
    listed: np.ndarray


def _visit(batch: pa.RecordBatch, books: Codebooks) -> Iterator[_Block]:
    parts, _, width = books.entries.shape
    entries = books.entries.astype(np.int64)
    for start in range(0, batch.num_rows, BOXES):
        some = batch.slice(start, BOXES)
        low, high = (_matrix(some.column(n), "<i4", books.dimensions).astype(np.int64) for n in ("low", "high"))
        sums = _matrix(some.column("sums"), "<i8", books.dimensions)
        points = [np.frombuffer(blob, "<i4").reshape(-1, books.dimensions) for blob in some.column("points").to_pylist()]
        for part in range(parts):
            own = slice(part * width, (part + 1) * width)
            for row, listed in enumerate(short_lists(low[:, own], high[:, own], entries[part])):
                yield _Block(start + row, part, points[row][:, own], sums[row, own], np.flatnonzero(listed))


def _nearest(block: _Block, books: Codebooks, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point, the lower one of a tie, and the squared distance."""
    distances = squared_distances(block.points, books.entries[block.part, block.listed], largest)
    best = distances.argmin(axis=1)
    return block.listed[best], distances[np.arange(len(best)), best]


def _round(batches: Iterator[pa.RecordBatch], books: Codebooks, largest: int) -> Iterator[pa.RecordBatch]:
    """Number and sum of the points nearest to each entry, of a whole task."""
    parts, count, width = books.entries.shape
    number, total = np.zeros((parts, count), np.int64), np.zeros((parts, count, width), np.int64)
    for batch in batches:
        for block in _visit(batch, books):
            if len(block.listed) == 1:
                number[block.part, block.listed[0]] += len(block.points)
                total[block.part, block.listed[0]] += block.sums
                continue
            nearest, _ = _nearest(block, books, largest)
            order = np.argsort(nearest, kind="stable")
            found, first = np.unique(nearest[order], return_index=True)
            number[block.part, found] += np.diff([*first, len(nearest)])
            total[block.part, found] += np.add.reduceat(block.points[order].astype(np.int64), first)
    part, entry = np.nonzero(number)
    if len(part):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(number[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "number", "total"],
        )


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks, largest: int) -> Iterator[pa.RecordBatch]:
    parts = books.entries.shape[0]
    for batch in batches:
        sizes = [len(keys) for keys in batch.column("keys")]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        codes, errors = np.zeros((first[-1], parts), np.uint8), np.zeros(first[-1], np.int64)
        for block in _visit(batch, books):
            nearest, distance = _nearest(block, books, largest)
            own = slice(first[block.row], first[block.row + 1])
            codes[own, block.part] = nearest
            errors[own] += distance
        digits = codes.tobytes().hex()
        shown = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("keys").flatten(), batch.column("labels").flatten(), pa.array(shown, pa.string()), pa.array(errors)],
            ["key", "label", "code", "error"],
        )


def _first(rows: DataFrame, number: int) -> np.ndarray:
    order = [F.asc_nulls_last("key"), F.asc("points")]
    blobs = [bytes(row.points) for row in rows.orderBy(*order).limit(number).select("points").collect()]
    return np.array([np.frombuffer(blob, "<i4") for blob in blobs], dtype=np.int64)


def flat_blocks(rows: DataFrame, first: np.ndarray) -> DataFrame:
    """Rows of key, label, packed points and a dealt number as blocks in the order of the curve, stored."""
    dimensions = first.shape[1]
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("key", "label")}
    row_schema = f"key {kinds['key']}, label {kinds['label']}, points binary, dealt long"
    placed = rows.select("key", "label", "points", "dealt").mapInArrow(
        partial(_placed, curve=Curve.of(first), dimensions=dimensions), f"{row_schema}, place long"
    )
    along = placed.repartitionByRange("place", "dealt").sortWithinPartitions("place", "dealt")
    block_schema = (
        f"keys array<{kinds['key']}>, labels array<{kinds['label']}>, points binary, low binary, high binary, sums binary"
    )
    return stored(along.mapInArrow(partial(_blocks, dimensions=dimensions), block_schema), "blocks")


def refined(blocks: DataFrame, books: Codebooks, largest: int) -> Codebooks:
    """Codebooks after one round: every used entry becomes the floor of the mean of its points."""
    width = books.entries.shape[2]
    sums = (F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width))
    boxes = blocks.select("points", "low", "high", "sums")
    found = (
        boxes.mapInArrow(partial(_round, books=books, largest=largest), "part int, entry int, number long, total array<long>")
        .groupBy("part", "entry")
        .agg(F.sum("number").alias("number"), *sums)
    )
    entries = books.entries.copy()
    for row in found.collect():
        entries[row.part, row.entry] = [int(row[f"s{i}"]) // row.number for i in range(width)]
    return Codebooks(entries)


def vector_codes(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """``key``, ``label``, ``code`` and ``error`` of every vector that can be coded, and the codebooks.

    A code has two hexadecimal digits for each part; the error is the sum of its squared distances in scaled integers. Trains at
    call, which stores the scaled vectors and the blocks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so 1 to 256 entries")
    label = F.lit(None).cast("int") if label is None else label
    named = vectors.select(F.col(f"`{key}`").alias("key"), label.alias("label"), F.col(f"`{vector}`").alias("vector"))
    kinds = {name: named.schema[name].dataType.simpleString() for name in ("key", "label")}
    schema = f"key {kinds['key']}, label {kinds['label']}, points binary, length long, dealt long"
    rows = stored(named.mapInArrow(partial(_integers, scale=scale, parts=parts), schema), "integers")
    leading = _first(rows, 1)
    if not len(leading):
        empty = rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64))
    dimensions = leading.shape[1]
    rows = rows.filter(F.col("length") == dimensions)
    first = _first(rows, entries)
    blocks = flat_blocks(rows, first)
    books = Codebooks(np.stack(np.split(first, parts, axis=1)))
    largest = _largest(blocks)
    for _ in range(rounds):
        books = refined(blocks, books, largest)
    coded = blocks.select("keys", "labels", "points", "low", "high", "sums").mapInArrow(
        partial(_codes, books=books, largest=largest), f"key {kinds['key']}, label {kinds['label']}, code string, error long"
    )
    return coded, books


def _largest(blocks: DataFrame) -> int:
    """Size of the largest component, from the boxes."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [np.frombuffer(b"".join(batch.column(n).to_pylist()), "<i4").astype(np.int64) for n in ("low", "high")]
            yield pa.RecordBatch.from_arrays([pa.array([max(int(np.abs(e).max()) for e in edges)])], ["reach"])

    return blocks.select("low", "high").mapInArrow(reach, "reach long").agg(F.max("reach")).first()[0]


def vector_code_digest(vectors: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Codes and errors, the error summed over equal labels, and the digest of the codebooks."""
    coded, books = vector_codes(vectors, label=F.col("label"))
    coded, seen = stored(coded, "codes"), Observation()
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = stored(totals.observe(seen, F.count(F.lit(1)).alias("labels")), "label-errors")
    beside = lookup(coded, totals, ["label"], "left", seen.get["labels"] <= broadcast_rows, salted=True)
    return beside.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
