"""Ranked lexical search: the best documents of each query, exact, from an index with a sketch of every document.

The index has one row for each document: its terms as 64-bit hashes with their occurrences, and a sketch of a fixed number of
hashed coordinates. The impact of a term grows with its occurrences, so a coordinate keeps the largest number of occurrences of its
terms: their largest impact follows from that and the document's length under whatever totals the corpus has, and documents can be added
without a rewrite. A query looks up the coordinates of its terms, and the weighted sum of the impacts there is an upper bound of
its score, for a block of documents at once. Documents are then scored exactly by descending bound until no bound
reaches the lowest score of the best ones found so far, which a task carries from block to block. Every task returns its best documents
for each query, and one ranking window merges them.

Queries go to the tasks in batches of a bounded number of terms, each with a pass that counts the documents of
these terms and one that searches. Only a batch's terms, weights and identifiers pass through the driver. Scores are 64-bit integers; two
different terms count as one if their 64-bit hashes agree.

Cases: a NULL or empty text, of a document or a query, has no term and no result. Equal rows of documents are ranked each, equal rows of
queries once. Equal scores go by ascending key, NULL keys last. Queries that share an identifier but not a text are ranked apart. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sensorloom.session import stored

BEST = 10
COORDINATES = 512
# Largest number of occurrences that a coordinate tells; from there on the bound is that of any number.
MOST = 255
# Documents of a block, and bytes of text whose terms are hashed at once.
BLOCK = 1_024
CHUNK_BYTES = 4_000_000
# Terms, repeats across queries included, of the queries that one pass over the index serves.
BATCH_TERMS = 1_000_000
# Documents scored before the bounds are looked at again; doubles from step to step.
FIRST_STEP = 16

# Fixed values of the score: of a term's weight, its impact, and the share of the length in it.
WEIGHT_SCALE = 1_000
IMPACT_SCALE = 1_000_000_000
MOST_IMPACT = 1_000_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_PLAIN = bytes(ord(chr(byte).lower()) if byte < 128 else byte for byte in range(256))
_TABLE = bytes(byte if byte in _KEPT else 32 for byte in _PLAIN)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters, digits and all beyond ASCII, A to Z lower-cased."""
    return text.translate(_TABLE).split()


def _counted(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and occurrences of each distinct term, by row and hash, and the number of terms of each row."""
    found = [Counter(terms_of(text)) if text else Counter() for text in texts]
    distinct = [len(counts) for counts in found]
    names = np.empty(sum(distinct), dtype=object)
    names[:] = [term for counts in found for term in counts]
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)
    rows = np.repeat(np.arange(len(found)), distinct)
    times = np.fromiter((n for counts in found for n in counts.values()), np.int64, len(names))
    order = np.lexsort((hashes, rows))
    total = np.array([sum(counts.values()) for counts in found], np.int64)
    return rows[order], hashes[order], times[order], total


def sketches(rows: np.ndarray, hashes: np.ndarray, times: np.ndarray, number: int) -> np.ndarray:
    """For each row the largest occurrences among the terms of each coordinate."""
    flat = np.zeros(number * COORDINATES, np.uint8)
    place = rows * COORDINATES + (hashes % np.uint64(COORDINATES)).astype(np.int64)
    np.maximum.at(flat, place, np.minimum(times, MOST).astype(np.uint8))
    return flat.reshape(number, COORDINATES)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or b"")
            if size < CHUNK_BYTES and end < len(texts):
                continue
            rows, hashes, times, total = _counted(texts[start:end])
            first = np.searchsorted(rows, np.arange(end - start + 1))
            cuts = list(zip(first[:-1], first[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").slice(start, end - start),
                    pa.array(total),
                    pa.array([hashes[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([times[a:b].astype("<i4").tobytes() for a, b in cuts], pa.binary()),
                    pa.array([row.tobytes() for row in sketches(rows, hashes, times, end - start)], pa.binary()),
                ],
                ["key", "length", "terms", "times", "sketch"],
            )
            start, size = end, 0


@dataclass(frozen=True)
class LexicalIndex:
    """Stored rows of the index, and the numbers of documents with terms and of all terms."""

    rows: DataFrame
    documents: int
    terms: int


def _indexed(texts: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, Observation]:
    named = texts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = named.schema["key"].dataType.simpleString()
    rows = named.mapInArrow(_forward, f"key {kind}, length long, terms binary, times binary, sketch binary")
    seen = Observation()
    rows = rows.observe(
        seen,
        F.count_if(F.col("length") > 0).alias("documents"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("terms"),
        F.coalesce(F.sum(F.expr("octet_length(terms) div 8")), F.lit(0)).alias("distinct"),
    )
    return stored(rows, label), seen


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index of all documents, stored at call."""
    rows, seen = _indexed(docs, key, text, "lexical-index")
    return LexicalIndex(rows, seen.get["documents"], seen.get["terms"])


@dataclass(frozen=True)
class _Queries:
    """Some queries: all their terms in ascending order, the weights of these, and the terms of each query."""

    terms: np.ndarray
    weights: np.ndarray
    queries: list[np.ndarray]
    documents: int
    total: int
    best: int

    def length_share(self, lengths: np.ndarray) -> np.ndarray:
        """How long documents are against the mean, in hundredths, nine tenths of it."""
        return np.array([10 + 90 * int(n) * self.documents // self.total for n in lengths], np.int64)

    def among(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are terms of the queries, and their numbers."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[place] == hashes)
        return hit, place[hit]


def _document_counts(batches: Iterator[pa.RecordBatch], queries: _Queries) -> Iterator[pa.RecordBatch]:
    """Documents of a task that hold each term of the queries."""
    counts = np.zeros(len(queries.terms), np.int64)
    for batch in batches:
        for blob in _joined(batch.column("terms")):
            _, found = queries.among(np.frombuffer(blob, "<u8"))
            counts += np.bincount(found, minlength=len(counts))
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "documents"])


def _joined(column: pa.Array) -> Iterator[bytes]:
    for start in range(0, len(column), BLOCK):
        yield b"".join(column.slice(start, BLOCK).to_pylist())


class _Block:
    """Some documents of the index as arrays: sketched impacts, and the exact ones of the queries' terms."""

    def __init__(self, batch: pa.RecordBatch, queries: _Queries):
        self.keys = batch.column("key").to_pylist()
        share = queries.length_share(batch.column("length").to_numpy())
        largest = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        times = largest.T.astype(np.float64)
        # A quotient of whole numbers is rounded up or to no whole number below it, so its floor is no less than the exact one.
        self.impacts = np.floor(IMPACT_SCALE * times / (1000 * times + 8 * share))
        self.impacts[largest.T == MOST] = MOST_IMPACT
        blobs = batch.column("terms").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(blob) // 8 for blob in blobs])])
        hit, self.terms = queries.among(np.frombuffer(b"".join(blobs), "<u8"))
        occurs = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i4")[hit].astype(np.int64)
        rows = np.searchsorted(first, hit, side="right") - 1
        self.exact = IMPACT_SCALE * occurs // (1000 * occurs + 8 * share[rows])
        self.first = np.searchsorted(hit, first)

    def bounds(self, coordinates: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No less than the score of each document; the margin is that of a sum of doubles."""
        return np.ceil((weights @ self.impacts[coordinates]) * (1 + 1e-9))

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents under a query's weights of all terms, 0 for the terms that it lacks."""
        start, number = self.first[rows], self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(number)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - number), number)
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[place]] * self.exact[place])])
        return sums[ends] - sums[ends - number]


# One of a query's best documents: the score negated, whether the key is missing, and the key.
_Found = tuple[int, bool, object]


def _rescored(block: _Block, bounds: np.ndarray, weights: np.ndarray, best: list[_Found], number: int) -> list[_Found]:
    """The best documents after those of a block whose bounds reach them, by descending bound."""
    rows = np.flatnonzero(bounds >= (-best[-1][0] if len(best) == number else 1))
    rows = rows[np.argsort(-bounds[rows], kind="stable")]
    start, step = 0, FIRST_STEP
    while start < len(rows):
        lowest = -best[-1][0] if len(best) == number else 1
        if bounds[rows[start]] < lowest:
            break
        some = rows[start : start + step]
        scores = block.scores(some, weights)
        taken = [
            (-int(scores[i]), block.keys[some[i]] is None, block.keys[some[i]] if block.keys[some[i]] is not None else 0)
            for i in np.flatnonzero(scores >= lowest)
        ]
        if taken:
            best = sorted([*best, *taken])[:number]
        start, step = start + step, 2 * step
    return best


def _search(batches: Iterator[pa.RecordBatch], queries: _Queries, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    coordinates = (queries.terms % np.uint64(COORDINATES)).astype(np.int64)
    best: list[list[_Found]] = [[] for _ in queries.queries]
    weights = np.zeros(len(queries.terms), np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = _Block(batch.slice(start, BLOCK), queries)
            for number, terms in enumerate(queries.queries):
                own = queries.weights[terms]
                bounds = block.bounds(coordinates[terms], own.astype(np.float64))
                weights[terms] = own
                best[number] = _rescored(block, bounds, weights, best[number], queries.best)
                weights[terms] = 0
    found = [(number, None if missing else key, -score) for number, some in enumerate(best) for score, missing, key in some]
    for start in range(0, len(found), 10_000):
        number, key, score = zip(*found[start : start + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(key, key_type), pa.array(score, pa.int64())], ["query", "key", "score"]
        )


def term_weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def _ranked(index: LexicalIndex, items: DataFrame, best: int) -> DataFrame:
    """Best documents of the items of one batch, whose terms are collected."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = items.select("key", "terms").collect()
    hashes = [np.frombuffer(bytes(row.terms), "<u8") for row in rows]
    terms = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    wanted = [np.searchsorted(terms, own) for own in hashes]
    queries = _Queries(terms, np.zeros(len(terms), np.int64), wanted, index.documents, index.terms, best)
    counted = index.rows.select("terms").mapInArrow(
        partial(_document_counts, queries=queries), "term long, documents long"
    )
    holding = np.zeros(len(terms), np.int64)
    for term, documents in counted.groupBy("term").agg(F.sum("documents")).collect():
        holding[term] = documents
    weights = np.array([term_weight(index.documents, int(n)) for n in holding], np.int64)
    queries = _Queries(terms, weights, wanted, index.documents, index.terms, best)
    kind = index.rows.schema["key"].dataType
    found = index.rows.select("key", "length", "terms", "times", "sketch").mapInArrow(
        partial(_search, queries=queries, key_type=to_arrow_type(kind)), f"query int, key {kind.simpleString()}, score long"
    )
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)
    names = items.sparkSession.createDataFrame(
        [(number, row.key) for number, row in enumerate(rows)], f"query int, item {items.schema['key'].dataType.simpleString()}"
    )
    return ranked.join(F.broadcast(names), "query").select("item", "rank", "key", "score")


def search(
    index: LexicalIndex,
    queries: DataFrame,
    key: str = "item_id",
    text: str = "text",
    best: int = BEST,
    batch_terms: int = BATCH_TERMS,
) -> DataFrame:
    """``item``, ``rank`` from 1, ``key`` and ``score`` of the best documents of every query; stores the queries' terms at call."""
    rows, seen = _indexed(queries.select(F.col(f"`{key}`"), F.col(f"`{text}`")).distinct(), key, text, "lexical-queries")
    batches = max(1, math.ceil(seen.get["distinct"] / batch_terms))
    worded = rows.filter(F.col("length") > 0)
    dealt = F.pmod(F.xxhash64("terms"), F.lit(batches))
    parts = [_ranked(index, worded.filter(dealt == batch), best) for batch in range(batches)]
    return reduce(DataFrame.unionByName, parts)


def search_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item."""
    found = search(build_index(docs), benchmark)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")
