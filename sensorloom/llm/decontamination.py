"""Benchmark decontamination: passages of test items found in documents of any length.

Every run of ``n`` consecutive words of an item is a window; an item with fewer words is one window. The windows'
hashes are broadcast. A document's words are scanned once: each run of words is hashed and looked up in a
bitmap of the benchmark's hashes, which lets less than one other run in a hundred pass; only what passes
leaves the row, meets the broadcast windows by hash, and is then verified word by word. Finding hits never
shuffles documents, only their identifiers and the verified hits. Removing documents broadcasts the identifiers of those that go; beyond
``BROADCAST_DOCUMENTS`` of them the documents, with their texts, are shuffled once.

The broadcast is bounded: beyond ``BROADCAST_WINDOWS`` windows the candidates meet them by a shuffle join, salted since a
common passage is in many documents, and the bitmap, which has a fixed largest size, only gets less selective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorloom.llm.common import apart, plain_words
from sensorloom.operators.ordered import lookup
from sensorloom.session import stored

WINDOW = 10
# Windows of the benchmark that are sent to every executor, about 300 bytes each.
BROADCAST_WINDOWS = 1_000_000
# Documents to remove whose identifiers and hashes are sent to every executor, some 50 bytes each.
BROADCAST_DOCUMENTS = 500_000
# Bits of the bitmap for each window, two of them set, and its size in bits at most (512 KB).
BITS_PER_WINDOW = 32
LARGEST_BITMAP = 1 << 22


def _run(words: Column, start: Column, length: int) -> list[Column]:
    return [F.get(words, start + k) for k in range(length)]


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``window`` (array of words), ``length``, ``hash`` and ``items`` (identifiers as text).

    NULL texts and texts without words have no window; a NULL identifier names no item.
    """
    words = benchmark.select(F.col(key).cast("string").alias("item"), plain_words(F.col(text)).alias("words"))
    last = F.greatest(F.size("words") - n, F.lit(0))
    windows = words.filter(F.size("words") > 0).select(
        "item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, n))).alias("window")
    )
    return windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        "window", F.size("window").alias("length"), F.xxhash64("window").alias("hash"), "items"
    )


def _slots(value: Column, bits: int) -> list[Column]:
    """The two bits of a hash."""
    low = F.lit(bits - 1).cast("long")
    return [value.bitwiseAND(low), F.shiftrightunsigned(value, 32).bitwiseAND(low)]


def _bitmap(windows: DataFrame, bits: int) -> Column:
    """The bits of all hashes as a constant array, 64 to a number. Its size is bounded."""
    slots = windows.select(F.explode(F.array(*_slots(F.col("hash"), bits))).alias("slot"))
    cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS INT))")).alias("bits")
    )
    found = dict(map(tuple, cells.collect()))
    shown = ",".join(str(found.get(cell, 0)) for cell in range(bits >> 6))
    return F.split(F.lit(shown), ",").cast("array<bigint>")


def _candidates(words: Column, length: int, bitmap: Column, bits: int) -> Column:
    """Runs of ``length`` words whose hash is in the bitmap, as structs of place, hash and words."""

    def listed(value: Column) -> Column:
        first, second = (
            F.getbit(
                F.get(bitmap, F.shiftright(slot, 6).cast("int")),
                slot.bitwiseAND(F.lit(63).cast("long")).cast("int"),
            )
            == 1
            for slot in _slots(value, bits)
        )
        return first & second

    places = F.sequence(F.lit(0), F.size(words) - length)
    hashes = F.transform(places, lambda i: F.xxhash64(F.array(*_run(words, i, length))))
    passed = F.filter(
        F.transform(hashes, lambda h, i: F.when(listed(h), F.struct(i.alias("place"), h.alias("hash")))),
        lambda c: c.isNotNull(),
    )
    runs = F.transform(
        passed,
        lambda c: F.struct(
            c.getField("place").alias("place"),
            c.getField("hash").alias("hash"),
            F.array(*_run(words, c.getField("place"), length)).alias("run"),
        ),
    )
    return F.when(F.size(words) >= length, runs)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Documents as (``_id``, ``_digest``, ``n_words``), one row each, and their verified hits as (``_id``,
    ``_digest``, ``place``, ``length``, ``items``), distinct."""
    windows = stored(benchmark_windows(benchmark, n), "benchmark-windows")
    by_length = windows.groupBy("length").count().collect()  # n rows at most
    count = sum(row["count"] for row in by_length)
    bits = 1 << 12
    while bits < min(count * BITS_PER_WINDOW, LARGEST_BITMAP):
        bits *= 2
    bitmap = _bitmap(windows, bits)
    scanned = docs.select(
        F.col(key).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_digest"),
        plain_words(F.col(text)).alias("_words"),
    )
    rows = scanned.select("_id", "_digest", F.size("_words").cast("long").alias("n_words"), "_words")
    empty = F.array().cast("array<struct<place:int,hash:bigint,run:array<string>>>")
    runs = [F.coalesce(_candidates(F.col("_words"), row["length"], bitmap, bits), empty) for row in by_length]
    found = rows.select("_id", "_digest", "n_words", (F.concat(*runs) if runs else empty).alias("_runs"))
    found = stored(found, "benchmark-candidates")
    candidates = found.select("_id", "_digest", F.explode("_runs").alias("_run")).select("_id", "_digest", "_run.*")
    met = lookup(candidates, windows.drop("length"), ["hash"], "inner", count <= BROADCAST_WINDOWS, salted=True)
    hits = met.filter(F.col("run") == F.col("window")).withColumn("length", F.size("run"))
    return found.drop("_runs"), hits.select("_id", "_digest", "place", "length", "items").distinct()


def _covered(intervals: Column) -> Column:
    """Number of places in a union of [place, place + length)."""

    def add(state: Column, one: Column) -> Column:
        end = one.getField("place") + one.getField("length")
        more = F.greatest(end - F.greatest(one.getField("place"), state.getField("end")), F.lit(0))
        return F.struct((state.getField("n") + more).alias("n"), F.greatest(end, state.getField("end")).alias("end"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(F.sort_array(intervals), start, add, lambda state: state.getField("n"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: the key, ``n_words``, ``n_hit`` (words inside a window), ``items`` (sorted identifiers
    as text), ``spans`` (sorted place and length of the windows found) and ``_digest``, the text's hash.

    NULL texts have no words and no hits; rows with the same key and text get the same result.
    """
    rows, hits = find_hits(docs, benchmark, n, key, text)
    grouped = hits.groupBy("_id", "_digest").agg(
        F.sort_array(F.collect_set(F.struct("place", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    same = rows["_id"].eqNullSafe(grouped["_id"]) & (rows["_digest"] == grouped["_digest"])
    none = F.array().cast("array<struct<place:int,length:int>>")
    spans = F.coalesce(grouped["spans"], none)
    return rows.join(grouped, same, "left").select(
        rows["_id"].alias(key),
        rows["_digest"],
        "n_words",
        _covered(spans).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        spans.alias("spans"),
    )


def remove_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    most_hit: float = 0.0,
    n: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents of whose words a share of at most ``most_hit`` lies in benchmark windows, columns unchanged."""
    bad = contamination(docs, benchmark, n, key, text).filter(F.col("n_hit") > most_hit * F.col("n_words"))
    bad, seen = bad.select(F.col(key).alias("id"), F.col("_digest").alias("digest")).distinct(), Observation()
    bad = stored(bad.observe(seen, F.count(F.lit(1)).alias("documents")), "contaminated")
    rows = apart(docs, id=F.col(key), digest=F.xxhash64(F.coalesce(text, F.lit(""))))
    few = seen.get["documents"] <= BROADCAST_DOCUMENTS
    return lookup(rows, bad, ["id", "digest"], "left_anti", few, salted=True).select("row.*")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
