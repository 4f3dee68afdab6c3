import pytest
from pyspark.sql import functions as F

from sensorloom.llm import sharding
from tests.llm.build import documents, edge_rows, empty_documents


def check(rows, shards):
    slots = {}
    for row in rows:
        assert 0 <= row.shard < shards
        slots.setdefault(row.shard, []).append(row.slot)
    for numbers in slots.values():
        assert sorted(numbers) == list(range(len(numbers)))


def test_splitters_match_running_bytes(spark):
    texts = [(i, f"text {i * 7919 % 1000} " * (1 + i % 13), "en", "a") for i in range(700)]
    copies = [(1000 + i, "the same text of all " * 9, "en", "b") for i in range(350)]
    docs = documents(spark, texts + copies)
    keys = sharding.keyed(docs)
    found = sharding.find_splitters(keys, 7)
    ordered = sorted(keys.collect(), key=lambda r: (r._text_key, r._id_key))
    total, before = sum(r._size for r in ordered), 0
    rows = sharding.shard_documents(docs, 7).collect()
    shard_of = {sharding_key(r): r.shard for r in rows}
    for row in ordered:
        expected = min(6, before * 7 // total)
        assert sum((row._text_key, row._id_key) >= s for s in found) == expected
        before += row._size
    check(rows, 7)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(7)]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest
    # The group of equal texts is cut, but its shards are neighbours.
    group = sorted({shard_of[i] for i, *_ in copies})
    assert group == list(range(group[0], group[-1] + 1))


def sharding_key(row):
    return row.doc_id


def test_tolerance_stops_early(spark):
    docs = documents(spark, [(i, f"t{i} " * 20, "en", "a") for i in range(400)])
    keys = sharding.keyed(docs)
    loose = sharding.find_splitters(keys, 4, tolerance=0.2)
    total = sum(r._size for r in keys.collect())
    for number, splitter in enumerate(loose, 1):
        before = sum(r._size for r in keys.collect() if (r._text_key, r._id_key) < splitter)
        assert abs(before - number * total / 4) <= 0.2 * total / 4


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_edge_rows(spark, shards):
    docs = documents(spark)
    rows = sharding.shard_documents(docs, shards).collect()
    assert len(rows) == len(edge_rows())
    check(rows, shards)
    sizes = {r.doc_id: r["size"] for r in rows}
    assert sizes[3] == 16 and sizes[8] == 16 + len("\U0001f600 \U0001f600 astral words \U0001f600".encode())
    assert set(rows[0].asDict()) == set(docs.columns)


def test_empty_table(spark):
    assert sharding.shard_documents(empty_documents(spark)).count() == 0
    assert sharding.shard_digest(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("equal_rows", [100, 10_000])
def test_no_cell_takes_the_rows_without_identifier(spark, equal_rows):
    rows = [(i if i % 3 else None, f"text {i} of many", "en", "a") for i in range(9_000)]
    rows += [(None, None, None, None)] * 3_000 + [(5, "one text", "en", "a")] * 1_500
    docs = documents(spark, rows)
    stored_rows = sharding.stored(sharding.keyed(docs.repartition(6)).withColumn("_dealt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))), "t")
    celled = sharding._celled(stored_rows, len(rows), 1, equal_rows).groupBy("_cell").count().collect()
    mean = len(rows) / len(celled)
    if equal_rows == 100:
        assert max(r["count"] for r in celled) <= 2 * mean
    placed = sharding.shard_documents(docs, 3, equal_rows=equal_rows).collect()
    assert len(placed) == len(rows)
    check(placed, 3)


def test_missing_identifiers_alone_need_no_dealing(spark):
    rows = [(i if i % 3 else None, f"text {i}", "en", "a") for i in range(9_000)]
    keys = sharding.keyed(documents(spark, rows))
    cells = keys.groupBy(sharding.cell_of(20).alias("cell")).count().collect()
    assert len(cells) == 20 and max(r["count"] for r in cells) <= 2 * 9_000 / 20
