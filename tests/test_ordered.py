import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import wall_micros
from sensorloom.operators import ordered as ordered_module
from sensorloom.operators.ordered import GroupSizes, OrderedGroups, by_size, lookup, measure_cells, measure_groups
from sensorloom.session import (
    CHECKPOINT_SETTING,
    refuse_machine_local,
    released_copies,
    scratch_path,
    shared_folder,
    stored,
)


def rows_of(spark, seed=0):
    rng = random.Random(seed)
    keys = ["hot"] * 60 + [None] * 40 + ["a"] * 3 + ["b"]
    data = [(key, rng.randrange(25), i, rng.choice([None, i])) for i, key in enumerate(keys)]
    return data, spark.createDataFrame(data, "k string, t int, seq int, v int").withColumn(
        "empty", F.lit(None).cast("int")
    )


def test_group_sizes(spark):
    _, df = rows_of(spark)
    sizes = measure_groups(df, ["k"], 10)
    assert sizes.groups == 4
    assert sorted(str(r["k"]) for r in sizes.hot.collect()) == ["None", "hot"]
    assert sizes.chunks == 20
    assert measure_groups(df, ["k"], 100).hot is None


@pytest.mark.parametrize("hot_rows", [3, 10, 1000])
@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "shuffle_chunks": 4}])
def test_sequence_columns(spark, hot_rows, limits):
    data, df = rows_of(spark)

    def work(part, hot):
        return (
            OrderedGroups.of(part, ["k"], ["t", "seq"], hot)
            .running_total(F.col("seq"), "before", "total")
            .previous_row(prev="seq", prev_v="v")
            .last_seen(seen="v", none="empty")
            .group_max(F.col("v"), "largest")
            .rows.select(
                "seq", "before", "total", "prev", "prev_v", "seen", "none", "largest"
            )
        )

    found = by_size(df, ["k"], measure_groups(df, ["k"], hot_rows, **limits), work).collect()
    expected = {}
    for key in {row[0] for row in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        total = sum(r[2] for r in group)
        largest = max((r[3] for r in group if r[3] is not None), default=None)
        before, prev, prev_v, seen = 0, None, None, None
        for _, _, seq, v in group:
            seen = v if v is not None else seen
            expected[seq] = (before, total, prev, prev_v, seen, None, largest)
            before, prev, prev_v = before + seq, seq, v
    assert {row[0]: tuple(row[1:]) for row in found} == expected


@pytest.mark.parametrize("shuffle_chunks", [5_000, 12, 7])
def test_chunks_of_a_hot_group_are_bounded(spark, shuffle_chunks):
    df = spark.range(20_000).select(F.lit("x").alias("k"), F.col("id").alias("t"))
    sizes = measure_groups(df, ["k"], 1000, shuffle_chunks=shuffle_chunks)
    ordered = OrderedGroups.of(df, ["k"], ["t"], sizes)
    chunks = ordered.rows.groupBy("_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")
    )
    found = chunks.orderBy("_chunk").collect()
    assert len(found) >= 20 and max(r["n"] for r in found) <= 2000
    assert sum(r["n"] for r in found) == 20_000
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))


def test_chunks_follow_the_rows_without_a_cap(spark):
    sizes = GroupSizes(1, 10**13, 5_000_000, hot_groups=1, hot_total=10**13)
    assert sizes.chunks == 4_000_000


def test_hot_keys_are_a_table(spark, monkeypatch):
    _, df = rows_of(spark)
    collected = []
    plain = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(self) or plain(self))
    sizes = measure_groups(df, ["k"], 10)
    assert not collected
    assert all(CHECKPOINT_SETTING and "sensorloom-" in name for name in sizes.hot.inputFiles())


def test_salted_lookup_gives_the_same_rows(spark):
    _, df = rows_of(spark)
    table = df.groupBy("k").agg(F.max("seq").alias("most"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain, salted = (lookup(df, table.filter("most > 70"), ["k"], how, salted=s) for s in (False, True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_copies_are_released(spark):
    def copies():
        folder = Path(shared_folder(spark)) / f"sensorloom-{spark.sparkContext.applicationId}"
        return {p.name for p in folder.glob("*")} if folder.exists() else set()

    before = copies()
    with released_copies(spark):
        outer = stored(spark.range(5), "outer")
        with released_copies(spark):
            assert stored(spark.range(3), "inner").count() == 3
        assert outer.count() == 5 and len(copies() - before) == 1
    assert copies() == before
    kept = stored(spark.range(2), "kept")
    assert kept.count() == 2 and len(copies() - before) == 1


def test_cluster_refuses_a_folder_of_one_machine(spark):
    with pytest.raises(ValueError, match="one machine"):
        refuse_machine_local(spark, "file:///tmp/x")


def test_cluster_takes_a_local_path_that_all_machines_share(cluster, monkeypatch):
    folder = cluster.conf.get(CHECKPOINT_SETTING)
    assert shared_folder(cluster) == folder
    assert stored(cluster.range(5), "numbers").count() == 5
    own = Path(folder) / f"sensorloom-{cluster.sparkContext.applicationId}"
    assert not list(own.glob("trial-*"))
    # It is tried once.
    monkeypatch.setattr(type(cluster), "range", None)
    assert shared_folder(cluster) == folder


def test_cluster_refuses_a_local_path_that_lacks_the_files_of_a_task(cluster, monkeypatch):
    plain = type(cluster.range(1)).inputFiles
    monkeypatch.setattr(type(cluster.range(1)), "inputFiles", lambda self: plain(self)[1:])
    for _ in range(2):
        with pytest.raises(ValueError, match="one machine"):
            shared_folder(cluster)


def test_stored_rows_are_in_the_named_folder(spark):
    folder = spark.conf.get(CHECKPOINT_SETTING)
    assert shared_folder(spark) == folder
    path = scratch_path(spark, "x")
    assert path.startswith(folder) and spark.sparkContext.applicationId in path
    df = stored(spark.range(5), "numbers")
    assert df.count() == 5
    assert all(name.startswith(f"file://{folder}") for name in df.inputFiles())


def test_cluster_needs_a_named_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    session = SimpleNamespace(sparkContext=Context(), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match=CHECKPOINT_SETTING):
        shared_folder(session)


def timed(spark, seconds):
    """Rows of one group at the given seconds of a day, in order of time and number."""
    data = [("x", i, s) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(data, "k string, seq int, s double")
    ts = F.lit("2017-06-17").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))
    return df.withColumn("t", ts)


BURST = [i * 40.0 for i in range(2_000)] + [5_000 + i / 1_000 for i in range(3_000)]


def test_time_cells_are_bounded_and_cut_alike(spark):
    df = timed(spark, BURST)
    sizes = measure_groups(df, ["k"], 200)
    found = measure_cells(df, ["k"], "t", sizes)
    assert found.dense is None and found.widths.collect()[0]["_width"] == 1_000
    ordered = OrderedGroups.of(df, ["k"], ["t", "seq"], sizes)
    cells = ordered.rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    cells = cells.orderBy("_chunk").collect()
    assert sum(r["n"] for r in cells) == len(BURST) and max(r["n"] for r in cells) <= 200
    assert len(cells) == found.cells
    assert all(a["high"] < b["low"] for a, b in zip(cells, cells[1:]))
    again = OrderedGroups.of(df.repartition(7), ["k"], ["t", "seq"], sizes).rows
    assert ordered.rows.exceptAll(again).isEmpty() and again.exceptAll(ordered.rows).isEmpty()


@pytest.mark.parametrize("seconds", [BURST, [60.0] * 900 + [float(i) for i in range(1_000)]])
def test_running_total_over_time_cells(spark, seconds):
    """The second list has more rows at one instant than a chunk may have."""
    df = timed(spark, seconds)
    sizes = measure_groups(df, ["k"], 200)
    rows = OrderedGroups.of(df, ["k"], ["t", "seq"], sizes).running_total(F.lit(1).cast("long"), "before", "total").rows
    found = [(r["s"], r["seq"]) for r in sorted(rows.collect(), key=lambda r: r["before"])]
    assert found == sorted((s, i) for i, s in enumerate(seconds))
    assert rows.agg(F.count_distinct("before"), F.min("total")).first()[0] == len(seconds)


def test_time_cells_take_one_shuffle_of_rows_and_no_copy(spark, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "rows")
    timed(spark, BURST).write.parquet(path)
    df = spark.read.parquet(path)
    copies = []
    plain = ordered_module.stored
    monkeypatch.setattr(ordered_module, "stored", lambda df, label, **k: copies.append(label) or plain(df, label, **k))
    sizes = measure_groups(df, ["k"], 50, shuffle_chunks=2)
    rows = OrderedGroups.of(df, ["k"], ["t", "seq"], sizes).running_total(F.lit(1).cast("long"), "before").rows
    assert set(copies) == {"hot-keys", "cells"}
    capsys.readouterr()
    rows.explain()
    text = capsys.readouterr().out
    assert "rangepartitioning" not in text
    by_cell = [line for line in text.splitlines() if "Exchange hashpartitioning(k" in line and "_chunk" in line]
    # The rows once, and the counts of the cells.
    assert len(by_cell) == 2


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = timed(spark, [0.5, 59.999999, 86_399.000001])
    plain = [r[0] for r in df.orderBy("seq").select(wall_micros(F.col("t"))).collect()]
    assert [v - plain[0] for v in plain] == [0, 59_499_999, 86_398_500_001]
