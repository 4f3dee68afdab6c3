"""Product codes: brute force, the curve, the short lists, and the cases of every operator."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from sensorloom.llm import vector_codes
from sensorloom.llm.hilbert import hilbert_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, rounds=4, parts=4, entries=256):
    """Codes as (vec_id, code, error, label_error, digest) by comparing all points with all entries."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    points = np.floor(np.array([r[1] for r in kept], dtype=np.float32).astype(np.float64) * 1024).astype(np.int64)
    codes, errors, shown = [], np.zeros(len(kept), np.int64), []
    for part in np.split(points, parts, axis=1):
        book = part[:entries].copy()
        for step in range(rounds + 1):
            distance = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            nearest = distance.argmin(axis=1)
            for entry in range(len(book)) if step < rounds else ():
                own = part[nearest == entry]
                if len(own):
                    book[entry] = own.sum(axis=0) // len(own)
        codes.append(nearest)
        errors += distance.min(axis=1)
        shown += book.ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, shown)).encode()).hexdigest()
    by_label = {}
    for row, error in zip(kept, errors, strict=True):
        by_label[row[2]] = by_label.get(row[2], 0) + int(error)
    return sorted(
        ((r[0], "".join(f"{c[i]:02x}" for c in codes), int(errors[i]), by_label[r[2]], digest) for i, r in enumerate(kept)),
        key=str,
    )


def made(number=700, width=16, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, width))
    values = (centres[draw.integers(0, 9, number)] + draw.normal(size=(number, width)) / 5).astype(np.float32)
    return [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(values)]


def coded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in vector_codes.vector_code_digest(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = made()
    bad = [(2_000, None, 1), (2_001, [math.nan] * 16, 1), (2_002, [math.inf] + [0.0] * 15, 1), (2_003, [None] * 16, 2), (2_004, [], 1)]
    assert coded(spark, rows + bad) == plainly(rows + bad)


def test_repeated_rows_and_a_common_vector(spark):
    rows = made(300)
    rows += [(1_000 + i, rows[7][1], 1) for i in range(200)] + [rows[3]] * 50
    assert coded(spark, rows) == plainly(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(x) for x in point] * 2, 0) for i, point in enumerate(itertools.product((0, 1), repeat=4))]
    rows += [(100 + i, [0.5] * 8, 0) for i in range(20)]
    assert coded(spark, rows) == plainly(rows)


def test_fewer_vectors_than_entries_and_missing_keys(spark):
    rows = [(3, [1.0, -2.0, 3.0, 4.0], 1), (None, [0.5, 0.25, -1.0, 8.0], None), (1, [0.0, 0.0, 0.0, 0.0], None)]
    assert coded(spark, rows) == plainly(rows)


def test_other_lengths_are_left_out(spark):
    rows = [(2, [1.0] * 8, 0), (1, [1.0] * 6, 0), (3, [1.0] * 4, 0), (4, [2.0] * 8, 0)]
    assert [row[0] for row in coded(spark, rows)] == [2, 4]


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float(2**20 + 3 * i), float(-i), 0.0, 1.0], 0) for i in range(30)]
    assert coded(spark, rows) == plainly(rows)
    with pytest.raises(Exception, match="31 bits"):
        coded(spark, [(1, [1e30, 0.0, 0.0, 0.0], 0)])


def test_empty_tables(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []


def test_extra_columns_and_shuffled_labels(spark):
    rows = made(100, width=8)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", key string, place string")
    whole = sorted((tuple(r) for r in vector_codes.vector_code_digest(df, broadcast_rows=0).collect()), key=str)
    assert whole == plainly(rows)


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (4, 2), (2, 1)])
def test_the_curve_visits_neighbours(axes, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = hilbert_index(points, bits)
    assert sorted(place) == list(range(len(points)))
    assert set(np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1)) == {1}


def test_short_lists_lose_no_nearest_entry():
    draw = np.random.default_rng(1)
    entries = draw.integers(-50, 50, (40, 3))
    shorter = 0
    for _ in range(200):
        points = draw.integers(-60, 60, 3) + draw.integers(0, 12, (20, 3))
        listed = vector_codes.short_lists(points.min(axis=0)[None], points.max(axis=0)[None], entries)[0]
        distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert listed[np.unique(np.nonzero(distance == distance.min(axis=1)[:, None])[1])].all()
        shorter += listed.sum() < 20
    assert shorter > 150


def test_kernel_is_exact_in_whole_numbers():
    points, entries = np.array([[2**28, -3]]), np.array([[-(2**28), 5]])
    assert vector_codes.squared_distances(points, entries, 2**28)[0, 0] == 2**58 + 64
    with pytest.raises(OverflowError):
        vector_codes.squared_distances(points, entries, 2**31)
