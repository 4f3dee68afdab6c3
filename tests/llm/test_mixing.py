from collections import defaultdict

import pytest

from sensorloom.llm import mixing
from tests.llm.build import documents, edge_rows, empty_documents


def water_filled(sizes, weights, most):
    """Targets by resharing until none is above its limit."""
    total, targets, full = sum(sizes), [0.0] * len(sizes), set()
    left = float(total)
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        if not open_weight:
            return targets
        level = left / open_weight
        above = [i for i in range(len(sizes)) if i not in full and level * weights[i] > most * sizes[i]]
        if not above:
            for i in range(len(sizes)):
                if i not in full:
                    targets[i] = level * weights[i]
            return targets
        for i in above:
            targets[i] = most * sizes[i]
            left -= targets[i]
            full.add(i)


def test_targets_reshare_the_excess(spark):
    rows, sizes = [], {"a": 500, "b": 2, "c": 30, "d": 40, "z": 1}
    key = 0
    for source, words in sizes.items():
        for part in range(2 if words > 1 else 1):
            rows.append((key, " ".join(["w"] * (words // 2 if words > 1 else 1)), "en", source))
            key += 1
    rows.append((99, "w w w", "en", None))
    found = mixing.plan_mix(documents(spark, rows)).collect()
    names = [*sorted(sizes), None]
    source_of = {r[0]: r[3] for r in rows}
    expected = dict(zip(names, water_filled([*(sizes[n] for n in names[:-1]), 3], [1, 2, 3, 1, 2, 3], 3), strict=True))
    taken = defaultdict(int)
    for row in found:
        source = source_of[row.doc_id]
        assert row.target == pytest.approx(expected[source])
        assert sum(c.taken for c in row.copies) <= 3 * row.size
        taken[source] += sum(c.taken for c in row.copies)
    for source, words in taken.items():
        assert abs(words - expected[source]) <= 1


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(600)]
    found = mixing.mix(documents(spark, rows), weights=(1, 1, 1)).select("source", "position").collect()
    early = {s: sum(r.position < 0.5 for r in found if r.source == s) / sum(r.source == s for r in found) for s in "abc"}
    # Rates 1.5 to 0.5, 1 and 0.5 to 1.5 put 5/8, 4/8 and 3/8 of the words into the first half.
    assert early == pytest.approx({"a": 5 / 8, "b": 1 / 2, "c": 3 / 8}, abs=0.01)


def test_mix_is_sorted_and_keeps_columns(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns)
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert {r.text for r in rows} <= {t for _, t, _, _ in edge_rows() if t and t.split()}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_every_document_has_one_row(spark):
    found = mixing.mix_digest(documents(spark)).collect()
    assert len(found) == len(edge_rows())
    assert all(r.taken == 0 and r.first_position is None for r in found if r.size == 0)


def test_empty_table(spark):
    assert mixing.mix_digest(empty_documents(spark)).count() == 0
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_equal_rows_are_counted_and_told_apart(spark):
    """A third of all rows are equal; they are told apart a few at a time, and no array holds them all."""
    rows = [(i, f"some words of {i}", "en", "ab"[i % 2]) for i in range(200)]
    rows += [(None, "one text that stands here often", "en", "a")] * 150
    docs = documents(spark, rows)

    def taken(equal_rows):
        plan = mixing.plan_mix(docs, equal_rows=equal_rows).collect()
        copies = mixing.mix(docs, equal_rows=equal_rows).select("doc_id", "source", "epoch", "position").collect()
        shown = sorted(repr((r.doc_id, r.size, r.target, [(c.epoch, c.taken, round(c.position, 9)) for c in r.copies])) for r in plan)
        return shown, sorted(repr((r.doc_id, r.source, r.epoch, round(r.position, 9))) for r in copies)

    whole, dealt = taken(10_000), taken(7)
    assert whole == dealt and len(whole[0]) == len(rows)
    places = [float(row.split(", ")[-1][:-1]) for row in whole[1] if row.startswith("(None")]
    assert len(set(places)) == len(places) > 20


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.plan_mix(documents(spark, [(i, "word", "en", f"s{i}") for i in range(5)]))
