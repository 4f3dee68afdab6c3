"""Line removal: brute force, skewed keys, and the cases of every operator."""

import random

import pytest

from sensorloom.llm import line_dedup
from tests.llm.build import documents, edge_rows, empty_documents

SPACES = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plainly(rows, documents=2, keep_first=True):
    """(doc_id, n_lines, n_dropped, text) of (doc_id, text)."""
    holders = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= 10:
                holders.setdefault(plain_key(line), set()).add(key)
    first = {line: min(found, key=lambda k: (k is None, k or 0)) for line, found in holders.items()}
    result = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if len(holders.get(plain_key(line), ())) < documents or (keep_first and first[plain_key(line)] == key)
        ]
        left = None if text is None else "\n".join(kept)
        result.append((key, len(lines), len(lines) - len(kept), left))
    return result


def found(df):
    return sorted(map(repr, df.select("doc_id", "n_lines", "n_dropped", "text").collect()))


def expected(rows, **settings):
    from pyspark.sql import Row

    make = Row("doc_id", "n_lines", "n_dropped", "text")
    return sorted(repr(make(*row)) for row in plainly(rows, **settings))


def made(seed=5, number=60):
    draw = random.Random(seed)
    pool = [f"Common line number {i} of the pool" for i in range(12)] + ["short", "", "  ", "ÉTÉ LONG LINE été"]
    rows = [(1, "the everywhere line")]
    for key in range(number):
        lines = [draw.choice(pool) for _ in range(draw.randrange(6))] + [f"own line of {key} only"]
        lines += [draw.choice(["The Everywhere Line", "\tthe everywhere line\r"])]
        draw.shuffle(lines)
        rows.append((draw.choice([key, key // 2, None]), "\n".join(lines)))
    return rows + rows[:10]


@pytest.mark.parametrize("hot_lines, broadcast_keys", [(1_000, 1_000), (5, 1_000), (5, 0)])
def test_against_brute_force_with_any_plan(spark, hot_lines, broadcast_keys):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = line_dedup.dedup_lines(df, hot_lines=hot_lines, broadcast_keys=broadcast_keys)
    assert found(clean) == expected(rows)


def test_threshold_and_no_first(spark):
    rows = made(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = line_dedup.dedup_lines(df, documents=4, keep_first=False)
    assert found(clean) == expected(rows, documents=4, keep_first=False)


def test_edge_rows_keep_their_columns(spark):
    rows = [(i, t) for i, t, _, _ in edge_rows()]
    docs = documents(spark)
    clean = line_dedup.dedup_lines(docs)
    assert found(clean) == expected(rows)
    assert set(docs.columns) <= set(clean.columns)
    assert clean.filter("slot = 'x'").count() == len(rows)


def test_one_document_repeating_itself_keeps_all(spark):
    df = spark.createDataFrame([(1, "the same line here\n" * 3), (1, "the same line here")], "doc_id long, text string")
    assert {row.n_dropped for row in line_dedup.dedup_lines(df).collect()} == {0}


def test_many_lines_of_one_text(spark):
    text = "\n".join(f"a line with number {i}" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nand its own line")], "doc_id long, text string")
    rows = {row.doc_id: row for row in line_dedup.dedup_lines(df).collect()}
    assert (rows[1].n_dropped, rows[2].n_dropped, rows[2].text) == (0, 40_000, "and its own line")


def test_empty_table(spark):
    clean = line_dedup.dedup_lines(empty_documents(spark))
    assert clean.count() == 0
    assert line_dedup.line_dedup_digest(empty_documents(spark)).count() == 0


def test_digest_has_no_python(spark):
    plan = line_dedup.line_dedup_digest(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
