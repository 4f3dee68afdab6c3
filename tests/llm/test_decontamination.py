import random
import re

import pytest

from sensorloom.llm import decontamination
from tests.llm.build import documents, edge_rows, empty_documents

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(texts, items, n=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    found = []
    for text in texts:
        words, hit, named = words_of(text), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                if (run := tuple(words[i : i + length])) in windows:
                    hit |= set(range(i, i + length))
                    named |= windows[run]
        found.append((len(words), len(hit), sorted(str(i) for i in named if i is not None)))
    return found


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def items():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    long = [(i, " ".join(pick.choice(vocabulary) for _ in range(14))) for i in range(20)]
    short = [(100, "Alpha, beta GAMMA!"), (101, "W1 w2"), (102, "alpha beta gamma")]
    return long + short + [(103, None), (104, ""), (105, "..."), (None, "unnamed item of words")]


def test_matches_brute_force(spark, items):
    pick = random.Random(4)
    vocabulary = [f"W{i}" for i in range(6)]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 80))) for _ in range(60)]
    texts += [f"before {items[0][1]} after, {items[0][1]}", "x alpha-beta gamma", "an unnamed item of words", None, "", "§ é"]
    docs = documents(spark, [(i, text, "en", "a") for i, text in enumerate(texts)])
    rows = {r.doc_id: r for r in decontamination.contamination(docs, table(spark, items)).collect()}
    for i, (n_words, n_hit, named) in enumerate(expected(texts, items)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n_words, n_hit, named), texts[i]


def test_without_broadcast(spark, items, monkeypatch):
    docs = documents(spark)
    some = table(spark, [*items, (200, "fox jumps over the lazy dog")])
    as_is = decontamination.contamination_digest(docs, some).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontamination, "LARGEST_BITMAP", 1 << 12)
    assert sorted(map(str, decontamination.contamination_digest(docs, some).collect())) == sorted(map(str, as_is))


def test_removal_with_and_without_broadcast(spark, items, monkeypatch):
    docs = documents(spark, [(i % 7, f"before {items[i % 3][1]} after" if i % 2 else f"clean text {i}", "en", "a") for i in range(40)])

    def kept():
        return sorted(str(r.text) for r in decontamination.remove_documents(docs, table(spark, items)).collect())

    plain = kept()
    monkeypatch.setattr(decontamination, "BROADCAST_DOCUMENTS", 0)
    assert kept() == plain == sorted(f"clean text {i}" for i in range(0, 40, 2))


def test_edge_rows(spark, items):
    some = table(spark, [*items, (200, "fox jumps over the lazy dog")])
    docs = documents(spark)
    rows = decontamination.contamination(docs, some).collect()
    assert len(rows) == len(edge_rows())
    by_text = {text: found for (_, text, _, _), found in zip(edge_rows(), expected([t for _, t, _, _ in edge_rows()], [*items, (200, "fox jumps over the lazy dog")]), strict=True)}
    hits = sorted((r.n_words, r.n_hit) for r in rows)
    assert hits == sorted((by_text[t][0], by_text[t][1]) for _, t, _, _ in edge_rows())
    kept = decontamination.remove_documents(docs, some)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(str(t) for _, t, _, _ in edge_rows() if not by_text[t][1])


def test_empty_tables(spark, items):
    assert decontamination.contamination_digest(empty_documents(spark), table(spark, items)).count() == 0
    none = decontamination.contamination_digest(documents(spark), table(spark, [])).collect()
    assert len(none) == len(edge_rows()) and not any(r.contaminated for r in none)
