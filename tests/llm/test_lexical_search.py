"""Ranked search: brute force in whole numbers, bounds, batches, and the cases of every operator."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sensorloom.llm import lexical_search
from tests.llm.build import documents, edge_rows, empty_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, best=10):
    counted = [(key, Counter(plain_terms(text))) for key, text in docs]
    number = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    holding = Counter(term for _, c in counted for term in c)
    result = []
    for item, text in set(items):
        scored = []
        for key, c in counted:
            score = 0
            for term in set(plain_terms(text)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * holding[term] + 1)))
                    m = 10 + 90 * sum(c.values()) * number // total
                    score += w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        result += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:best], 1)]
    return sorted(result, key=str)


def made(seed=2, number=300):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(draw.choices(words, k=int(draw.paretovariate(0.8) * 5) % 900))) for i in range(number)]
    docs += [(1_000 + i, docs[5][1]) for i in range(40)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 25)))) for i in range(15)] + [(99, docs[5][1]), (98, "zzz")]
    return docs, items


def searched(spark, docs, items, **settings):
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), **settings)
    return sorted((tuple(r) for r in found.select("item", "rank", "key", "score").collect()), key=str)


def test_against_brute_force(spark):
    docs, items = made()
    assert searched(spark, docs, items) == plainly(docs, items)


def test_batches_change_nothing(spark):
    docs, items = made(4)
    assert searched(spark, docs, items, batch_terms=20, best=3) == plainly(docs, items, best=3)


def test_edge_rows(spark):
    docs = [(i, t) for i, t, _, _ in edge_rows()] + [(None, "quick brown fox"), (None, "quick brown fox")]
    items = [(1, "Quick FOX word5x5 fox"), (2, None), (3, ""), (None, "identifier is"), (1, "astral \U0001f600"), (1, "astral \U0001f600")]
    assert searched(spark, docs, items) == plainly(docs, items)


def test_many_occurrences_pass_the_sketch(spark):
    docs = [(i, "common " * (200 + 20 * i) + "rare " * (i % 3)) for i in range(30)]
    items = [(1, "common"), (2, "rare common")]
    assert searched(spark, docs, items) == plainly(docs, items)


def test_extra_columns_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "fox", "x")], "item_id long, text string, score string")
    assert lexical_search.search_digest(documents(spark), items).count() > 0
    assert lexical_search.search_digest(empty_documents(spark), items).count() == 0
    assert lexical_search.search_digest(documents(spark), items.filter("item_id > 1")).count() == 0


def test_bounds_hold_and_spare_most_documents():
    docs, items = made(7, number=900)
    texts = pa.RecordBatch.from_arrays(
        [pa.array([key for key, _ in docs]), pa.array([text for _, text in docs])], ["key", "text"]
    )
    index = pa.Table.from_batches(lexical_search._forward([texts])).combine_chunks().to_batches()[0]
    rare = [lexical_search._counted([text.encode()])[1] for _, text in items]
    terms = np.unique(np.concatenate(rare))
    total = sum(len(plain_terms(text)) for _, text in docs)
    queries = lexical_search._Queries(terms, np.arange(len(terms)) + 1, [], len(docs), total, 10)
    block, spared = lexical_search._Block(index, queries), 0
    for own in rare:
        at = np.searchsorted(terms, own)
        weights = np.zeros(len(terms), np.int64)
        weights[at] = queries.weights[at]
        bounds = block.bounds((own % np.uint64(lexical_search.COORDINATES)).astype(np.int64), weights[at].astype(float))
        scores = block.scores(np.arange(len(docs)), weights)
        assert (bounds >= scores).all()
        spared += (bounds < np.sort(scores)[-10]).sum()
    assert spared > len(items) * len(docs) / 2
