import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import components, shingles, similarity
from tests.llm.build import documents, edge_rows, empty_documents
from tests.oracle import TESTDATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def expected(rows, threshold=0.8):
    """Class and number of links of each row, all rows compared with each other."""
    sets = [shingle_set(text) for _, text in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [(rows[find(i)][0], links[i]) for i in range(len(rows))]


def near_copies(count, length, changes, seed):
    pick = random.Random(seed)
    base = [f"b{seed}w{pick.randrange(10_000)}" for _ in range(length)]
    copies = []
    for _ in range(count):
        words = list(base)
        for _ in range(pick.randint(0, changes)):
            words[pick.randrange(length)] = f"new{pick.randrange(10**6)}"
        copies.append(" ".join(words))
    return copies


@pytest.fixture(scope="module")
def texts():
    found = near_copies(3, 60, 1, 1) + near_copies(2, 200, 6, 2) + near_copies(2, 100, 12, 3)
    # A group beyond a small node and a block, copies in it, and a passage that unrelated documents share.
    found += near_copies(90, 120, 2, 4)
    found += [found[0]] * 4 + [found[-1]] * 3
    passage = " ".join(f"p{i}" for i in range(60))
    found += [f"{' '.join(f'u{k}x{i}' for i in range(150))} {passage}" for k in range(60)]
    found += ["short one", "short one", "short", "", None, "   "]
    return found


@pytest.mark.parametrize(("block", "node"), [(256, 4096), (16, 40)])
def test_matches_brute_force(spark, texts, block, node, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "BLOCK_NODE", node)
    monkeypatch.setattr(similarity, "SKETCH_BLOCK", block)
    rows = list(enumerate(texts))
    docs = documents(spark, [(i, text, "en", "a") for i, text in rows])
    found = {r.doc_id: (r.class_id, r.n_links) for r in similarity.similarity_digest(docs).collect()}
    assert [found[i] for i, _ in rows] == expected(rows)


def test_blocks_at_the_last_level(spark, texts, monkeypatch):
    monkeypatch.setattr(similarity, "SMALL_NODE", 2)
    monkeypatch.setattr(similarity, "SKETCH_BLOCK", 10)
    rows = [(i, text) for i, text in enumerate(texts) if text]
    docs = documents(spark, [(i, text, "en", "a") for i, text in rows])
    found = {r.doc_id: (r.class_id, r.n_links) for r in similarity.near_duplicates(docs, levels=1).collect()}
    assert [found[i] for i, _ in rows] == expected(rows)


@pytest.mark.parametrize("threshold", [0.6, 0.4, 1.0])
def test_other_similarities_match_brute_force(spark, threshold):
    """Pairs around the threshold, of which a fixed share of the sketch would miss many."""
    found = []
    for k in range(60):
        base = [f"k{k}w{i}" for i in range(204)]
        # Sets of 200 shingles, of which a pair has so many in common.
        common = round(400 * threshold / (1 + threshold)) + k % 3 - 1
        found += [" ".join(base), " ".join([*base[: common + 4], *(f"k{k}n{i}" for i in range(200 - common))])]
    rows = list(enumerate(found))
    docs = documents(spark, [(i, text, "en", "a") for i, text in rows])
    result = {r.doc_id: (r.class_id, r.n_links) for r in similarity.near_duplicates(docs, similarity=threshold, levels=2).collect()}
    assert [result[i] for i, _ in rows] == expected(rows, threshold)


def test_settings_of_other_similarities(spark):
    assert similarity.candidate_share(0.8) == pytest.approx(0.6)
    assert similarity.runs_for(0.999, 0.3, 4) > 1 and similarity.runs_for(0.999, 1.0, 4) == 1
    with pytest.raises(ValueError):
        similarity.near_duplicates(empty_documents(spark), similarity=0)


def test_batches_keep_their_size(spark, monkeypatch):
    """Ten times as many small groups are dealt into ten times as many batches; none is lost or cut."""
    monkeypatch.setattr(similarity, "BATCH_BYTES", 4_000)
    monkeypatch.setattr(similarity, "LEAST_BATCHES", 2)

    def sizes(batch):
        assert (batch.groupby("g")["sid"].count() == 4).all()
        return batch.iloc[:1].assign(rows=len(batch))[["rows"]]

    largest = {}
    for groups in (100, 1_000):
        rows = spark.range(4 * groups).selectExpr("id AS sid", "id div 4 AS g", "4 AS n")
        batches = similarity.batches_of(rows, F.lit(100))
        assert batches == groups // 10
        found = similarity.in_blocks(rows, "g", "n", 4, sizes, "rows long", batches).collect()
        assert sum(r.rows for r in found) == 4 * groups
        largest[groups] = max(r.rows for r in found)
    assert largest[1_000] <= 3 * largest[100]


def test_one_document_of_each_class(spark, texts):
    rows = list(enumerate(texts))
    docs = documents(spark, [(i, text, "en", "a") for i, text in rows])
    kept = similarity.one_per_class(docs)
    assert set(kept.columns) == set(docs.columns)
    classes = expected(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({name for name, _ in classes})


def test_edge_rows(spark):
    docs = documents(spark)
    rows = similarity.similarity_digest(docs).collect()
    assert len(rows) == len(edge_rows())
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2)} == {(1, 2)}
    assert all(r.n_links == 0 for r in rows if r.doc_id in (3, 4, 5, 6, 7, 8))
    kept = [r.doc_id for r in similarity.one_per_class(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None, None], key=str)


def test_classes_without_a_key_of_their_own(spark):
    """Unlinked texts without a key, or under one key, are different classes; each keeps a document."""
    apart = [" ".join(f"n{k}x{i}" for i in range(40)) for k in range(6)]
    near = apart[0] + " and a few more"
    rows = [(None, text, "en", "a") for text in (*apart[:4], apart[3], near, None, " ")]
    rows += [(5, apart[4], "en", "a"), (5, apart[5], "en", "a"), (5, apart[5], "en", "a"), (9, apart[5], "en", "b")]
    found = similarity.similarity_digest(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    classes = {}
    for row in found:
        if row.n_shingles:
            classes.setdefault(row.class_set, []).append(row.doc_id)
    assert sorted(classes.values(), key=str) == sorted([[None] * 2, [None], [None], [None] * 2, [5], [5, 5, 9]], key=str)
    assert [row.class_set for row in found if not row.n_shingles] == [None, None]
    kept = [r for r in similarity.one_per_class(documents(spark, rows)).collect() if r.text and r.text.strip()]
    assert len(kept) == 6 and {r.text for r in kept} - {near} | {apart[0]} == set(apart)
    assert sorted((r.doc_id for r in kept), key=str) == sorted([None] * 4 + [5, 5], key=str)


def test_empty_table(spark):
    assert similarity.similarity_digest(empty_documents(spark)).count() == 0
    assert similarity.one_per_class(empty_documents(spark)).count() == 0


def test_runs_reach_the_recall():
    assert similarity.runs_for(0.999, 0.8, 6) > similarity.runs_for(0.99, 0.8, 6) > 1
    assert similarity.runs_for(0.999, 0.8, 6) > similarity.runs_for(0.999, 0.9, 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n", max_size=60)), max_size=8))
def test_shingles_are_those_of_the_words(texts):
    found = list(shingles.shingle_sets(pa.array(texts, pa.string()), 3))
    own = [shingle_set(t, 3) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in own]
    for i, j in combinations(range(len(texts)), 2):
        assert len(np.intersect1d(found[i], found[j])) == len(own[i] & own[j])
    for one in found:
        assert (shingles.unpacked(shingles.packed(one)) == one).all()


def test_sketches_estimate_the_similarity():
    values = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 48, 4000, dtype=np.uint64))
    whole = shingles.sketch(values)
    assert abs((shingles.sketch(values[::2]) == whole).mean() - 0.5) < 0.2
    assert (shingles.sketch(values[::-1]) == whole).all()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (3, 2)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1040)}}
    assert components.components(edges.limit(0)).count() == 0


def test_blocks_follow_the_bytes_of_long_texts(spark, monkeypatch):
    """A family of sets with 3,000 shingles each: no two blocks have much more than their bytes."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 200_000)
    blob = bytes(3_000 * similarity.SHINGLE_BYTES)
    rows = spark.range(60).select(F.col("id").alias("sid"), F.lit(7).alias("component"), F.lit(blob).alias("shingles"))
    weight = F.lit(len(blob) + similarity.ROW_BYTES)
    blocks = rows.agg(similarity.family_blocks(F.count("sid"), F.sum(weight)).alias("blocks"))
    assert blocks.first()[0] == 10

    def measured(group):
        return pd.DataFrame({"bytes": [int(group["shingles"].str.len().sum())], "one": [not group["_many"].iloc[0] or bool(group["_same"].iloc[0])]})

    found = similarity.in_blocks(rows.join(blocks), "component", "blocks", 1, measured, "bytes long, one boolean", 8).collect()
    assert len([r for r in found if r.one]) == 10 and len(found) == 55
    assert max(r["bytes"] for r in found if r.one) <= 250_000 and max(r["bytes"] for r in found) <= 450_000


def test_long_texts_in_blocks_of_bytes_give_the_same_classes(spark, monkeypatch):
    words = [f"w{i}" for i in range(4_000)]
    texts = [" ".join(words[:700] + [f"x{n}"] + words[700 : 1_400 + n]) for n in range(20)] + [" ".join(words[i::3]) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def classes():
        rows = similarity.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_similar").collect()
        return sorted(tuple(r) for r in rows)

    plain = classes()
    assert [r[2] for r in plain] == [19] * 20 + [0] * 3
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 30_000)
    assert classes() == plain


def test_recall_of_a_hundredth_of_the_documents(spark):
    """Links of all documents whose number is divisible by 100, against all others: none is missed."""
    docs = spark.read.parquet(str(TESTDATA / "sf0.1" / "documents.parquet")).select("doc_id", "text")
    sets = {row.doc_id: shingle_set(row.text) for row in docs.collect()}
    holders = {}
    for key, grams in sets.items():
        for gram in grams:
            holders.setdefault(gram, []).append(key)
    expected, linked = {}, {}
    for key in (key for key in sets if key % 100 == 0):
        shared = Counter(other for gram in sets[key] for other in holders[gram] if other != key)
        near = {other for other, n in shared.items() if n >= 0.8 * (len(sets[key]) + len(sets[other]) - n) - 1e-9}
        expected[key], linked[key] = len(near), near
    assert sum(expected.values()) > 20
    found = {r.doc_id: r for r in similarity.near_duplicates(docs).collect()}
    assert {key: found[key].n_links for key in expected} == expected
    assert all(found[other].class_id == found[key].class_id for key, near in linked.items() for other in near)
