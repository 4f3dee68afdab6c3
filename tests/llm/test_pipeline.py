import re
from collections import Counter

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from sensorloom.llm import toxicity
from tests.llm.build import documents, edge_rows, empty_documents
from tests.llm.test_decontamination import expected as contaminated
from tests.llm.test_mixing import water_filled
from tests.llm.test_similarity import expected as classes
from tests.oracle import TESTDATA

SF_DIR = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages_match_brute_force(spark, docs):
    """Every stage on what the one before kept, against plain Python."""
    columns = docs.columns
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    clean = corpus_pipeline.without_toxic(spark, docs, SF_DIR)
    rows = docs.collect()
    scores = model.scores([r.text for r in rows])
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r, s in zip(rows, scores, strict=True) if s < 0.5)

    single = corpus_pipeline.without_near_duplicates(spark, clean, SF_DIR)
    kept = sorted((r.doc_id, r.text) for r in clean.collect())
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({name for name, _ in classes(kept)})

    apart = corpus_pipeline.without_benchmark(spark, single, SF_DIR)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = single.collect()
    found = contaminated([r.text for r in before], items)
    assert apart.columns == columns
    assert sorted(r.doc_id for r in apart.collect()) == sorted(r.doc_id for r, f in zip(before, found, strict=True) if not f[1])

    mixed = corpus_pipeline.mixed(spark, apart, SF_DIR)
    assert mixed.columns == columns
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in apart.collect()}
    source = {r.doc_id: r.source for r in apart.collect()}
    names = sorted(set(source.values()))
    sizes = [sum(words[i] for i in words if source[i] == name) for name in names]
    targets = dict(zip(names, water_filled(sizes, [i % 3 + 1 for i in range(len(names))], 3), strict=True))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3
    for name in names:
        taken = sum(words[i] * n for i, n in copies.items() if source[i] == name)
        assert abs(taken - targets[name]) <= max(words[i] for i in words if source[i] == name) / 2 + 1

    shards = corpus_pipeline.sharded(spark, mixed, SF_DIR).collect()
    assert Counter(r.doc_id for r in shards) == copies
    for shard in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == shard) == list(range(sum(r.shard == shard for r in shards)))


def test_run_is_registered_and_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "similarity", "decontamination", "mixing", "sharding"]
    rows = registered.queries()["pipeline"](spark, SF_DIR).collect()
    assert rows and {r.shard for r in rows} <= set(range(40))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark)
    found = stage(spark, docs, SF_DIR)
    assert set(found.columns) == set(docs.columns)
    assert found.count() <= 3 * len(edge_rows())
    assert stage(spark, empty_documents(spark), SF_DIR).count() == 0


def test_thirteen_operators_are_registered():
    names = [name for name in registered.queries() if re.match(r"op\d+_", name)]
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in names) == list(range(1, 14))
