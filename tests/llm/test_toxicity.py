import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import toxicity
from tests.llm.build import documents, edge_rows, empty_documents
from tests.oracle import TESTDATA


@pytest.fixture(scope="module")
def model():
    pick = np.random.Generator(np.random.PCG64(5))
    plain = [f"word{i}" for i in range(200)]

    def text(more):
        words = list(pick.choice(plain, 40))
        words[int(pick.integers(40))] = more
        return " ".join(words)

    texts = [text("nastyword") for _ in range(60)] + [text("plainword") for _ in range(200)]
    return toxicity.train(texts, [1] * 60 + [0] * 200)


def test_one_word_decides(model):
    scores = model.scores(["word1 word2 nastyword word3", "word1 word2 word3", "", None])
    assert scores[0] > 0.5 > scores[1]
    assert scores[2] == scores[3] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_texts_do_not_depend_on_their_batch(model):
    texts = ["word1 " * n + "nastyword" for n in (1, 100, 60_000)] + ["word2"]
    together = model.scores(texts)
    assert together == pytest.approx([model.scores([t])[0] for t in texts])
    assert (together[:3] > 0.5).all()


def plain_score(model, text):
    """Score of one text, n-gram by n-gram."""
    codes = [ord(c) for c in f" {' '.join((text or '').lower().split())} "]
    mask, buckets = (1 << 64) - 1, set()
    for size in toxicity.SIZES:
        for start in range(len(codes) - size + 1):
            gram = codes[start : start + size]
            if 32 in gram[1:-1]:
                continue
            value = 0
            for step, code in enumerate(gram, 1):
                value = (value * 0x9E3779B97F4A7C15 + code + step) & mask
            value = ((value ^ (value >> 31)) * 0xBF58476D1CE4E5B9) & mask
            buckets.add(value >> (64 - toxicity.BUCKET_BITS))
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[b]) for b in sorted(buckets)))))


def test_scores_against_plain_python(spark, model):
    texts = ["word1 NASTYWORD, word3", "nastyword " * 300, "a\n\tb", "", None, "word7 wördé nasty word 漢字漢字", "x"]
    docs = documents(spark, [(i, text, None, "a") for i, text in enumerate(texts)])
    for row in toxicity.scored(docs, model).collect():
        assert row.score == pytest.approx(plain_score(model, row.text), rel=1e-6)


def test_one_class_gives_its_share():
    assert toxicity.train(["a", "b"], [0, 0]).scores(["x"])[0] < 0.5
    assert toxicity.train([], []).scores(["x"])[0] == pytest.approx(0.5)


def test_edge_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0), (9, None, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_digest(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.toxicity_digest(empty_documents(spark), labels.limit(0))
    assert none.count() == 0


def test_held_out_accuracy(spark):
    folder = TESTDATA / "sf0.1"
    docs, labels = (spark.read.parquet(str(folder / f"{name}.parquet")) for name in ("documents", "labels"))
    rows = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").filter("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    toxic = counts.get((1, 1), 0) + counts.get((1, 0), 0)
    clean = counts.get((0, 1), 0) + counts.get((0, 0), 0)
    assert counts.get((1, 1), 0) > 0.7 * toxic
    assert counts.get((0, 1), 0) < 0.02 * clean
    means = {r.toxic: r.m for r in rows.groupBy("toxic").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > 0.6 > 0.1 > means[0]
