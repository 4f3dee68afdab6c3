import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import language
from tests.llm.build import documents, edge_rows, empty_documents
from tests.oracle import TESTDATA


@pytest.fixture(scope="module")
def model():
    rows = [(f"the thing and that one is {i} of the three others there", "en") for i in range(80)]
    rows += [(f"der hund und die katze sind {i} auf dem dach im schnee", "de") for i in range(80)]
    return language.train(rows)


def test_learns_and_repeats(model):
    names, scores = model.predict(["the others and that", "und die katze im schnee", "12 34!", "", None])
    assert names == ["en", "de", "und", "und", "und"]
    assert all(0.5 < s <= 1 for s in scores[:2]) and not scores[2:].any()
    again = language.train([("the thing", "en"), ("der hund", "de")]).predict(["the", "der"])
    assert again[0] == language.train([("the thing", "en"), ("der hund", "de")]).predict(["the", "der"])[0]


def test_uncertain_predictions_are_rejected(spark, model):
    strict = language.LanguageModel(model.languages, model.table, model.bias, model.temperature, 0.999999)
    rows = language.identified(documents(spark), strict).collect()
    assert len(rows) == len(edge_rows()) and not all(r.accepted for r in rows)
    assert all(r.lang_pred in ("en", "de", "und") for r in rows)


def test_texts_do_not_depend_on_their_batch(model):
    texts = ["the thing " * n for n in (1, 5, 500)] + ["schnee " * 40_000]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        one_name, one_score = model.predict([text])
        assert one_name == [name] and one_score[0] == pytest.approx(score)


def test_training_uses_neither_the_held_out_fold_nor_rows_without_language(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "a") for i in range(50)]
    docs = documents(spark, rows)
    from sensorloom.llm.training import training_rows

    used = {text for text, _ in training_rows(docs, docs, "lang", 1000)}
    assert used == {f"text {i}" for i in range(50) if i % 3 and zlib.crc32(str(i).encode()) % 5}


def plain_score(model, text):
    """Language and score of one text, n-gram by n-gram."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    word = [ord(c) for c in f" {' '.join(letters.split())} "]
    mask, total, count = (1 << 64) - 1, np.zeros(len(model.languages)), 0
    for size in language.SIZES:
        for start in range(len(word) - size + 1):
            gram = word[start : start + size]
            inner = gram[1:-1] if size > 1 else gram
            if 32 in inner or gram == [32, 32]:
                continue
            value = 0
            for step, code in enumerate(gram, 1):
                value = (value * 0x9E3779B97F4A7C15 + code + step) & mask
            value = ((value ^ (value >> 31)) * 0xBF58476D1CE4E5B9) & mask
            total += model.table[value >> (64 - language.BUCKET_BITS)]
            count += 1
    logits = (total / count + model.bias) / model.temperature
    shares = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    return model.languages[shares.argmax()], shares.max()


def test_scores_against_plain_python(spark, model):
    texts = ["Thé thing, and 3 others!", "der  Hund\nund", "ab½c² dé\u0301f", "x", "Ωμέγα and 漢字"]
    docs = documents(spark, [(i, text, None, "a") for i, text in enumerate(texts)])
    for row in language.identified(docs, model).collect():
        name, score = plain_score(model, row.text)
        assert (row.lang_pred, row.score) == (name, pytest.approx(score, rel=1e-5))


@pytest.mark.parametrize("text", ["½ ② ² 12", "١٢٣ ४५", "№ 7 €", "Ⅳ ⑴ ㊀", "_ - \u0301"])
def test_numbers_and_signs_are_no_letters(model, text):
    assert not any(unicodedata.category(c).startswith("L") for c in text)
    names, scores = model.predict([text, text + " ʰ"])
    assert names[0] == "und" and scores[0] == 0 and names[1] != "und"


def test_long_texts_are_trained_on(spark):
    """A language that has long texts only, and none of whose words stand at a text's beginning."""
    rows = [(i, "the thing and that one there " * 10, "en", "a") for i in range(40)]
    rows += [(100 + i, "0 " * 50_000 + "der hund und die katze im schnee " * 9_000, "de", "a") for i in range(12)]
    model = language.fit_language(documents(spark, rows))
    assert model.languages == ("de", "en")
    assert model.predict(["die katze und der hund"])[0] == ["de"]


def test_repeated_keys_and_many_labels_are_bounded(spark, monkeypatch):
    from sensorloom.llm import training

    used = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 5)
    ids = [used] * 3_000 + [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 5]
    docs = documents(spark, [(key, f"text {i}", "en", "a") for i, key in enumerate(ids)] + [(used, "same", "de", "a")] * 500)
    rows = training.training_rows(docs, docs, "lang", 100)
    by_label = {label: sum(1 for _, k in rows if k == label) for label in ("en", "de")}
    assert by_label["en"] < 200 and by_label["de"] < 200
    assert sum(1 for row in rows if row == ("same", "de")) <= 1
    monkeypatch.setattr(training, "MOST_ROWS", 60)
    assert len(training.training_rows(docs, docs, "lang", 100)) < 120
    many = documents(spark, [(i, "a text", f"l{i}", "a") for i in range(700)])
    with pytest.raises(ValueError, match="more than 500"):
        training.training_rows(many, many, "lang", 10)


def test_pieces_come_from_the_whole_text(spark):
    from sensorloom.llm.training import PIECES, TRAIN_CHARS, shortened

    texts = ["é" * TRAIN_CHARS, "".join(chr(0x4E00 + i % 20_000) for i in range(100_000))]
    short, long = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shortened(F.col("t"))).collect()]
    assert short == texts[0] and len(long) == TRAIN_CHARS + PIECES - 1
    pieces = long.split(" ")
    assert texts[1].startswith(pieces[0]) and texts[1].endswith(pieces[-1]) and all(p in texts[1] for p in pieces)


def test_empty_table(spark):
    assert language.language_digest(empty_documents(spark)).count() == 0
    nothing = documents(spark, [(1, "abc", None, "a")])
    assert language.language_digest(nothing).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01" / "documents.parquet"))
    rows = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    right = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
