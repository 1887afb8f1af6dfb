"""Quality, toxicity and language: held-out accuracy on small made-up corpora, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from roadtrace.llm.language import UNKNOWN, language_model, predict, predicted_language
from roadtrace.llm.quality import quality_model, quality_score
from roadtrace.llm.toxicity import toxicity_model, toxicity_score

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PLAIN = [a + b for a in ("ma", "to", "ri", "sel", "no", "ka", "du", "ven") for b in ("ra", "lin", "so", "te", "mu", "gar")]
NASTY = ["zwixit", "grobulk", "fnarzle", "plonkhead"]
ODD = [
    (9001, None, None, None, None),
    (9002, "", "xx", "s", 0),
    (9003, "?! ... 12", None, "s", 9),
    (9004, "mara tolin " * 60_000, "xx", "s", 1),
    (None, "mara tolin rite", "xx", "s", 1),
    (9002, "", "xx", "s", 0),
]


def _sentence(r, n, words=PLAIN):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def _corpus(kind, n=400, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = _sentence(r, r.randint(20, 80))
        bad = i % 4 == 0
        if bad and kind == "toxic":
            words = text.split()
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(NASTY))
            text = " ".join(words)
        elif bad:
            text = " ".join(w + r.choice(("###", "&&&")) for w in text.split())
        docs.append((i, text, "xx", "s", len(text)))
        labels.append((i, int(not (bad and kind == "quality")), int(bad and kind == "toxic")))
    return docs, labels


def _scored(spark, kind, model_of, score_of, extra=()):
    docs, labels = _corpus(kind)
    d = spark.createDataFrame(docs + list(extra), DOCS).withColumn("y", F.lit("clash")).withColumn("turn", F.lit(1))
    lab = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], LABELS)
    model = model_of(d, lab, keep="doc_id % 5 <> 0")
    rows = d.select("doc_id", "text", score_of(d, model).alias("score")).collect()
    truth = {i: (q, t) for i, q, t in labels}
    return rows, truth


def test_quality_on_held_out_documents(spark):
    rows, truth = _scored(spark, "quality", quality_model, lambda d, m: quality_score(F.col("text"), m, d), ODD)
    held = [(r.score, truth[r.doc_id][0]) for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 5 == 0]
    assert all((score >= 0.5) == (y == 1) for score, y in held)
    assert len(rows) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_documents(spark):
    rows, truth = _scored(spark, "toxic", toxicity_model, lambda d, m: toxicity_score(F.col("text"), m), ODD)
    held = [(r.score, truth[r.doc_id][1]) for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 5 == 0]
    wrong = sum((score >= 0.5) != (y == 1) for score, y in held)
    assert wrong == 0
    odd = [r for r in rows if r.doc_id is None or r.doc_id > 9000]
    assert len(odd) == len(ODD) and all(r.score < 0.5 for r in odd)


def test_toxic_words_that_ordinary_documents_quote_still_mark(spark):
    docs, labels = _corpus("toxic")
    # Each word stands in a few documents that are ordinary, or have the wrong label.
    quotes = [(5001 + 5 * k, f"{_sentence(random.Random(k), 30)} {word}", "xx", "s", 1) for k, word in enumerate(NASTY * 3)]
    d = spark.createDataFrame(docs + quotes, DOCS)
    lab = spark.createDataFrame(labels + [(i, 1, 0) for i, *_ in quotes], LABELS)
    model = toxicity_model(d, lab, keep="doc_id % 5 <> 0")
    truth = {i: t for i, _, t in labels}
    held = [r for r in d.select("doc_id", toxicity_score(F.col("text"), model).alias("score")).collect() if r.doc_id < 5000 and r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) != (truth[r.doc_id] == 1) for r in held) == 0


@pytest.mark.parametrize("labels, constant", [([], (0.5, 0.0)), ([(0, 1, 1), (1, 1, 1)], (1.0, 1.0)), ([(0, None, None)], (0.5, 0.0))])
def test_without_two_classes_the_score_is_constant(spark, labels, constant):
    docs = spark.createDataFrame([(0, "mara", "xx", "s", 4), (1, None, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels, LABELS)
    for made, score, value in (
        (quality_model, lambda m: quality_score(F.col("text"), m, docs), constant[0]),
        (toxicity_model, lambda m: toxicity_score(F.col("text"), m), constant[1]),
    ):
        model = made(docs, lab)
        assert {r[0] for r in docs.select(score(model)).collect()} == {value}


def test_empty_tables_give_empty_results(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert docs.select(quality_score(F.col("text"), quality_model(docs, labels), docs)).count() == 0
    assert docs.select(toxicity_score(F.col("text"), toxicity_model(docs, labels))).count() == 0
    assert docs.select(predicted_language(F.col("text"), language_model(docs), docs)).count() == 0


def test_language_on_held_out_documents(spark):
    r = random.Random(3)
    tongues = {
        "aa": ["baba", "bobo", "babo", "abab", "boba"],
        "bb": ["titi", "tuti", "itit", "tutu", "utit"],
        "cc": ["nérén", "rénné", "énré", "nénér", "rérén"],
    }
    names = list(tongues)
    docs = []
    for i in range(240):
        lang = names[i % 3]
        docs.append((i, _sentence(r, r.randint(1, 30), tongues[lang]), lang, "s", 1))
    d = spark.createDataFrame(docs + ODD, DOCS).withColumn("h", F.lit(0)).withColumn("rate", F.lit("x"))
    model = language_model(d.where("doc_id < 9000"), keep="doc_id % 4 <> 0")
    assert model.languages == names
    rows = d.select("doc_id", "lang", predicted_language(F.col("text"), model, d).alias("p")).collect()
    assert all(row.p.lang == row.lang for row in rows if row.doc_id is not None and row.doc_id < 9000)
    odd = [row.p for row in rows if row.doc_id in (9001, 9002, 9003)]
    assert len(odd) == 4 and all(p.lang == UNKNOWN and p.score == 0 for p in odd)
    assert all(0 <= row.p.score <= 1 for row in rows)
    # Superscripts are no letters; a text of one letter has a language.
    assert predict(["²", "b"], model)[0] == [UNKNOWN, "aa"]


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + k) for k in range(70)]
    docs = [(i, f"{letters[i % 70]}{letters[i % 70]}", f"l{i % 70:02d}", "s", 2) for i in range(210)]
    d = spark.createDataFrame(docs, DOCS)
    model = language_model(d)
    names, _ = predict([t for _, t, *_ in docs], model)
    assert names == [lang for _, _, lang, *_ in docs] and model.slots.shape[0] == 2
