"""The stages one after the other: what each removes, checked by hand."""

import random
from collections import Counter

import corpus_pipeline
from roadtrace.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def _corpus():
    r = random.Random(12)
    words = [a + b for a in ("ma", "to", "ri", "sel", "no", "ka", "du", "ven") for b in ("ra", "lin", "so", "te", "mu", "gar")]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    docs, labels, fate = [], [], {}

    def add(text_, why, toxic=0):
        i = len(docs)
        docs.append((i, text_, "xx", "s", 1, "clash"))
        if i % 2 or toxic:
            labels.append((i, 1, toxic))
        fate[i] = why

    item = text(30)
    for i in range(160):
        add(text(r.randint(30, 80)), "kept")
    for i in range(60):
        made = text(60).split()
        for _ in range(4):
            made.insert(r.randrange(50), r.choice(("zwixit", "grobulk", "fnarzle")))
        add(" ".join(made), "toxic", 1)
    add(None, "language")
    add("", "language")
    add("12 ... 34", "language")
    for i in range(3):
        add(docs[i][1], "copy")
        add(docs[i + 10][1] + " so", "copy")
    add(text(50) + " " + item + " " + text(50), "leak")
    return docs, labels, [(1, item), (2, None)], fate


def test_each_stage_takes_effect(spark, tmp_path):
    docs, labels, items, fate = _corpus()
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"),
                               ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    current = spark.read.parquet(f"{sf}/documents.parquet")
    columns, gone = current.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in current.collect()}
        kept = stage(spark, current, sf)
        assert kept.columns == columns
        kept.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        gone |= dict.fromkeys(before - {r.doc_id for r in current.collect()}, name)
    names = {"toxic": "toxicity", "language": "language", "copy": "near_duplicates", "leak": "decontamination"}
    assert {i: names[why] for i, why in fate.items() if why != "kept"} == gone
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, why in fate.items() if why == "kept"}
    assert Counter(r.ids_crc32 for r in packed) == Counter(
        r.ids_crc32 for r in corpus_pipeline.pack_sequences(spark, current, sf).collect())


def test_labels_that_teach_nothing_keep_all_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, "mara tolin", "xx", "s", 1, "clash") for i in range(6)], DOCS)
    for n, labels in enumerate(([(0, 1, 1), (1, 1, 1)], [(0, 1, 0), (1, 1, 1)], [(0, 1, 0)], [])):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, sf).count() == 6


def test_gibberish_has_no_language(spark, tmp_path):
    clean = [(i, "mara tolin rite selso", "xx", "s", 1, "clash") for i in range(200)]
    # Rare enough to be in no filter although it states a language.
    docs = spark.createDataFrame([*clean, (200, "qzxjk wvqxz zzqjw", "xx", "s", 1, ""), (201, "mara", None, "s", 1, "")], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_languageless(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(200), 201}


def test_empty_tables_go_through(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())
