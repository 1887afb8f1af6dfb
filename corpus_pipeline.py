"""Documents to packed training sequences, in five stages.

Each stage gets the documents that the one before kept, as a written table, and works on all of them.  All but the last
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm.common import table
from roadtrace.llm.decontaminate import without_leaks
from roadtrace.llm.language import UNKNOWN, language_model, predicted_language
from roadtrace.llm.minhash import without_duplicates
from roadtrace.llm.packing import pack
from roadtrace.llm.queries import vocabulary
from roadtrace.llm.toxicity import toxicity_model, toxicity_score
from roadtrace.staging import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half.  Learnt from all labels of documents at hand.

    Without labels of both classes to learn from, toxic documents cannot be told and all stay.  Null, empty and wordless
    texts have no toxic window and stay.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    if isinstance(model, float):
        return docs
    return docs.where(toxicity_score(F.col("text"), model) < 0.5)


def drop_languageless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without any letter go, and so do texts of which no language's filter
    holds more n-grams than false positives explain.

    If no document says its language, none can be learnt, and documents with a letter stay.
    """
    model = language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predicted_language(F.col("text"), model, docs)
    # The score is 0 where the first language of the alphabet is named for want of any other.
    return docs.where((found["lang"] != UNKNOWN) & (found["score"] > 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts: the one with the smallest id; one of repeated rows."""
    return without_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their token ids."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_languageless),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]
# Trained models and signatures are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written to the folder that all executors share and read again by the next.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
