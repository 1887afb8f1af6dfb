"""One query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import oracles
from roadtrace.llm.chat import conversation_digests, format_conversations
from roadtrace.llm.common import remainder, table
from roadtrace.llm.decontaminate import leaks
from roadtrace.llm.embeddings import near_vectors
from roadtrace.llm.language import language_model, predicted_language
from roadtrace.llm.lexical import ranked
from roadtrace.llm.lines import repeated_lines_dropped
from roadtrace.llm.minhash import duplicate_classes
from roadtrace.llm.packing import pack
from roadtrace.llm.quality import quality_model, quality_score
from roadtrace.llm.shards import interleave
from roadtrace.llm.spelling import spelling_variants
from roadtrace.llm.toxicity import toxicity_model, toxicity_score
from roadtrace.llm.urls import ALLOW, BLOCK, Rule, judge, labelled_urls
from roadtrace.llm.urls import train as train_urls


def _held_out(divisor: int, value: int):
    """True in the held-out fold; a null id is in none."""
    return F.coalesce(F.expr(f"{remainder(divisor)} = {value}"), F.lit(False)).alias("held_out")


def _verdict():
    return (F.col("score") >= 0.5).cast("int").alias("predicted")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_model(docs, table(spark, sf, "labels"), keep=f"{remainder(3)} <> 1")
    scored = docs.select("doc_id", _held_out(3, 1), quality_score(F.col("text"), model, docs).alias("score"))
    return scored.select("*", _verdict())


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_key")


RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


def op3_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge(pages, "url", RULES, train_urls(labelled_urls(spark))).drop("url")


def op4_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


SHARDS = 40


def op5_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    identity = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))
    return interleave(docs, SHARDS, F.col("source"), identity).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_classes(table(spark, sf, "documents")).drop("text_key")


def vocabulary() -> str:
    """Path of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), vocabulary()).drop("ids")


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity_model(docs, table(spark, sf, "labels"), keep=f"{remainder(5)} <> 0")
    scored = docs.select("doc_id", _held_out(5, 0), toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("*", _verdict())


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language_model(docs, keep=f"{remainder(3)} <> 1")
    found = docs.select("doc_id", _held_out(3, 1), predicted_language(F.col("text"), model, docs).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one more whose texts hold control strings."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " as t(conv_id, turn, role, text)"
    )
    return conversation_digests(format_conversations(said.unionByName(extra)))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


def op12_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op13_lines(spark: SparkSession, sf: str) -> DataFrame:
    cut = repeated_lines_dropped(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_urls": op3_urls,
        "op4_embeddings": op4_embeddings,
        "op5_shards": op5_shards,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_packing": op7_packing,
        "op8_toxicity": op8_toxicity,
        "op9_language": op9_language,
        "op10_chat": op10_chat,
        "op11_spelling": op11_spelling,
        "op12_search": op12_search,
        "op13_lines": op13_lines,
    }


def oracle_sql() -> dict[str, str]:
    """The trained models (op1, op3, op8, op9) and the vocabulary (op7) are no SQL; tests cover those."""
    return oracles.all_statements()
