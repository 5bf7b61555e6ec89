"""Named queries of the llm operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bagminhash, chat, decontaminate, html_text, mixing, pii, quality, sql, substrings, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pii_key(spark: SparkSession) -> str:
    """The key of pseudonyms: the session's, or one that is good for test tables only."""
    return spark.conf.get("spark.lumenframe.pii.key", "test tables only")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key=pii_key(spark)).select("doc_id", "text", "n_found")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    turns = chat.read_chat(F.col("formatted"))
    read = chat.format_chat(rows).withColumn("turns", turns).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_topk": op2_topk,
        "op3_html_text": op3_html_text,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_quality": op7_quality,
        "op8_pii": op8_pii,
        "op9_mix": op9_mix,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": sql.OP1,
        "op2_topk": sql.OP2,
        "op4_substring_dedup": sql.OP4,
        "op9_mix": sql.OP9,
        "op10_chat": sql.OP10,
    }
