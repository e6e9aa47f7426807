"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontam, exact, lines, minhash, mixing, pages, secrets, sharding, toxicity
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(docs, labels.where(~held_out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact.DigestIndex(spark, f"{Scratch(spark, 'index').root}/digests", buckets=32)
    return exact.deduplicate(table(spark, sf_dir, "documents"), index)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit_formats(docs))
    digest = F.sha2(F.encode("base_spans", "utf-8"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_learned", "odds")


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash": op2_minhash,
    "op3_exact": op3_exact,
    "op4_html": op4_html,
    "op5_lines": op5_lines,
    "op6_decontam": op6_decontam,
    "op7_shards": op7_shards,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_chunks": op10_chunks,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": minhash.ORACLE_SQL,
    "op3_exact": exact.ORACLE_SQL,
    "op6_decontam": decontam.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
