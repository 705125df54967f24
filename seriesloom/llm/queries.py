"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, licenses, neardup, packing, quality, secrets, token_table, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, window=4096)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(rows.unionByName(chat.adversarial(spark)))


def op6_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.digest(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_warc, op3_licenses, op4_packing, op5_chat, op6_token_table, op7_toxicity, op8_minhash, op9_decontamination, op10_quality)}
ORACLE_SQL = {"op2_warc": warc.SQL, "op3_licenses": licenses.sql(), "op5_chat": chat.SQL, "op8_minhash": neardup.SQL, "op9_decontamination": decontam.SQL}
