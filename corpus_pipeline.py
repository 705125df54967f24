"""The corpus pipeline: documents that are not toxic, one of each near-duplicate group, no benchmark passages, no secrets,
packed into sequences. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontam, neardup, packing, secrets, toxicity
from seriesloom.llm.queries import vocabulary
from seriesloom.llm.shared import cut, hinted, settle

#: Rejected rows (16 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Similarity of word shingles, in hundredths, from which the stage takes documents as near copies (op8_minhash keeps its 85).
NEAR_PERCENT = 80


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    settle(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _without(docs: DataFrame, gone: DataFrame, h: Column) -> DataFrame:
    """``docs`` without the rows (doc_id, h) of ``gone``; ``h`` is the hash that was made of a document."""
    gone = cut(gone.select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct(), "gone")
    return docs.join(hinted(gone, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (h == F.col("__gone_h")), "left_anti")


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; of repeated rows, one."""
    settle(spark)
    groups = cut(neardup.assign(docs, percent=NEAR_PERCENT).select("doc_id", "h", "kept"), "groups")
    settle(spark)  # that was the largest number of plans
    out, kept = _without(docs, groups.where("not kept"), F.xxhash64("text")), groups.where("kept")
    if kept.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    settle(spark)
    found = decontam.judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"), decontam.document(docs)[1])


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    settle(spark)
    return secrets.redact(docs, secrets.scan(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    settle(spark)
    return packing.digest(docs, vocabulary("word_bpe_49k.json"), end_id=2, window=4096, cache=100_000)  # workers serve all stages: keep few words


STAGES = [("toxicity", toxic_out), ("near_dedup", duplicates_out), ("decontamination", contaminated_out), ("secrets", secrets_out), ("packing", packed)]
#: Tokens and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
