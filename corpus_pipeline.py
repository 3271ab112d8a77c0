"""A corpus pipeline of the operators; each stage's rows are written as Parquet and read again by the next.

All stages but the last return the columns of documents; a changed text has its n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstats.llm import bpe, decontaminate, ngram_join, shared, substring_dedup, toxicity
from matchstats.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are not predicted toxic; the labels only train.  Rows without text or words stay, repeated rows are
    judged each for itself; an empty table gives an empty one."""
    return toxicity.clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (a null being the smallest, then by the text).

    Rows are told apart by doc_id and text, so those that share a doc_id are judged each for itself; only rows alike in
    both stay or go together.  Rows without words stay; an empty table gives an empty one.
    """
    (key,) = shared.free(docs, "_key")
    rows = docs.withColumn(key, F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text")))
    found = ngram_join.join(rows.select(F.col(key).alias("doc_id"), "text"))
    return rows.join(found.where("doc_id > class_id").select(F.col("doc_id").alias(key)), key, "left_anti").select(_columns(docs))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; those that share passages with an earlier document keep their other words, joined by one blank, and have
    n_chars counted anew.  Rows without a doc_id, text or passage stay as they are, as do repeated rows among each other;
    an empty table gives an empty one."""
    own, sig, doc_id, kept = shared.free(docs, "_own", "_sig", "_doc_id", "_kept")
    changed = substring_dedup.dedup(docs.select("doc_id", "text")).where("n_removed > 0")
    changed = changed.select(F.col("doc_id").alias(doc_id), F.col("sig").alias(sig), F.col("kept").alias(kept)).dropDuplicates([doc_id, sig])
    rows = docs.withColumn(own, substring_dedup.signature())
    rows = rows.join(changed, (F.col("doc_id") == F.col(doc_id)) & (F.col(own) == F.col(sig)), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose texts benchmark windows do not contaminate, judged by the text alone, whatever the doc_id.  Rows
    without words and repeated rows stay; an empty table gives an empty one."""
    (key,) = shared.free(docs, "_key")
    rows = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    found = decontaminate.contamination(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every remaining row's text; a null text has no ids; an empty table gives an empty one."""
    import public_tokenizers

    return bpe.encode_documents(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("substring-dedup", drop_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: a trained tagger and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
