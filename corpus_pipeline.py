"""A corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage works on all that its predecessor kept and is written as Parquet in
between.  All stages but the last return the columns of ``documents``.

Edge cases are those of the operators: null texts count as empty, repeated rows
are rows of their own until near-dedup keeps one document of each class, empty
tables pass through as empty, and further columns of the documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import near_dedup, packing, quality_rules, toxicity
from quillsift.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the classifier learns from the labelled documents of the input table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).where(F.col("score") < 0.5).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, keep_row=True)
    # one row for each kept document; a plain filter would be moved below the measures and repeat them
    kept = judged.select("row", F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("_one"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the least id (of repeated rows one)."""
    no_id = F.lit(-(1 << 63))
    classes = near_dedup.near_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = classes.groupBy("component").agg(F.min(F.struct("hash", "hash2", "doc_id")).alias("x"))
    chosen = chosen.select(F.col("x.hash").alias("_hash"), F.col("x.hash2").alias("_hash2"), F.coalesce("x.doc_id", no_id).alias("_id"))
    own = [h.alias(f"_{n}") for h, n in zip(near_dedup.text_hashes(), ("hash", "hash2"))]
    d = docs.select(F.struct(*docs.columns).alias("row"), *own, F.coalesce(F.col("doc_id").cast("long"), no_id).alias("_id"))
    # the keys of the join are those of the duplicates, so rows meet without another shuffle
    keys = ["_hash", "_hash2", "_id"]
    return d.join(chosen.hint("merge"), keys).dropDuplicates(keys).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.best_fit_packing(docs, *packing.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier, the sampled near-duplicate search and the packing are not SQL-expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
