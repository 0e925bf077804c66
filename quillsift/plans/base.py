"""Registry of named queries: each a Spark plan and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Six decimals: sums of doubles differ in their last bits with the order of rows."""
    return F.round(x, 6)


def doc_path() -> Column:
    """A file path for a document: source/lang/doc-<id>.<suffix>, some with back-slashes."""
    sep = F.when(F.col("doc_id") % 5 == 0, "\\").otherwise("/")
    suffix = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".csv", ".txt", ".json", ".bin", ".jpeg"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return F.concat("source", sep, "lang", sep, F.lit("doc-"), F.col("doc_id").cast("string"), suffix)


DOC_PATH_SQL = r"""(source || CASE WHEN doc_id % 5 = 0 THEN '\' ELSE '/' END || lang || CASE WHEN doc_id % 5 = 0 THEN '\' ELSE '/' END || 'doc-' || doc_id
  || ['.JPG', '.png', '.csv', '.txt', '.json', '.bin', '.jpeg'][doc_id % 7 + 1])"""
