"""Sinks: split manifests, rounded features, reports, incremental caches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.operators.filters import guarded, quality_label
from quillsift.operators.metrics import running_counts


def write_manifest(df: DataFrame, path: str, split: str = "split") -> None:
    """One CSV folder per split."""
    df.write.mode("overwrite").partitionBy(split).option("header", "true").option("emptyValue", "").csv(path)


def rounded_features(df: DataFrame, digits: int = 4, columns: tuple[str, ...] = ("clip_frac", "score")) -> DataFrame:
    """Features rounded for writing; labels come from the rounded values, as readers will see them."""
    d = df
    for x in columns:
        d = d.withColumn(x, F.round(x, digits))
    return d.withColumn("proposed_label", quality_label("clip_frac", "score"))


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def report_lines(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Text lines of rows; formatting happens here and nowhere before."""
    return df.select(F.format_string(pattern, *columns).alias("line"))


def export_names(df: DataFrame, split: str, label: str, key: str, width: int | None = None) -> DataFrame:
    """A numbered name for each row within its split and class, in the order of the key (null first); null without a class.

    Numbers are counts of the keys before, added up over ranges of keys; only rows
    of one key are ranked together.  They have five digits, or as many as they
    need; with a ``width`` they have exactly so many, as SQL's lpad writes them:
    the digits beyond are lost, and names repeat.
    """
    d = df.withColumn("_key", F.struct(key))  # a struct is never null
    first = running_counts(d, [split, label], "_key").select(F.col(split).alias("_split"), F.col(label).alias("_label"), F.col("_key").alias("_k"), (F.col("upto") - F.col("n")).alias("_first"))
    d = d.join(first, F.col(split).eqNullSafe(F.col("_split")) & F.col(label).eqNullSafe(F.col("_label")) & F.col("_key").eqNullSafe(F.col("_k")))
    n = F.col("_first") + F.row_number().over(W.partitionBy(split, label, "_key").orderBy(F.lit(0))) - 1
    digits = F.format_string("%05d", n) if width is None else F.lpad(n.cast("string"), width, "0")
    return d.withColumn("export_name", F.concat(F.col(label), F.lit("_"), digits)).select(*df.columns, "export_name")


def missing_only(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier run has not written yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def publishable(df: DataFrame, restricted: Column, message: str = "a restricted source in a published bundle") -> DataFrame:
    """``df``, failing if any row comes from a restricted source."""
    return guarded(df, restricted, message)


def upsert_and_check(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys are not stored yet, then return what is stored twice (empty if consistent)."""
    stored = spark.read.schema(rows.schema).parquet(path)
    missing_only(rows.dropDuplicates(keys), stored, keys).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).groupBy(*keys).count().where("count > 1")


def delete_and_check(spark: SparkSession, gone: DataFrame, path: str, to: str, keys: list[str]) -> DataFrame:
    """Write the rows of ``path`` without those of ``gone`` to a new folder, then return what is still stored of them (empty if consistent).

    The old folder stays as it is, so a lost task cannot leave half a table.
    """
    stored = spark.read.parquet(path)
    missing_only(stored, gone, keys).write.mode("errorifexists").parquet(to)
    return spark.read.schema(stored.schema).parquet(to).join(gone.select(*keys).distinct(), keys, "left_semi")


def orphan_files(files: DataFrame, rows: DataFrame, path: str = "path") -> DataFrame:
    """Files that no row names."""
    return files.join(rows.select(path).distinct(), path, "left_anti")


def delete_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, gone): delete each file and look again; a file that is already absent counts as gone.

    Runs where the result is computed; repeating it changes nothing.  Works on
    the file systems that pyarrow opens by address.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            out = []
            for p in batch["path"]:
                system, inner = fs.FileSystem.from_uri(p)
                there = lambda: system.get_file_info(inner).type != fs.FileType.NotFound  # noqa: B023, E731
                try:
                    if there():
                        system.delete_file(inner)
                    out.append((p, not there()))
                except OSError:
                    out.append((p, False))
            yield pd.DataFrame(out, columns=["path", "gone"])

    return files.select(F.col(path).alias("path")).distinct().mapInPandas(run, "path string, gone boolean")
