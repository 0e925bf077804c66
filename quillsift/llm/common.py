"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.operators.components import written  # noqa: F401  (used by the operators)

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_mod(column: str, modulus: int):
    """crc32 of the decimal form of an id, modulo ``modulus`` (a null id counts as its empty form)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; a worker lives on for later tasks."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of ``rows`` rows, unless the session sets another number than Spark's default.

    Spark's 10,000 rows of long texts would need hundreds of MB per task on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, rows)
