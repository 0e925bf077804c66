"""Connected components of an edge list, by alternating stars.

Each round rewrites the edges so that every node points nearer to the least
node it can reach; both steps are a grouped minimum and a join, so a node with
very many neighbours is aggregated before it is shuffled and its join partition
can be split.  The edges of each round are written to ``spark.checkpoint.dir``,
which cuts the lineage and survives lost executors.  Rounds grow with the
logarithm of the longest path; the driver sees two numbers a round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (``spark.checkpoint.dir``).

    Where it is unset, as in tests, a session in one process gets a temporary one;
    on a cluster that is an error, as its machines would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillsift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v: large links the greater neighbours to the least one, small the others."""
    if large:
        near = edges.select(F.col("u").alias("at"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("at"), F.col("u").alias("to")))
    else:
        near = edges.select(F.col("u").alias("at"), F.col("v").alias("to"))
    least = near.groupBy("at").agg(F.min("to").alias("m")).select(F.col("at").alias("center"), F.least("m", "at").alias("m"))
    joined = near.join(least, F.col("at") == F.col("center"))
    if large:
        out = joined.where("to > at").select(F.col("to").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("to").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("center").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges; the component is its least node.

    Null ends and loops count as no edge.  An empty list gives an empty result.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        e = written(_star(_star(e, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
