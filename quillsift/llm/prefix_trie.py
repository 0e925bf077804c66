"""Prefix trie of conversations: partial node tables, merged by hash, then rolled up.

A node is a distinct sequence of first turns.  Its key is the exclusive or of the
hashes of (depth, turn) over the sequence, twice 64 bits, so that the keys of a
very long conversation are made in parallel: runs of ``RUN`` turns by themselves,
then what stands before each run.  Texts never move; a turn is its md5 and its
number of bytes.

Each task combines the members of its nodes before rows leave it; the partial
tables are merged by key in two rounds, first within PARTS parts, then all.
Lists of ends have no bound (copies of one conversation end in one node), so they
travel as sorted pieces of at most ``PIECE`` ids and meet as a stream.

Rollup: the nodes whose least member is m are the last ones of m's path, m's own
chain.  A node's subtree is the rest of its own chain below it, and the whole
chains of all its other members.  So the sums over all subtrees are one grouped
sum over (member, node), from the ends to the root at any depth, without a round
for each level.

Edge cases: turns are ordered by number, null first, ties by the md5 of role and
text; null roles and texts are empty; turns without a conversation id belong to
no conversation; repeated rows are turns of their own; very long texts count
with all their bytes, very long conversations with all their turns; an empty
table has no node, not even a root; columns other than the four named are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillsift.llm.common import table, written

#: Turns whose running keys and sums are made in one go; ids of one piece of a list of ends; parts of the first merge.
RUN, PIECE, PARTS = 1024, 8192, 16
NODE = ["k1", "k2", "depth"]
#: Rebuilt conversations share turns with the first of FAMILY ids, fewer than HEADS.
FAMILY, HEADS = 5, 9


def turns_in_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, digest, bytes): turns numbered in the order of conversations and turns, ``at`` rising without gaps.

    Rows are dealt by ranges of (conversation, turn), so a very long conversation
    lies in many tasks; a table with one row a task says where each task starts.
    """
    r, x = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, x).cast("binary"))
    d = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(x).cast("long").alias("bytes"))
    d = d.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("digest")).sortWithinPartitions("conv_id", "turn", "digest")
    d = written(d.select("conv_id", "digest", "bytes", F.monotonically_increasing_id().alias("_i")), "turns")
    # a task's rows are numbered from a multiple of 2 ** 33
    task = F.shiftright("_i", 33)
    sizes = d.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(W.orderBy("_task")) - F.col("_n")).alias("_before"))  # one row a task
    return d.withColumn("_task", task).join(F.broadcast(before), "_task").select("conv_id", (F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "digest", "bytes")


def conversations(ordered: DataFrame) -> DataFrame:
    """(conv_id, first, n): where each conversation starts and its number of turns."""
    return ordered.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))


def plain_sequences(ordered: DataFrame) -> DataFrame:
    """Sequences (conv_id, depth, digest, bytes, is_end) of the conversations as they are; depth 0 stands for the start."""
    convs = conversations(ordered)
    turns = ordered.join(convs, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("depth"), "digest", "bytes", (F.col("at") - F.col("first") + 1 == F.col("n")).alias("is_end"))
    return turns.unionByName(_starts(convs.withColumn("length", F.col("n"))))


def _starts(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("is_end"))


def rebuilt_sequences(ordered: DataFrame) -> DataFrame:
    """As ``plain_sequences``; conversation c starts with the first h turns of conversation c - c % 5, h = crc32(c) % 9, and goes on with its own after the first h."""
    convs = conversations(ordered)
    c = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("head", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"), F.col("first").alias("head_first"))
    c = c.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    depth = F.col("at") - F.col("first") - F.col("h") + F.col("taken") + 1
    own = ordered.join(c, "conv_id").where("at - first >= h").select("conv_id", depth.alias("depth"), "digest", "bytes", (depth == F.col("length")).alias("is_end"))
    # fewer than HEADS turns of each head, to fewer than FAMILY conversations or itself
    first = ordered.join(convs, "conv_id").where(f"conv_id % {FAMILY} = 0 AND at - first < {HEADS - 1}").select(F.col("conv_id").alias("head"), (F.col("at") - F.col("first") + 1).alias("depth"), "digest", "bytes")
    lent = first.join(c.select("head", "conv_id", "h", "length"), "head").where("depth <= h").select("conv_id", "depth", "digest", "bytes", (F.col("depth") == F.col("length")).alias("is_end"))
    return own.unionByName(lent).unionByName(_starts(c))


def node_keys(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, is_end, k1, k2, up1, up2): the key of each prefix and of the prefix one turn shorter."""
    start = F.col("depth") == 0
    d = sequences.select("conv_id", "depth", "bytes", "is_end", F.when(start, 0).otherwise(F.xxhash64("depth", "digest")).alias("g1"), F.when(start, 0).otherwise(F.xxhash64(F.lit(7), "digest", "depth")).alias("g2"))
    d = d.withColumn("run", F.floor(F.col("depth") / RUN).cast("long"))
    within = W.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = written(d.select("conv_id", "depth", "run", "bytes", "is_end", "g1", "g2", F.bit_xor("g1").over(within).alias("x1"), F.bit_xor("g2").over(within).alias("x2")), "runs")
    # one row for each full run; each holds for all runs after it
    full = d.where(F.col("depth") % RUN == RUN - 1)
    upto = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = full.select("conv_id", (F.col("run") + 1).alias("run"), F.bit_xor("x1").over(upto).alias("b1"), F.bit_xor("x2").over(upto).alias("b2"))
    k = lambda i: F.col(f"x{i}").bitwiseXOR(F.coalesce(F.col(f"b{i}"), F.lit(0)))
    keys = d.join(before, ["conv_id", "run"], "left").select("conv_id", "depth", "bytes", "is_end", "g1", "g2", k(1).alias("k1"), k(2).alias("k2"))
    return keys.select("conv_id", "depth", "bytes", "is_end", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("up2"))


def merged_nodes(keys: DataFrame) -> DataFrame:
    """(k1, k2, depth, up1, up2, bytes, conv_id, n_convs): one row for each node."""
    part = keys.withColumn("part", F.spark_partition_id() % PARTS).withColumn("n_convs", F.lit(1).cast("long"))
    merge = (F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *(F.first(x).alias(x) for x in ("up1", "up2", "bytes")))
    return part.groupBy(*NODE, "part").agg(*merge).groupBy(*NODE).agg(*merge)


def end_lists(keys: DataFrame) -> DataFrame:
    """(k1, k2, depth, first, ids): the conversations that end at each node, as sorted pieces of at most PIECE ids, joined by commas.

    Ends are dealt by ranges of (node, id), so those of one node may lie in many tasks.
    """
    ends = keys.where("is_end").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        piece = lambda: (*node, ids[0], ",".join(map(str, ids)))
        for b in batches:
            out = []
            for *at, i in zip(*(c.to_pylist() for c in b.columns)):
                if at != node or len(ids) == PIECE:
                    if ids:
                        out.append(piece())
                    node, ids = at, []
                ids.append(i)
            if out:
                yield _rows(out)
        if ids:
            yield _rows([piece()])

    def _rows(out):
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out))[:4]), pa.array([x[4] for x in out], pa.string())], [*NODE, "first", "ids"])

    return ends.mapInArrow(run, "k1 long, k2 long, depth long, first long, ids string")


def end_digests(keys: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): the digest of each node's whole list of ends, piece by piece in one pass."""
    pieces = end_lists(keys).repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            out = []
            for *at, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if at == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
            if out:
                yield _rows(out)
        if node:
            yield _rows([(*node, digest.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])

    return pieces.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def sums_before(df: DataFrame, key: str, order: str, names: list[str]) -> DataFrame:
    """``df`` with ``before_<name>``: the sum over the rows of its key with a smaller ``order`` (a whole number, once a key).

    Runs of RUN numbers are summed by themselves, then what stands before each run.
    """
    d = df.withColumn("_run", F.floor(F.col(order) / RUN).cast("long"))
    runs = d.groupBy(key, "_run").agg(*(F.sum(x).alias(f"_{x}") for x in names))
    upto = W.partitionBy(key).orderBy("_run")
    runs = runs.select(key, "_run", *((F.sum(f"_{x}").over(upto) - F.col(f"_{x}")).alias(f"_{x}") for x in names))
    within = W.partitionBy(key, "_run").orderBy(order)
    d = d.select("*", *((F.sum(x).over(within) - F.col(x)).alias(f"_in_{x}") for x in names)).join(runs, [key, "_run"])
    return d.select(*df.columns, *((F.col(f"_{x}") + F.col(f"_in_{x}")).alias(f"before_{x}") for x in names))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(k1, k2, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node.

    conv_id: the least member, whose first ``depth`` turns the node is.
    """
    keys = written(node_keys(sequences), "keys")
    trie = written(merged_nodes(keys), "trie")
    up = [F.col("up1").alias("k1"), F.col("up2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    children = trie.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = trie.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(sums_before(nodes, "conv_id", "depth", ["leaf", "saved"]), "nodes")

    # chains: the nodes of one least member
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved_all"))
    passing = keys.select(*NODE, "conv_id").join(chains, "conv_id").where("depth < top")
    others = passing.groupBy(*NODE).agg(F.sum("leaves").alias("other_leaves"), F.sum("saved_all").alias("other_saved"))
    summed = nodes.join(chains, "conv_id").join(others, NODE, "left")
    total = lambda whole, name, other: F.col(whole) - F.col(f"before_{name}") + F.coalesce(F.col(other), F.lit(0))
    # inside a chain the parent has the same least member; the parent of a chain's top is looked up
    tops = nodes.join(chains, "conv_id").where("depth = top AND depth > 0").select(F.col("conv_id"), "depth", *(c.alias(f"_{x}") for x, c in zip(NODE, up)))
    least = trie.select(*(F.col(x).alias(f"_{x}") for x in NODE), F.col("conv_id").alias("parent"))
    parents = tops.join(least, [f"_{x}" for x in NODE]).select("conv_id", "depth", "parent")
    d = summed.join(parents, ["conv_id", "depth"], "left").join(end_digests(keys), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    none = hashlib.sha256().hexdigest()
    return d.select(
        "k1", "k2", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", total("leaves", "leaf", "other_leaves").alias("n_leaves"),
        total("saved_all", "saved", "other_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_sequences(turns_in_order(table(spark, sf_dir, "conversations")))).drop("k1", "k2")


def oracle() -> str:
    digest = "md5(length(role) || ':' || role || text)"
    bits = "list_reduce([x::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
    return f"""
WITH RECURSIVE byte_crc AS (SELECT x, {bits} AS y FROM (SELECT unnest(range(256)) AS x)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {digest}) AS pos FROM turns),
crc(conv_id, rest, state) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM turns
  UNION ALL SELECT conv_id, substr(rest, 2), xor(state >> 8, y) FROM crc JOIN byte_crc ON x = xor(state & 255, ord(substr(rest, 1, 1))) WHERE rest <> ''),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS head, xor(state, 4294967295) % {HEADS} AS h FROM crc WHERE rest = ''),
joined AS (
  SELECT c.conv_id, 0 AS own_turn, pos, role, text FROM c JOIN own ON own.conv_id = head AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN own USING (conv_id) WHERE pos > h),
r AS (SELECT conv_id, row_number() OVER w AS depth, list(length(role) || ':' || role || text) OVER w AS path, strlen(text) AS bytes FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own_turn, pos)),
m AS (SELECT conv_id, 0 AS depth, []::VARCHAR[] AS path, 0 AS bytes FROM c UNION ALL SELECT * FROM r),
ends AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved, sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM m LEFT JOIN ends AS e USING (conv_id, depth) GROUP BY depth, path),
kids AS (SELECT p.depth, p.path, count(*) AS n FROM nodes AS p JOIN nodes AS k ON k.depth = p.depth + 1 AND k.path[1:p.depth] = p.path GROUP BY ALL),
n AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path))
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens, v.ends_sha256
FROM n AS v JOIN n AS u ON u.depth >= v.depth AND u.path[1:v.depth] = v.path LEFT JOIN n AS p ON p.depth = v.depth - 1 AND v.path[1:p.depth] = p.path
GROUP BY ALL"""
