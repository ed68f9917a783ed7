"""A Merkle manifest of a dataset with a witness for each document, kept up to date as nodes are appended.

Fan-out is 3. Nodes of a key (a source) are dealt into blocks of 81 that lie on multiples of 81, so a block's root is a
node of the whole tree. A block is one stream of appends to an OpenTree: a node that arrives gets the open siblings before
it as a partial witness, and extends the witnesses of all nodes below those. Block roots are then appended to the next
tier in the same way, until one node a source is left; the subroots of all sources are appended to the last tree.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

FAN, LEVELS = 3, 4
BLOCK = FAN**LEVELS
PATH = "array<struct<l:string,r:string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class OpenTree:
    """Nodes 0, 1, 2 ... are appended; paths[i] holds for each level above node i its siblings to the left and right."""

    def __init__(self) -> None:
        self.paths: list[list[list[str]]] = []
        self.open: list[list[tuple[str, int, int]]] = []  # by level, up to FAN - 1 open subtrees: digest, first node, end

    def append(self, digest: str) -> None:
        self.paths.append([])
        self._add(0, digest, len(self.paths) - 1, len(self.paths))

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for _, a, b in run:  # the new sibling extends what the open subtrees hold
            for path in self.paths[a:b]:
                path[level][1] += digest
        before = "".join(d for d, _, _ in run)
        for path in self.paths[first:end]:
            path.append([before, ""])
        run.append((digest, first, end))
        if len(run) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._add(level + 1, sha("".join(d for d, _, _ in run)), run[0][1], run[-1][2])

    def close(self, levels: int) -> str:
        """Complete the last runs, however short, up to a level; gives the one node that is left there."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        [(root, _, _)] = self.open[levels]
        for path in self.paths:
            del path[levels:]
        return root


def height(n: int) -> int:
    """Levels over n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _block(nodes: pa.Table) -> pa.Table:
    """One block's nodes, in order of pos, with their paths in the block and its root."""
    nodes = nodes.sort_by("pos")
    tree = OpenTree()
    for digest in nodes.column("digest").to_pylist():
        tree.append(digest)
    n = nodes.column("n")[0].as_py()
    root = tree.close(LEVELS if n > BLOCK else height(n))
    paths = pa.array([[{"l": a, "r": b} for a, b in path] for path in tree.paths], pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))
    return nodes.append_column("path", paths).append_column("top", pa.array([root] * len(nodes), pa.string()))


def positions(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Add pos (from 0, within the key, by order) and n (rows of the key).

    Rows are dealt by ranges of key and order, so that a key with most rows lies in many tasks; only counts of each range
    are summed up.
    """
    rows = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    rows = materialize(rows.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    own = Window.partitionBy(*key)
    found = rows.groupBy("_range", *key).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    found = found.withColumn("_before", F.sum("_rows").over(own.orderBy("_range")) - F.col("_rows")).withColumn("n", F.sum("_rows").over(own))
    found = found.select(*[F.col(c).alias(f"_of_{c}") for c in ("_range", *key)], (F.col("_before") - F.col("_first")).alias("_shift"), "n")
    same = F.col("_range") == F.col("_of__range")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    keep = [c for c in rows.columns if c not in ("_range", "_row")]
    return rows.join(found, same).select(*keep, (F.col("_row") + F.col("_shift")).alias("pos"), "n")


def grow(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (key, pos, n, digest and other columns) with path, their siblings level by level up to the key's root, and root.

    A tier's work is proportional to its nodes, a group holds at most 81 of them, and each tier is written before the next.
    """
    tiers = []
    now = nodes
    while True:
        now = now.withColumn("block", F.expr(f"pos div {BLOCK}"))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields)
        done = materialize(now.groupBy("key", "block").applyInArrow(_block, f"{types}, path {PATH}, top string"), name)
        tiers.append(done)
        if (done.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            break
        now = done.where(f"pos % {BLOCK} = 0").select("key", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"))
    above = tiers.pop().withColumnRenamed("top", "root")
    while tiers:
        below = tiers.pop()
        up = above.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), "root")
        above = below.join(up, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_pos")))
        above = above.withColumn("path", F.concat("path", "_path")).drop("_key", "_pos", "_path", "top")
    return above.drop("block")


def leaf(*values: Column) -> Column:
    """Digest of values: - where null, else byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf gives with its siblings."""
    return F.aggregate(path, digest, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))


def manifest(docs: DataFrame, *changed: Column) -> DataFrame:
    """One row for each document: doc_id, source, leaf, subroot, root, path (siblings up to the root), and for each Column
    of changed another text's leaf as changed0, changed1 ...

    Leaves of a source ascend by doc_id (null first; equal ids by their digest); sources ascend by UTF-8 bytes, null
    first. Nulls are told from empty values; repeated rows are leaves of their own; an empty table gives no rows; columns
    beyond the five that are hashed don't matter.
    """
    doc_id, source = docs["doc_id"], docs["source"].cast("string")
    make = lambda text: leaf(doc_id, source, docs["lang"], docs["n_chars"], text)
    rows = docs.select(source.alias("key"), doc_id.alias("doc_id"), make(docs["text"]).alias("digest"), *[make(t).alias(f"changed{i}") for i, t in enumerate(changed)])
    rows = materialize(rows, "digests")  # dealing by ranges reads its input twice, which should not be the texts
    leaves = grow(positions(rows, ["key"], ["doc_id", "digest"], "leaves"), "tree").withColumnRenamed("root", "subroot").drop("pos", "n")
    leaves = materialize(leaves.withColumnRenamed("path", "below"), "witness")
    roots = positions(leaves.groupBy(F.col("key").alias("source")).agg(F.first("subroot").alias("digest")).withColumn("key", F.lit(0)), ["key"], ["source"], "sources")
    roots = grow(roots, "top").select(F.col("source").alias("_source"), F.col("path").alias("above"), "root")
    out = leaves.join(roots, F.col("key").eqNullSafe(F.col("_source")))
    return out.select("doc_id", F.col("key").alias("source"), F.col("digest").alias("leaf"), "subroot", "root", F.concat("below", "above").alias("path"), *[f"changed{i}" for i in range(len(changed))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    text = docs["text"].cast("string")
    rows = manifest(docs, F.when(F.coalesce(hit, F.lit(False)), F.translate(text, "\n", "")).otherwise(text))
    back = folded(F.col("changed0"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
