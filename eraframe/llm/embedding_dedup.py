"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, runs

BLOCK = 1024


def plan_tables(n: int, cosine: float, per_bucket: int = 64, miss: float = 1e-3) -> tuple[int, int]:
    """Bits and tables for n vectors: about per_bucket vectors share a bucket by chance, and a pair at the threshold
    is in no common bucket with probability miss at most. Both follow n alone."""
    bits = max(6, math.ceil(math.log2(max(2, n) / per_bucket)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _keys(kind: str):
    """vec_id, and key and the vector (as it is stored, single or double) where it is of use: not null, not zero, finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # nulls are NaN, -0 is 0
            end = np.cumsum(length)
            odd, some = (np.concatenate([[0], np.cumsum(y)]) for y in (~np.isfinite(x), x != 0))
            use = (odd[end] == odd[end - length]) & (some[end] > some[end - length])
            data, width = x.tobytes(), x.itemsize
            rows = [data[width * (e - n) : width * e] if ok else None for ok, n, e in zip(use, length.tolist(), end.tolist(), strict=True)]
            keys = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "little", signed=True) if r else None for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "key", "v"])

    return run


def _scaled(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _tables(bits: int, tables: int, seed: int, kind: str):
    planes: dict[int, np.ndarray] = {}
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                v = b.column(b.schema.get_field_index("v")).to_pylist()
                dims = np.array([len(x) for x in v]) // np.dtype(kind).itemsize
                for dim in np.unique(dims):
                    use = np.flatnonzero(dims == dim)
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                    sign = (_scaled([v[i] for i in use], kind) @ planes[dim] >= 0).reshape(len(use), tables, bits)
                    code = (sign @ weights).astype(np.int64)
                    sig = [row.astype("<i4").tobytes() for row in code]
                    rows = b.take(pa.array(use))
                    for t in range(tables):
                        bucket = pa.array(code[:, t] * np.int64(1 << 20) + np.int64(dim))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), t, np.int32)), bucket, rows.column(0), rows.column(1), rows.column(2), pa.array(sig, pa.binary())], names=["t", "bucket", "key", "mult", "v", "sig"])

    return run


def _bucket_counts(bits: int, tables: int, seed: int, kind: str):
    full = _tables(bits, tables, seed, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in full(batches):
            bucket, n = np.unique(b.column(1).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), b.column(0)[0].as_py(), np.int32)), pa.array(bucket), pa.array(n)], names=["t", "bucket", "n"])

    return run


def _pairs(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["t", "bucket", "i", "j"]):
            if g.num_rows < 2:
                continue
            t = g.column("t")[0].as_py()
            key, mult, block = (g.column(c).to_numpy() for c in ("key", "mult", "block"))
            x = _scaled(g.column("v").to_pylist(), kind)
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<i4").reshape(len(key), -1)
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if g.column("i")[0].as_py() != g.column("j")[0].as_py():
                near &= block[:, None] != block[None, :]
            for e in range(t):  # a pair counts in the first table that has it in one bucket
                near &= sig[:, e][:, None] != sig[:, e][None, :]
            if not near.any():
                continue
            links = near.astype(np.int64) @ mult
            root = np.full(len(key), -1)
            for a in range(len(key)):
                if root[a] >= 0:
                    continue
                seen = np.zeros(len(key), bool)
                seen[a] = True
                front = [a]
                while front:
                    new = near[front].any(0) & ~seen
                    seen |= new
                    front = np.flatnonzero(new).tolist()
                root[seen] = a
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(key[root[on]]), pa.array(links[on])], names=["u", "v", "links"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id by links), kept.

    A vector that is null, zero, or holds null or non-finite components links with nothing; so do vectors of different
    lengths with each other. Equal vectors are one class: they link with each other and share their links, and a class
    is hashed once. Repeated rows are vectors of their own. Pairs in a common bucket of any table are compared in
    double precision, so no link is below the threshold; plan_tables bounds what is missed. A bucket with more than
    `block` classes is dealt to blocks and each pair of blocks compared by itself; a pair is counted once, in its first
    table. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")).mapInArrow(_keys(kind), "vec_id long, key long, v binary")
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("mult"), F.min("v").alias("v"), F.min("vec_id").alias("low")), "vectors")
    ids = materialize(rows.select("vec_id", "key"), "vector-ids")
    bits, tables = plan_tables(classes.count(), cosine)
    short = classes.select("key", "mult", "v")
    hot = short.mapInArrow(_bucket_counts(bits, tables, seed, kind), "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    hot = materialize(hot.select("t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    hashed = short.mapInArrow(_tables(bits, tables, seed, kind), "t int, bucket long, key long, mult long, v binary, sig binary")
    dealt = hashed.join(hot, ["t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "mult", "v", "sig")
    keys = ["t", "bucket", "i", "j"]
    found = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_pairs(cosine, kind), "u long, v long, links long"), "near")
    links = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "key")
    comp = components(found.select("u", "v")).withColumnRenamed("node", "key")
    low = comp.join(classes.select("key", "low"), "key")
    low = low.join(low.groupBy("root").agg(F.min("low").alias("component")), "root").select("key", "component")
    facts = classes.select("key", "mult", "low").join(links, "key", "left").join(low, "key", "left")
    facts = facts.select("key", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "low").alias("c"))
    # written, so that both sides of the join are shuffles of their own and a vector with very many copies can be split
    out = ids.join(materialize(facts, "vector-facts"), "key", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("c")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
