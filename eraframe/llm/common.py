"""Shared helpers: scratch tables, Arrow batch handling, word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract of this subpackage has them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="eraframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of fewer rows, so that a batch stays at a few MB in either process."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], col: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about max_bytes (one long text may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(col)
        text = batch.column(at)
        if text.null_count or text.type != pa.large_string():
            text = text.cast(pa.large_string()).fill_null("")
        batch = batch.set_column(at, pa.field(col, pa.large_string()), text)
        _, offsets = raw_text(text)
        part = (offsets - offsets[0]) // max_bytes
        cuts = np.flatnonzero(np.diff(part[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def raw_text(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than texts) of a large_string array without nulls."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = tuple(both)
        if size <= 2 * SLICE_BYTES:
            _POWERS[0] = have
    return have


class Words:
    """Words of a slice of texts: first and end byte, 64-bit hash (A-Z lower-cased), and per text the first word."""

    def __init__(self, text: pa.Array, lower: bool = True):
        data, offsets = raw_text(text)
        self.base = int(offsets[0])
        self.bytes = data[self.base : int(offsets[-1])]
        self.doc_bytes = offsets - self.base
        solid = ~IS_SPACE[self.bytes]
        edge = np.zeros(len(solid) + 1, bool)  # edge i: a text ends before byte i
        edge[self.doc_bytes] = True
        before = np.empty(len(solid), bool)
        after = np.empty(len(solid), bool)
        if len(solid):
            before[0] = after[-1] = False
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, self.doc_bytes)
        self.lower = lower

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Polynomial hashes modulo 2**64 of byte ranges (the words by default), by prefix sums, then mixed with the length."""
        start, end = self.start if start is None else start, self.end if end is None else end
        if not len(start):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.bytes) + 1)
        code = LOWER[self.bytes] if self.lower else self.bytes
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal keys from a partition that is sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        head = tuple(c[0].as_py() for c in cols)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *at, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(int(a), int(b - a)))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[batch.num_rows - 1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of a partition's edges: at most one edge for each node, in bounded pieces."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [(u, v) for u, v in pairs if u != v]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long) as (node, root), root the smallest node, for nodes with an edge.

    Alternating large-star and small-star steps as joins on the smallest neighbour, each round written to the shared
    folder, until a round changes nothing. A hub's edges are never gathered: nodes with more than a thousandth of all
    edge ends are fewer than 1000, so they are broadcast with their smallest neighbour to wherever their edges lie.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = edges.mapInArrow(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    was = state(e)
    while was[0]:
        many = max(1000, 2 * was[0] // 1000)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hubs = low.where(F.col("n") > many).select("u", F.col("m").alias("of_hub"))
        up = both.where("v > u").join(F.broadcast(hubs), "u", "left")
        large = up.where("of_hub is null").drop("of_hub").join(low.where(F.col("n") <= many), "u").select("u", "v", "m")
        large = large.unionByName(up.where("of_hub is not null").withColumnRenamed("of_hub", "m"))
        large = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialize(small.distinct(), "edges")
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
