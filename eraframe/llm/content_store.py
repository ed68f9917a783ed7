"""Token ids in a content-addressed store: rolling-hash chunks kept once, document recipes, Merkle manifests.

Layout under one folder: parts/ (chunk=1: digest, payload), recipes/ (rid, doc_id, n_tokens, ids_crc32, digests) with rid
and doc_id ascending from file to file, manifest/ (one row for each recipe file: its documents, ids and Merkle root).
Recipes state the CRC of the ids as they were encoded, and the roots cover it, so that documents put together again from
their chunks can be held against the manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, scratch, text_slices
from .tokens import encoder

LEAST, MOST, MASK, WINDOW = 256, 2048, (1 << 9) - 1, 16
DIGEST = 16


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW ids up to each position: the sum of their codes, each doubled with its distance."""
    code = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    total = code.copy()
    for k in range(1, WINDOW):
        total[k:] += code[:-k] << np.uint64(k)
    return total


def cuts(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of ids start..end: at the first mark from LEAST ids on, else after MOST, else at the end."""
    out, at = [], start
    while end - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        cut = min(int(marks[i]) if i < len(marks) else end, at + MOST, end)
        if cut >= end:
            break
        out.append(cut)
        at = cut
    out.append(end)
    return out


def _chunked(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        seen: set[bytes] = set()
        for batch in text_slices(batches, "text"):
            texts = [x + end for x in enc.encode(batch.column(1))]
            ids = np.frombuffer(b"".join(texts), "<u4")
            small = ids.astype(f"<u{enc.width}").tobytes()
            marks = np.flatnonzero((rolling(ids) >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
            rows: list[tuple] = []
            at = 0
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                digests, stop = [], at + len(text) // 4
                for cut in cuts(marks, at, stop):
                    payload = small[at * enc.width : cut * enc.width]
                    d = hashlib.blake2b(payload, digest_size=DIGEST).digest()
                    digests.append(d)
                    if d not in seen:  # a chunk leaves this task once, or again after very many others
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(d)
                        rows.append((1, int.from_bytes(d[:8], "little", signed=True), None, d, payload, None, None))
                    at = cut
                crc = zlib.crc32(text)
                rows.append((0, crc if doc is None else doc, doc, b"".join(digests), None, len(text) // 4, crc))
            cols = list(zip(*rows, strict=True))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk", "key", "doc_id", "a", "b", "n_tokens", "ids_crc32"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeats of a chunk; all rows of a digest are in one partition, in order."""
    last = None
    for b in batches:
        keep = []
        for chunk, d in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep.append(not chunk or d != last)
            last = d if chunk else None
        yield b.filter(pa.array(keep, pa.bool_()))


def leaf(doc_id: int | None, n: int, crc: int, digests: bytes) -> bytes:
    return hashlib.blake2b(f"{doc_id}:{n}:{crc}:".encode() + digests, digest_size=32).digest()


def merkle(level: list[bytes]) -> bytes:
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=32).digest() for i in range(0, len(level), 2)]
    return level[0]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A manifest row for the recipe files in this task, from their rows in order; leaves are folded as they come."""
    parts: dict[int, list] = {}
    for b in batches:
        for rid, doc, n, crc, digests in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            p = parts.setdefault(rid >> 33, [0, 0, rid, doc, doc, []])
            p[0] += 1
            p[1] += n
            p[4] = doc
            p[5].append(leaf(doc, n, crc, digests))
    rows = [(k, p[0], p[1], p[2], p[3], p[4], merkle(p[5]).hex()) for k, p in parts.items()]
    names = ["file", "n_docs", "n_ids", "rid", "first_doc", "last_doc", "root"]
    types = [pa.int64()] * 6 + [pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


MANIFEST = "file long, n_docs long, n_ids long, rid long, first_doc long, last_doc long, root string"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> str:
    """Encode whole texts (null: empty), append end_id, and write the store under path.

    One shuffle moves the chunks, each at most once from a task, to the partition of their digest; recipes, which are
    small, are then sorted by doc_id. Repeated rows have a recipe each. An empty table gives empty folders.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunked(tokenizer, end_id), "chunk int, key long, doc_id long, a binary, b binary, n_tokens long, ids_crc32 long")
    rows = rows.repartition("key").sortWithinPartitions("chunk", "a").mapInArrow(_once, rows.schema)
    rows.drop("key").write.option("compression", "zstd").partitionBy("chunk").parquet(f"{path}/parts")
    parts = spark.read.schema("doc_id long, a binary, n_tokens long, ids_crc32 long, chunk int").option("basePath", f"{path}/parts").parquet(f"{path}/parts")
    recipes = parts.where("chunk = 0").repartitionByRange("doc_id", "a").sortWithinPartitions("doc_id", "a")
    recipes = recipes.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_tokens", "ids_crc32", F.col("a").alias("digests"))
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    read_recipes(spark, path).mapInArrow(_roots, MANIFEST).groupBy("file").agg(*[F.first(c).alias(c) for c in ("n_docs", "n_ids", "rid", "first_doc", "last_doc", "root")]).write.parquet(f"{path}/manifest")
    return path


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with one task a file, as the manifest is about files."""
    return spark.read.schema("rid long, doc_id long, n_tokens long, ids_crc32 long, digests binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("a binary, b binary, chunk int").option("basePath", f"{path}/parts").parquet(f"{path}/parts")
    return rows.where("chunk = 1").select(F.col("a").alias("digest"), F.col("b").alias("payload"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as they are, each held against its digest."""
    for b in batches:
        for d, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if hashlib.blake2b(payload, digest_size=DIGEST).digest() != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
        yield b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe: rid, seq, digest."""
    for b in batches:
        digests = b.column(1).to_pylist()
        counts = [len(x) // DIGEST for x in digests]
        cols = [np.repeat(b.column(0).to_numpy(), counts), np.concatenate([np.arange(n) for n in counts] or [[]]), [d[i : i + DIGEST] for d in digests for i in range(0, len(d), DIGEST)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["rid", "seq", "digest"])


def _rebuilt(width: int):
    """From rows (rid, payload) in order: ids and the CRC of the ids of each document, which itself is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, crc = None, 0, 0
        for b in batches:
            out = []
            for rid, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rid != last:
                    out += [] if last is None else [(last, n, crc)]
                    last, n, crc = rid, 0, 0
                ids = np.frombuffer(payload, f"<u{width}")
                n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
            yield _facts(out)
        yield _facts([] if last is None else [(last, n, crc)])

    return run


def _facts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["rid", "n", "crc"])


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless each recipe file gives the Merkle root in the manifest."""
    again = read_recipes(spark, path).mapInArrow(_roots, MANIFEST).select("file", F.col("root").alias("found"), F.col("n_ids").alias("ids"))
    bad = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").join(again, "file", "full").where("not (root <=> found and n_ids <=> ids)")
    if not bad.isEmpty():
        raise ValueError("recipes don't match the manifest")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """rid, seq, payload of every chunk of every document; each chunk that is stored is read and checked once."""
    links = read_recipes(spark, path).select("rid", "digests").mapInArrow(_links, "rid long, seq int, digest binary")
    return links.join(read_chunks(spark, path).mapInArrow(_checked, "digest binary, payload binary"), "digest").select("rid", "seq", "payload")


def digests(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Per document, from the files: rid, doc_id, start, n_tokens, ids_crc32 of the ids as little-endian 32-bit numbers.

    Every document is put together again from its chunks; the query fails if the number of its ids or their CRC is not
    what its recipe states, which `verify` holds against the manifest.
    """
    recipes = read_recipes(spark, path)
    again = _payloads(spark, path).repartition("rid").sortWithinPartitions("rid", "seq").select("rid", "payload").mapInArrow(_rebuilt(width), "rid long, n long, crc long")
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before"))  # one row a file
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    docs = recipes.select("rid", "doc_id", "n_tokens", "ids_crc32", F.shiftright("rid", 33).alias("file")).withColumn("within", within).join(files, "file")
    docs = docs.join(again, "rid", "left")
    same = F.col("n").eqNullSafe(F.col("n_tokens")) & F.col("crc").eqNullSafe(F.col("ids_crc32"))
    crc = F.when(same, F.col("crc")).otherwise(F.raise_error(F.lit("a document put together again differs from its recipe")).cast("long"))
    return docs.select("rid", "doc_id", (F.col("before") + F.col("within")).alias("start"), F.col("n").alias("n_tokens"), crc.alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The documents' ids again: rid, doc_id, ids (array of int). A document is one row, so it is held as a whole."""
    rows = _payloads(spark, path).join(read_recipes(spark, path).select("rid", "doc_id"), "rid")

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        ids = np.frombuffer(b"".join(group.column("payload").to_pylist()), f"<u{width}").astype(np.int32)
        return pa.table({"rid": group.column("rid")[:1], "doc_id": group.column("doc_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return rows.groupBy("rid").applyInArrow(join, "rid long, doc_id long, ids array<int>")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "store"), word_bpe())
    verify(spark, path)
    return digests(spark, path, encoder(word_bpe()).width).select("doc_id", "start", "n_tokens", "ids_crc32")
