"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .tokens import CACHE_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: one, or of size ids each with the odd rest first."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, with_ids: bool = False, words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and ids (little-endian 32-bit) if asked for.

    Each Python worker keeps the ids of about `words` words (and as many older ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, words), np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches, "text"):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start : 4 * (start + length)]
                    for col, x in zip(out, (doc, k, start, length, zlib.crc32(part), part), strict=False):
                        col.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


#: The shortest piece of a pair, as a share of the bin, that a swap may take: small pieces fill the gaps of later bins.
FLOORS = (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1)


def fewest_bins(counts: np.ndarray, size: int) -> list[tuple[int, dict[int, int]]]:
    """The best_two_fit plan with the fewest bins of those for FLOORS, the last of which makes no swap that spends pieces;
    a plan is made of the numbers of pieces a length alone."""
    plans = [best_two_fit(counts, size, int(f * size)) for f in FLOORS]
    return min(plans, key=lambda bins: sum(times for times, _ in bins))


def best_two_fit(counts: np.ndarray, size: int, floor: int = 0) -> list[tuple[int, dict[int, int]]]:
    """Bins for counts[length] pieces of each length: (how many bins, {length: pieces in each such bin}).

    A bin is filled greedily, the largest piece that fits first. Then its smallest piece may give way to the two
    unpacked pieces, neither shorter than floor, that fit the gap left by it most tightly, if together they are longer. As
    the same bin comes out again until a length that it uses runs short, it is made that many times at once; the work
    follows the number of lengths, not of pieces.
    """
    counts, bins = counts.astype(np.int64).copy(), []
    lengths = np.arange(len(counts))
    while True:
        have = np.flatnonzero(counts)
        if not len(have):
            return bins
        left, gap, need = counts.copy(), size, {}
        while gap > 0:
            fit = have[: np.searchsorted(have, gap, "right")]
            fit = fit[left[fit] > 0]
            if not len(fit):
                break
            x = int(fit[-1])
            k = min(gap // x, int(left[x]))
            need[x] = need.get(x, 0) + k
            left[x] -= k
            gap -= k * x
        if gap > 0 and len(need) + max(need.values()) > 2:
            small = min(need)
            room = gap + small
            a = lengths[1 : room][left[1:room] > 0]
            a = a[a >= max(1, floor)]
            if len(a):
                at = np.searchsorted(a, room - a, "right") - 1
                ok = at >= 0
                b = a[np.maximum(at, 0)]
                ok &= (a != b) | (left[a] >= 2)
                both = np.where(ok, a + b, 0)
                # a pair of one piece twice needs two of it; the next shorter piece is the other choice
                prev = np.maximum(at - 1, 0)
                both = np.maximum(both, np.where(~ok & (at >= 1), a + a[prev], 0))
                best = int(both.argmax())
                if both[best] > small:
                    x = int(a[best])
                    y = int(both[best] - x)
                    need[small] -= 1
                    if not need[small]:
                        del need[small]
                    for z in (x, y):
                        need[z] = need.get(z, 0) + 1
        times = min(int(counts[x]) // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= times * k
        bins.append((times, need))


def slots(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: rows sorted by (length, first rank) with the bins' first number, the
    pieces of the length in such a bin and their place. The rows are fewer than a few times the lengths."""
    rows, used, number = [], {}, 0
    for times, need in bins:
        at = 0
        for length in sorted(need, reverse=True):
            k = need[length]
            rows.append((length, used.get(length, 0), number, k, at))
            used[length] = used.get(length, 0) + times * k
            at += k * length
        number += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {n: table[:, i] for i, n in enumerate(("length", "rank", "number", "each", "at"))}


def pack(parts: DataFrame, size: int = 2048, group: int = 256) -> DataFrame:
    """Give each piece (doc_id, piece, length, ...) its sequence_id and offset; parts must be a stored table.

    Only the number of pieces of each length goes to the driver: at most `size` numbers, whatever the input. Pieces of
    a length are ranked in groups of about `group` by hash, so a length that most pieces have is many groups.
    """
    spark = parts.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():
        counts[length] = n
    table = slots(fewest_bins(counts, size))
    groups = F.array(*[F.lit(int(-(-c // group)) or 1) for c in counts])
    rows = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.get(groups, F.col("length").cast("int"))))
    sizes = rows.groupBy("length", "grp").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = sizes.select("length", "grp", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = rows.withColumn("in_group", rank).join(sizes, ["length", "grp"]).withColumn("rank", F.col("before") + F.col("in_group"))
    rows = rows.select(*parts.columns, "rank")
    key = table["length"] * np.int64(1 << 40) + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * np.int64(1 << 40) + rank, "right") - 1
            t = rank - table["rank"][at]
            each = table["each"][at]
            cols = [*b.columns[:-1], pa.array(table["number"][at] + t // each), pa.array(table["at"][at] + t % each * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, words: int = CACHE_WORDS) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id. Repeated rows are packed each; other columns are ignored; an empty
    table gives no rows. Documents of more than size ids are cut into pieces of size, the first taking the odd rest.
    """
    return pack(materialize(pieces(docs, tokenizer, end_id, size, words=words), "pieces"), size)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (array of int), from the layout and the texts again."""
    parts = pieces(docs, tokenizer, end_id, size, with_ids=True).select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece", "ids"])
    rows = packed.join(parts, (packed.doc_id.eqNullSafe(parts.doc_id)) & (packed.piece == parts.piece) & (F.crc32(parts.ids) == packed.ids_crc32)).select(packed["*"], "ids")

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<u4").astype(np.int32)
        return pa.table({"sequence_id": group.column("sequence_id")[:1], "length": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return rows.groupBy("sequence_id").applyInArrow(join, "sequence_id long, length long, ids array<int>")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe(), words=400_000)
