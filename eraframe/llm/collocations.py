"""Collocations: phrases of two to four words that stand together more often than their parts would suggest.

Texts are dealt into shards of about 16 MB. Each has an FM-index in both directions over its word ids: the word before each
suffix and the word after each prefix, in the order of the next (the last) four words, which is as deep as phrases go. A
phrase is an interval of rows in each index; the words in an interval of the one index are the phrase's extensions to the
left with their counts, those of the other its extensions to the right, and each extension gives the intervals of the
longer phrase. Counts are summed over shards. A phrase is as frequent as its least frequent part at most, so shards extend
only what is frequent over all shards: words to pairs, then pairs to the right and the left to three and four words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, materialize, raw_text, text_slices

SHARD_BYTES = 16 << 20
LEAST, KEEP, TOP = 30, 80, 2000

#: 1: between words, 2: between pieces.
GAP = np.zeros(256, np.uint8)
GAP[[0x20, 0x09]] = 1
GAP[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_CODEC = pa.Codec("zstd", compression_level=3)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts (A-Z lower-cased), whether each is the first of its piece, and the texts' first words."""
    data, offsets = raw_text(text)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    gap = GAP[data]
    solid = gap == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    if len(data):
        start[1:] &= ~solid[:-1] | edge[1:-1]
        end[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(start, offsets)
    piece = np.cumsum(gap == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    opens = np.ones(len(start), bool)
    opens[1:] = piece[1:] != piece[:-1]
    opens[first[first < len(start)]] = True
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(LOWER[data[solid]])), opens, first


def ordered(ids: np.ndarray, depth: int = 4) -> np.ndarray:
    """Rows of the cyclic sequence in the order of the next depth ids: radix sort from the last id to the first."""
    order = np.arange(len(ids))
    for step in reversed(range(depth)):
        near = np.roll(ids, -step)
        for digit in (0, 16):
            if not digit or int(ids.max(initial=0)) >> digit:
                order = order[np.argsort((near >> digit).astype(np.uint16)[order], kind="stable")]
    return order


def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes."""
    return _CODEC.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data, decompressed_size=4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def extend(bwt: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words met in intervals of rows: the interval, the word, how often, its first row, and how many words there are lower."""
    size = hi - lo
    begin = np.cumsum(size) - size
    rows = np.repeat(lo - begin, size) + np.arange(size.sum())
    key = np.repeat(np.arange(len(lo)), size) << 32 | bwt[rows]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(head)
    which = key[head] >> 32
    return which, key[head] & 0xFFFFFFFF, np.diff(head, append=len(key)), rows[order[head]], head - begin[which]


class Index:
    """One direction of a shard's FM-index: the neighbour of each row, where each word's rows begin, and ranks of neighbours."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.first = np.zeros(int(bwt.max(initial=0)) + 2, np.int64)
        np.cumsum(np.bincount(bwt), out=self.first[1:])
        self._step: np.ndarray | None = None

    @property
    def step(self) -> np.ndarray:
        """The row of the neighbour: where its word's rows begin, and its rank among the rows that have it."""
        if self._step is None:
            self._step = np.empty(len(self.bwt), np.int64)
            self._step[np.argsort(self.bwt, kind="stable")] = np.arange(len(self.bwt))
        return self._step


INDEX = "shard long, id int, lang string, word string, count long, size long, before binary, after binary"
_INDEX = pa.schema([("shard", pa.int64()), ("id", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("count", pa.int64()), ("size", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])


def _shard(shard: int, docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """A shard's index as one row, and a row for each word with its count. Id 0 ends pieces."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("lang", "ascending")])).combine_chunks()
    runs = pc.run_end_encode(docs.column("lang").chunk(0))
    parts, langs, words, at = [], [], [], 0
    seen = 0
    for lang, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        found, opens, _ = words_of(docs.column("text").chunk(0).slice(at, stop - at))
        at = stop
        coded = found.dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64) + seen + 1
        seen += len(coded.dictionary)
        langs.append(pa.array([lang] * len(coded.dictionary), pa.string()))
        words.append(coded.dictionary.cast(pa.string()))
        parts.append(np.insert(ids, np.flatnonzero(opens), 0))
    ids = np.concatenate([*parts, [0]])
    counts = np.bincount(ids, minlength=seen + 1)
    rank = np.zeros(seen + 1, np.int64)  # frequent words have low ids, which compress well
    often = np.argsort(-counts[1:], kind="stable")
    rank[often + 1] = np.arange(1, seen + 1)
    ids = rank[ids]
    back = ids[::-1].copy()
    before, after = ids[ordered(ids) - 1], back[ordered(back) - 1]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, None, None, None, None, len(ids), packed(before), packed(after)), _INDEX.types, strict=True)], schema=_INDEX)
    none = pa.nulls(seen, pa.binary())
    cols = [pa.array(np.full(seen, shard)), pa.array(rank[1:].astype(np.int32)), pa.concat_arrays(langs), pa.concat_arrays(words), pa.array(counts[1:]), pa.nulls(seen, pa.int64()), none, none]
    yield from pa.Table.from_arrays(cols, schema=_INDEX).to_batches(max_chunksize=100_000)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, number = [], 0, 0
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 24
    for batch in text_slices(batches, "text"):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("text")).nbytes
        if size >= SHARD_BYTES:
            yield from _shard(base + number, pa.Table.from_batches(held))
            held, size, number = [], 0, number + 1
    if held:
        yield from _shard(base + number, pa.Table.from_batches(held))


def _keys(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a shard's frequent words here and over all shards, by the first."""
    known = known.filter(pc.is_null(known.column("y")))
    here, there = known.column("id").to_numpy(), known.column("x").to_numpy()
    order = np.argsort(here)
    return here[order].astype(np.int64), there[order]


def _pairs(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard, from the extensions of each word to the left."""
    here, there = _keys(known)
    if not len(here) or not shard.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("shard", "x", "y", "c")})
    index = Index(unpacked(shard.column("before")[0].as_py(), shard.column("size")[0].as_py()))
    which, word, count, _, _ = extend(index.bwt, index.first[here], index.first[here + 1])
    left = np.searchsorted(here, word)
    ok = (left < len(here)) & (here[np.minimum(left, len(here) - 1)] == word)
    return pa.table({"shard": np.full(int(ok.sum()), shard.column("shard")[0].as_py()), "x": there[left[ok]], "y": there[which[ok]], "c": count[ok]})


def _longer(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Phrases of three and four words all of whose pairs are frequent, with a shard's counts."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("x", "y", "z", "u", "c")})
    here, there = _keys(known)
    pairs = known.filter(pc.is_valid(known.column("y")))
    if not pairs.num_rows or not shard.num_rows:
        return empty
    size = shard.column("size")[0].as_py()
    before, after = (Index(unpacked(shard.column(c)[0].as_py(), size)) for c in ("before", "after"))
    order = np.argsort(there)
    x, y = (order[np.searchsorted(there[order], pairs.column(c).to_numpy())] for c in ("x", "y"))
    often = np.sort(x * len(here) + y)  # frequent pairs of places in here

    def frequent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(here) + b
        at = np.minimum(np.searchsorted(often, key), len(often) - 1)
        return (a < len(here)) & (b < len(here)) & (often[at] == key)

    def place(word: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(here, word), len(here) - 1)
        return np.where(here[at] == word, at, len(here))

    lo, hi = before.first[here], before.first[here + 1]
    which, word, count, row, low = extend(before.bwt, lo, hi)  # pairs: a word to the left of another
    a, b = place(word), which
    ok = frequent(a, b)
    a, b, count, lo, right = a[ok], b[ok], count[ok], before.step[row[ok]], lo[which[ok]] + low[ok]
    which, word, more, _, low = extend(after.bwt, right, right + count)  # three words: one to the right of a pair
    d = place(word)
    ok = frequent(b[which], d)
    which, d, more, low = which[ok], d[ok], more[ok], low[ok]
    a, b, lo = a[which], b[which], lo[which] + low
    three = [there[a], there[b], there[d], more]
    which, word, count, _, _ = extend(before.bwt, lo, lo + more)  # four words: one to the left of three
    c = place(word)
    ok = frequent(c, a[which])
    which, c, count = which[ok], c[ok], count[ok]
    four = [there[c], there[a[which]], there[b[which]], there[d[which]], count]
    return pa.table(
        {
            "x": np.concatenate([three[0], four[0]]), "y": np.concatenate([three[1], four[1]]), "z": np.concatenate([three[2], four[2]]),
            "u": pa.concat_arrays([pa.nulls(len(three[0]), pa.int64()), pa.array(four[3])]), "c": np.concatenate([three[3], four[4]]),
        }
    )


def _score(a: Column, *cuts: tuple[Column, Column]) -> Column:
    """The lowest-scoring cut, the first of equal ones, as a struct of score, k, l, r."""
    rows = [F.struct(F.expr("0L").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    return F.array_min(F.transform(F.array(*rows), lambda c: F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)"), (c["l"] + c["r"]).cast("decimal(20,0)")).alias("score"), c["k"], c["l"], c["r"])))


def collocations(docs: DataFrame, least: int = LEAST, keep: int = KEEP, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, as the module describes.

    Null texts hold nothing, null languages are `und`. Repeated rows count each time. Empty tables, and texts without words,
    give no rows. Ties are broken by a and then by the phrase's bytes. Other columns don't matter.
    """
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    index = materialize(docs.mapInArrow(_shards, INDEX), "index")
    vocabulary = index.where("word is not null").select("shard", "id", "lang", "word", "count")
    shards = index.where("size is not null").select("shard", "size", "before", "after")
    words = vocabulary.groupBy("lang", "word").agg(F.sum("count").alias("f"))
    total = materialize(words, "words")
    n = total.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(total.where(F.col("f") >= least).withColumn("w", F.monotonically_increasing_id()), "frequent")
    known = vocabulary.join(words.select("lang", "word", F.col("w").alias("x")), ["lang", "word"]).select("shard", "id", "x", F.lit(None).cast("long").alias("y"))
    known = materialize(known, "known")

    pairs = shards.drop("after").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_pairs, "shard long, x long, y long, c long")
    pairs = pairs.withColumn("a", F.sum("c").over(Window.partitionBy("x", "y"))).where(F.col("a") >= least)
    pairs = materialize(pairs, "pairs")
    both = known.unionByName(pairs.select("shard", F.lit(None).cast("int").alias("id"), "x", "y"))
    longer = shards.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_longer, "x long, y long, z long, u long, c long")
    longer = longer.groupBy("x", "y", "z", "u").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    longer = materialize(longer, "longer")
    two = pairs.groupBy("x", "y").agg(F.first("a").alias("a"))
    three, four = longer.where("u is null").select("x", "y", "z", "a"), longer.where("u is not null")

    def with_count(rows: DataFrame, table: DataFrame, cols: dict[str, str], name: str, count: str = "a") -> DataFrame:
        """Add a part's count as a column; cols names the part's words in table by those of rows."""
        part = table.select(*[F.col(c).alias(f"_{c}") for c in cols], F.col(count).alias(name))
        return rows.join(part, [F.col(r) == F.col(f"_{c}") for c, r in cols.items()]).drop(*[f"_{c}" for c in cols])

    def with_longer(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
        """Drop rows of which an extension by a word at either end holds nearly all."""
        ends = ["x", "y", "z", "u"][: len(names) + 1]
        up = [table.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(part)], F.col("a").alias("_a")) for part in (ends[:-1], ends[1:])]
        up = up[0].unionByName(up[1]).groupBy(*[f"_{i}" for i in range(len(names))]).agg(F.max("_a").alias("_a"))
        rows = rows.join(up, [F.col(c) == F.col(f"_{i}") for i, c in enumerate(names)], "left")
        return rows.where(F.col("_a").isNull() | (100 * F.col("_a").cast("decimal(20,0)") < keep * F.col("a").cast("decimal(20,0)"))).select(*names, "a", "cut")

    one = words.select("w", "f")
    f = F.col
    twos = with_count(with_count(two, one, {"w": "x"}, "l1", "f"), one, {"w": "y"}, "r1", "f").withColumn("cut", _score(f("a"), (f("l1"), f("r1"))))
    threes = with_count(with_count(three, one, {"w": "x"}, "l1", "f"), one, {"w": "z"}, "r2", "f")
    threes = with_count(with_count(threes, two, {"x": "y", "y": "z"}, "r1"), two, {"x": "x", "y": "y"}, "l2")
    threes = threes.withColumn("cut", _score(f("a"), (f("l1"), f("r1")), (f("l2"), f("r2"))))
    fours = with_count(with_count(four, one, {"w": "x"}, "l1", "f"), one, {"w": "u"}, "r3", "f")
    fours = with_count(with_count(fours, two, {"x": "x", "y": "y"}, "l2"), two, {"x": "z", "y": "u"}, "r2")
    fours = with_count(with_count(fours, three, {"x": "x", "y": "y", "z": "z"}, "l3"), three, {"x": "y", "y": "z", "z": "u"}, "r1")
    fours = fours.withColumn("cut", _score(f("a"), (f("l1"), f("r1")), (f("l2"), f("r2")), (f("l3"), f("r3")))).select("x", "y", "z", "u", "a", "cut")

    found = with_longer(twos, three, ["x", "y"]).unionByName(with_longer(threes, four, ["x", "y", "z"]), True).unionByName(fours, True)
    for c in "xyzu":
        found = found.join(words.select(F.col("w").alias(c), F.col("word").alias(f"word_{c}"), *[F.col("lang")] * (c == "x")), c, "inner" if c in "xy" else "left")
    found = found.select("lang", F.concat_ws(" ", *[f"word_{c}" for c in "xyzu"]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for key in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):  # a language's phrases are first thinned in 64 parts
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
