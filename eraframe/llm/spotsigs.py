"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, materialize, mix, text_slices

U = np.uint64

# Common words of English, French, Spanish and German, the anchors.
ANCHORS = """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
they this to was were what which who will with you au aux avec ce ces dans de des du elle en est et il ils la le les leur
mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous al como con del el es esta la las lo los mas no
para pero por que se si sin sobre su sus un una y auf aus bei das dass dem den der des die ein eine einem einen einer er
es für ich im in ist mit nicht sich sie sind um und von war wie wir zu zum zur""".split()

#: A chain: content words after an anchor, each GAP content words from the one before.
CHAIN, GAP = 2, 1
#: Beside its anchor chains, of whose repeats one in SHARE counts, by hash, each text has one in SHARE of the signatures of
#: chains after any of its words, and the LEAST first by hash at any rate; so sets of near copies are alike in kind, whatever their length and density.
SHARE, LEAST = 8, 128

IS_MARK = np.zeros(256, bool)
IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare_words(text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of the texts, and their first and end bytes without the ASCII marks around them, however many (words of marks
    alone stay whole)."""
    words = Words(text)
    n = len(words.bytes)
    at, plain = np.arange(n), ~IS_MARK[words.bytes]
    last = np.maximum.accumulate(np.where(plain, at, -1))  # the last byte up to each that is no mark
    following = np.minimum.accumulate(np.where(plain, at, n)[::-1])[::-1]
    start, end = following[words.start], last[words.end - 1] + 1
    some = start < words.end
    return words, np.where(some, start, words.start), np.where(some, end, words.end)


def _anchor_keys() -> np.ndarray:
    return np.unique(Words(pa.array([*dict.fromkeys(ANCHORS)], pa.large_string())).hashes())


def spot_sets(text: pa.Array, anchors: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit signatures of each text, never none: a text without words has one for its bytes.

    A signature stands for a chain and for how many times the text held it before, so the Jaccard likeness of two sets
    estimates that of the bags of their chains, and is it where nothing is left out: a text that repeats itself keeps its
    weight."""
    words, start, end = bare_words(text)
    h = words.hashes(start, end)
    doc = words.doc()
    is_anchor = np.isin(h, anchors)

    def chains(at: np.ndarray, content: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """(text, 64-bit value) of the chains that start at the words `at`; unless whole, the text's end may cut a chain."""
        nxt = np.searchsorted(content, at, "right")
        value, ok = h[at] + U(whole), np.ones(len(at), bool)
        for k in range(CHAIN):
            to = np.minimum(nxt + k * GAP, max(len(content) - 1, 0))
            there = (nxt + k * GAP < len(content)) & (doc[content[to]] == doc[at]) if len(content) else np.zeros(len(at), bool)
            ok &= there
            link = np.where(there, h[content[to]], U(0)) if len(content) else U(0)
            value = mix(value * U(0x9E3779B97F4A7C15) + link + U(k + 1))
        return (doc[at][ok], value[ok]) if whole else (doc[at], value)

    spots, spot_values = chains(np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor), True)
    every = np.arange(len(h))
    more, more_values = chains(every, every, False)
    more, more_values, _ = counted(more, more_values)
    rank = np.arange(len(more)) - np.searchsorted(more, np.arange(len(words.counts)))[more]
    chosen = (more_values < U((1 << 64) // SHARE)) | (rank < LEAST)
    spots, spot_values, again = counted(spots, spot_values)
    kept = ~again | (spot_values < U((1 << 64) // SHARE))
    owner = np.concatenate([spots[kept], more[chosen]])
    value = np.concatenate([spot_values[kept], more_values[chosen]])
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    cut = np.searchsorted(owner, np.arange(len(words.counts) + 1))
    out = [np.unique(value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i, s in enumerate(out):
        if not len(s):
            data = words.bytes[words.doc_bytes[i] : words.doc_bytes[i + 1]].tobytes()
            out[i] = np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8")
    return out


def counted(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and chain values to texts, signatures, which also tell a chain's first occurrence in its text from its second
    and so on, and whether it isn't the first; by text, then by signature."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.arange(len(owner))
    value = mix(value + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U) * U(0xD6E8FEB86659FD93))
    order = np.lexsort((value, owner))
    return owner[order], value[order], ~new[order]


def encode(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two signature sets; 0 at once where the set lengths alone keep it below least."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _neighbours(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, tail, text) in order; a tail row is only the text that follows the bucket's last one."""
    held = None
    for batch in text_slices(batches, "text", 2 << 20):
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        rows = rows.combine_chunks()
        texts = rows.column("text").to_pylist()
        tail = rows.column("tail").to_pylist()
        ids = rows.column("doc_id").to_pylist()
        held = rows.slice(rows.num_rows - 1)
        use = [i for i in range(len(texts) - 1) if not tail[i]]
        if not use:
            continue
        changed = [edited(texts[i], texts[i + 1]) for i in use]
        own = spot_sets(pa.array(texts, pa.large_string()), anchors)
        new = spot_sets(pa.array(changed, pa.large_string()), anchors)
        cols = [
            pa.array([ids[i] for i in use], pa.int64()),
            pa.array([len(texts[i]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array([encode(own[i]) for i in use]),
            pa.array([encode(x) for x in new]),
            pa.array([likeness(own[i], x) for i, x in zip(use, new, strict=True)]),
            pa.array([likeness(own[i], own[i + 1]) for i in use]),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every whole text and of its edited text (RESULT): the last quarter of its code points gives way to
    the first as many of the next document's, by doc_id, after the last the first's.

    Texts move once, to the range of doc_id they are in; ranges end at approximate quantiles, and there are four a
    shuffle partition. Each range also gets the first text of the range after it: one text a range, looked up by id.
    Null texts count as empty. Equal doc_ids are in order of their texts; a null doc_id comes first. A single document
    is its own next. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    k = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / k) for i in range(1, k)]), 100 * k).alias("q")).first()[0] if k > 1 else []
    marks = sorted(set(marks or []))
    anchors = _anchor_keys()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(marks, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).fill_null(-(1 << 63)).to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])

    numbered = docs.mapInArrow(number, "bucket int, doc_id long, text string")
    heads = docs.select("doc_id").mapInArrow(number, "bucket int, doc_id long").groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    heads = sorted((r.bucket, None if r.nulls else r.doc_id) for r in heads.collect())  # one row a range
    if not heads:
        return spark.createDataFrame([], RESULT)
    follow = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]
    follow = spark.createDataFrame(follow, "bucket int, head long")
    tails = docs.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket").agg(F.min("text").alias("text"))
    tails = tails.select("bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("tail"), "text")
    rows = numbered.select("bucket", "doc_id", F.lit(0).alias("tail"), "text").unionByName(tails)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    return rows.mapInArrow(lambda batches: _neighbours(batches, anchors), RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, length (signatures in the set), fingerprint; null texts as empty, one row for each row."""
    anchors = _anchor_keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets = spot_sets(b.column(1), anchors)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([encode(s) for s in sets])], names=["doc_id", "length", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, length int, fingerprint string")


ORDER_BITS = 16


def _rare_first(sets: DataFrame) -> np.ndarray:
    """Sets that hold a signature of each of 2**ORDER_BITS classes: the order in which signatures are indexed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount((decode(x) & U((1 << ORDER_BITS) - 1)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["class", "n"])

    rows = sets.select("fingerprint").mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    for r in rows:
        out[r["class"]] = r.n
    return out


def _partition(length: np.ndarray | int, least: float) -> int:
    """Range partitions of set length: sets likelier than least lie in one partition or in two that follow each other."""
    p, low = 0, 1
    while (high := int(low / least + 1e-9) + 1) <= length:
        p, low = p + 1, high
    return p


def near_copies(docs: DataFrame, least: float = 0.8, block: int = 2000) -> DataFrame:
    """Class of every document (doc_id, length, class_id): documents of one class are linked by pairs whose sets have a
    Jaccard likeness of least or more, wherever they are; class_id is the smallest doc_id of the class.

    Equal sets are one set from the start. Sets lie in range partitions of their length, each meeting its own and the
    next. Inside one, an inverted list holds for each set only its rarest signatures, as many as a likely set must share
    one of, and a pair is dropped by its lengths and by what remains after the signature that they share. First every
    set of a list is compared with the list's smallest one; lists whose sets are then of one class are done, and of the
    others only pairs from different classes are compared, lists over `block` sets in salted blocks. All links are
    verified exactly and none is missed. Null texts are empty ones, which are all alike; rows have a row each.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    prints = materialize(fingerprints(docs).withColumn("set", F.xxhash64("fingerprint")), "spotsigs")
    sets = materialize(prints.groupBy("set").agg(F.first("length").alias("length"), F.first("fingerprint").alias("fingerprint")), "spotsets")
    weight = _rare_first(sets)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(6)]
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sig = decode(x)
                n = len(sig)
                k = n - int(np.ceil(least * n - 1e-9)) + 1
                sig = sig[np.lexsort((sig, weight[(sig & U((1 << ORDER_BITS) - 1)).astype(np.int64)]))[:k]].view(np.int64)
                part = _partition(n, least)
                for home in (True, False):
                    for c, v in zip(cols, ([part + (not home)] * k, sig.tolist(), [home] * k, [key] * k, [n] * k, range(n - 1, n - 1 - k, -1)), strict=True):
                        c.extend(v)
            types = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "signature", "home", "set", "length", "rest"])

    at = ["part", "signature"]
    entries = materialize(sets.select("set", "fingerprint").mapInArrow(index, "part int, signature long, home boolean, set long, length int, rest int"), "spotindex")
    small, large = F.least("a.length", "b.length"), F.greatest("a.length", "b.length")
    bound = F.lit(least) / (1 + least) * (F.col("a.length") + F.col("b.length")) - 1e-6
    likely = (small >= least * large - 1e-6) & (1 + F.least("a.rest", "b.rest") >= bound)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [likeness(decode(x), decode(y), least) >= least - 1e-12 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a.set", "b.set").alias("u"), F.greatest("a.set", "b.set").alias("v")).where("u <> v").distinct()
        one, two = (sets.select(F.col("set").alias(k), F.col("fingerprint").alias(f"f{k}")) for k in "uv")
        return materialize(pairs.join(one, "u").join(two, "v").select("u", "v", "fu", "fv").mapInArrow(verified, "u long, v long"), "spotlinks")

    first = entries.where("home").groupBy(*at).agg(F.min_by(F.struct("set", "length", "rest"), "set").alias("s")).select(*at, "s.*")
    found = links(entries.alias("a").join(first.alias("b"), at).where(likely))
    of = components(found).withColumnsRenamed({"node": "set", "root": "class"})
    entries = entries.join(of, "set", "left").withColumn("class", F.coalesce("class", "set"))
    lists = entries.groupBy(*at).agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count_if("home").alias("n")).where("low < high and n > 0")
    lists = lists.select(*at, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    entries = materialize(entries.join(lists, at), "spotopen")
    home = entries.where("home").withColumn("salt", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    every = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_pairs = every.alias("a").join(home.alias("b"), [*at, "salt"]).where((F.col("a.class") != F.col("b.class")) & (~F.col("a.home") | (F.col("a.set") < F.col("b.set"))) & likely)
    found = found.unionByName(links(open_pairs))
    of = components(found).withColumnsRenamed({"node": "set", "root": "class"})
    rows = prints.join(of, "set", "left").select("doc_id", "length", F.coalesce("class", "set").alias("class"))
    names = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(names, "class").select("doc_id", "length", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
