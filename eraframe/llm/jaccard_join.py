"""N-gram Jaccard join: exact set similarity over word shingles, by T-occurrence search.

Equal sets are one class from the start. Classes that can be similar at all are brought together by a partition
argument (below), then each such family is searched by T-occurrence with DivideSkip: the lists of a document's rare
shingles are merged, its long lists only probed by binary search for what the merge left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, materialize, mix, runs, text_slices

U = np.uint64
ROW_LIMIT = 400_000


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and offsets. Fewer words than width: all as one."""
    words = Words(text)
    h, n, first = words.hashes(), words.counts, words.first
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    starts = np.repeat(first[:-1], shingles) + _ranges(shingles)
    size = np.repeat(np.minimum(n, width), shingles)
    value = np.zeros(len(starts), U)
    for k in range(width):
        on = size > k
        value[on] = mix(value[on] * U(0x9E3779B97F4A7C15) + h[starts[on] + k] + U(k + 1))
    ends = np.cumsum(shingles)
    out = [np.unique(value[a:b]) for a, b in zip(ends - shingles, ends, strict=True)]
    offsets = np.zeros(len(out) + 1, np.int64)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return np.concatenate(out) if out else value, offsets


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole set; with the size beside it, equal only for equal sets."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(mix(values + U(0xA0761D6478BD642F)), out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U)).view(np.int64)


class Bands:
    """Size bands such that similar sets are in one band or in neighbours.

    Two sets with sizes that sum to s and Jaccard of t / 100 or more differ in at most s (100 - t) / (100 + t)
    elements. Elements dealt by hash to one group more than the most that a band allows leave at least one group equal
    in both sets. So sets that share no (band, group, group's hash) aren't similar; those that do are candidates.
    """

    def __init__(self, t: int, top: int = 1 << 31):
        self.t = t
        low = 1
        while (low + low * 100 // t) * (100 - t) // (100 + t) < 1:
            low += 1
        edges = [low]
        while edges[-1] < top:
            edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // t + 1))
        self.edges = np.array(edges)
        n = self.edges[1:] - 1
        self.groups = np.append((n + n * 100 // t) * (100 - t) // (100 + t) + 1, 0)

    def keys(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set number, key) for each group of each set, in its own band and as the larger set of the band before."""
        n = np.diff(offsets)
        band = np.searchsorted(self.edges, n, "right") - 1
        sets, keys = [], []
        for back in (0, 1):
            b = band - back
            use = np.flatnonzero(b >= 0)
            if not len(use):
                continue
            m = self.groups[b[use]]
            at = np.zeros(len(n), np.int64)
            at[use] = np.cumsum(m) - m
            count = np.where(b >= 0, n, 0)
            which = np.repeat(np.arange(len(n)), count)
            picked = values[np.repeat(offsets[:-1], count) + _ranges(count)]
            code = mix(picked ^ U(0xE7037ED1A0B428DB))
            group = (code >> U(11)) % self.groups[b[which]].astype(U)
            total = np.zeros(int(m.sum()), U)
            np.add.at(total, at[which] + group.astype(np.int64), mix(code))
            salt = np.repeat(b[use], m).astype(U) * U(0x9E3779B97F4A7C15) + _ranges(m).astype(U) * U(0x8EBC6AF09C88C6E3)
            sets.append(np.repeat(use, m))
            keys.append(mix(total + mix(salt)))
        if not sets:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(sets), np.concatenate(keys).view(np.int64)


class Minima:
    """Keys that a pair at the threshold shares but for a chance of `miss`: bands of minima of hashes of the elements.

    Below a Jaccard of about 0.88 the groups of Bands hold so few elements that a passage of a few words, or an empty
    group, joins documents that have nothing else in common, and families grow without end. Here a key stands for
    several minima, so its chance falls with a power of the similarity.
    """

    def __init__(self, t: int, miss: float = 1e-8, seed: int = 17):
        j = t / 100
        self.rows = max(1, round(np.log(0.25) / np.log(j)))
        self.bands = int(np.ceil(np.log(miss) / np.log(1 - j**self.rows)))
        rng = np.random.default_rng(seed)
        k = self.rows * self.bands
        self.flip, self.times = rng.integers(0, 1 << 32, k, dtype=np.uint32), rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)

    def keys(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set number, key) for each band of each set that isn't empty."""
        x = (mix(values ^ U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.uint32)
        use = np.flatnonzero(np.diff(offsets))
        low = np.empty((len(use), len(self.flip)), np.uint32)
        for i, k in enumerate(use):
            a, b = int(offsets[k]), int(offsets[k + 1])
            row = None
            for at in range(a, b, 1024):
                part = ((x[at : min(b, at + 1024), None] ^ self.flip) * self.times).min(0)
                row = part if row is None else np.minimum(row, part)
            low[i] = row
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=U), (len(use), self.bands))
        for r in range(self.rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + low[:, r :: self.rows].astype(U))
        return np.repeat(use, self.bands), key.ravel().view(np.int64)


def t_occurrence(sets: list[np.ndarray], t: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join what is linked among sets (100 * shared >= t * union), a spanning forest of the links.

    Sets in order of size; for set x only those before it and large enough are searched. A partner must share at least
    T = ceil(t |x| / 100) of x's elements. The T - 1 longest inverted lists of x are left out of the merge; a set that
    the merge of the others gives c times and that needs o in all is kept if c + T - 1 >= o, and then the long lists are
    probed for it by binary search. With side, only pairs from different sides count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    tokens, token, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(token, kind="stable")
    lists, list_at = owner[by], np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(df, out=list_at[1:])
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in range(1, len(sets)):
        mine = token[offsets[x] : offsets[x + 1]]
        n = len(mine)
        need = -(-t * n // 100)
        low = np.searchsorted(sizes, need)
        if low >= x:
            continue
        mine = mine[np.argsort(df[mine], kind="stable")]
        short, long = mine[: n - need + 1], mine[n - need + 1 :]
        short = short[df[short] > 1]
        if not len(short):
            continue
        merged = np.concatenate([lists[list_at[k] : list_at[k + 1]] for k in short])
        merged = merged[(merged >= low) & (merged < x)]
        if side is not None:
            merged = merged[side[order[merged]] != side[order[x]]]
        if not len(merged):
            continue
        count = np.bincount(merged - low, minlength=x - low)
        found = np.flatnonzero(count)
        total = -(-t * (n + sizes[low + found]) // (100 + t))
        found = found[count[found] + len(long) >= total]
        for y in low + found[np.argsort(-count[found], kind="stable")]:
            if find(int(y)) == find(x):
                continue
            theirs = token[offsets[y] : offsets[y + 1]]
            at = np.searchsorted(theirs, long)
            shared = int(count[y - low]) + int((theirs[np.minimum(at, len(theirs) - 1)] == long).sum())
            if 100 * shared >= t * (n + len(theirs) - shared):
                parent[find(x)] = find(int(y))
                edges.append((int(order[y]), int(order[x])))
    return edges


def _docs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values, offsets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(set_keys(values, offsets))], names=["doc_id", "text_key", "n_shingles", "set_key"])

    return run


def _group_keys(width: int, t: int):
    bands = Bands(t) if t >= 88 else Minima(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, "text", 1 << 20):
            values, offsets = shingle_sets(batch.column(0), width)
            own = set_keys(values, offsets)
            fresh = np.zeros(len(own), bool)  # a set leaves this task once, or again after very many others
            for i, k in enumerate(own.tolist()):
                fresh[i] = k not in seen
                seen.add(k)
            if len(seen) > ROW_LIMIT:
                seen.clear()
            which, keys = bands.keys(values, offsets)
            use = fresh[which]
            which, keys = which[use], keys[use]
            for a in range(0, len(keys), ROW_LIMIT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + ROW_LIMIT]), pa.array(own[which[a : a + ROW_LIMIT]])], names=["key", "set_key"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, set_key): an edge between neighbours that share a key. A key of m sets gives m - 1."""
    last_key, last_set = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        key, own = (np.concatenate([last, b.column(i).to_numpy()]) for i, last in enumerate((last_key, last_set)))
        on = (key[1:] == key[:-1]) & (own[1:] != own[:-1])
        last_key, last_set = key[-1:], own[-1:]
        pair = np.unique(np.stack([own[:-1][on], own[1:][on]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "i", "j", "set_key", "block", "elements"]
        for batch in text_slices(batches, "text", 1 << 20):
            values, offsets = shingle_sets(batch.column(0), width)
            own = set_keys(values, offsets).tolist()
            rows = []
            for k, (family, blocks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                data = values[offsets[k] : offsets[k + 1]].tobytes()
                mine = own[k] % blocks
                rows += [(family, min(mine, other), max(mine, other), own[k], mine, data) for other in range(blocks)]
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types, strict=True)], names=names)

    return run


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeats of a set (rows with one id and one text), which follow each other."""
    last = None
    for b in batches:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        yield b.filter(pa.array([x != y for x, y in zip(rows, [last, *rows], strict=False)], pa.bool_()))
        last = rows[-1] if rows else last


def _search(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in runs(_different(batches), ["family", "i", "j"]):
            keys = group.column("set_key").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("elements").to_pylist()]
            cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            side = group.column("block").to_numpy() if cross else None
            for a, b in t_occurrence(sets, t, side):
                us.append(keys[a])
                vs.append(keys[b])
            if len(us) > ROW_LIMIT:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90, block_elements: int = 2_000_000) -> DataFrame:
    """Classes of documents linked by 100 * |shared| >= percent * |union| of their shingle sets.

    Returns doc_id, text_key (hash of the text), n_shingles, component_id (smallest doc_id reachable by links), group_key
    (a hash for each class, which tells classes apart whatever their ids; null without shingles). From 88
    percent on every link is found; below, candidates come by Minima and a pair at the threshold is missed with a small
    chance (its `miss`). Null, empty and blank texts have no shingles and link with nothing; equal texts always link
    otherwise, repeated rows too. Rows with a null doc_id take part and join what is similar to them; they get their
    class's id, null if no row of it has one. An empty table gives no rows; other columns are ignored.

    Work that grows: the rows of group keys (about a quarter of the shingles, 16 bytes each, each different set once a
    task), one copy of the texts of classes that have candidates, and their sets. A family of candidate sets with more
    than block_elements elements is dealt to blocks, and each pair of blocks is searched by a task of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    table = materialize(docs.mapInArrow(_docs(width), "doc_id long, text_key long, n_shingles long, set_key long"), "sets")
    keys = docs.select("text").mapInArrow(_group_keys(width, percent), "key long, set_key long")
    chains = keys.repartition("key").sortWithinPartitions("key", "set_key").mapInArrow(_chains, "u long, v long")
    families = components(chains).withColumnRenamed("node", "set_key").withColumnRenamed("root", "family")
    named = F.coalesce("doc_id", F.lit(-(1 << 63)))  # a class is told by one of its rows, with or without an id
    classes = table.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.min(F.struct(named.alias("id"), "text_key")).alias("row"))
    members = materialize(classes.join(families, "set_key"), "members")
    total = members.groupBy("family").agg(F.ceil(F.sum("n") / block_elements).cast("int").alias("blocks"))
    wanted = members.join(total, "family").select(F.col("row.id").alias("id"), F.col("row.text_key").alias("text_key"), "family", "blocks")
    texts = docs.select(named.alias("id"), "text_key", "text").join(wanted.hint("merge"), ["id", "text_key"])  # the same plan at every size
    texts = texts.select("text", "family", "blocks")
    parts = texts.mapInArrow(_sets(width), "family long, i int, j int, set_key long, block int, elements binary")
    parts = parts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "set_key")
    links = components(parts.mapInArrow(_search(percent), "u long, v long"))
    linked = links.join(classes.select("set_key", "doc_id"), links.node == F.col("set_key")).select("root", "set_key", "doc_id")
    low = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    merged = linked.join(low, "root").select("set_key", "component_id", "root")
    own = classes.select("set_key", F.col("doc_id").alias("own_id")).join(merged, "set_key", "left")
    ids = own.select("set_key", F.coalesce("component_id", "own_id").alias("component_id"), F.coalesce("root", "set_key").alias("group_key"))
    # written, so that both sides of the join are shuffles of their own and a set with very many copies can be split
    out = table.join(materialize(ids, "classes"), "set_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
