"""What the two classifiers share: bounded labelled samples and statistics of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, mix
from .spotsigs import IS_MARK, _anchor_keys, bare_words

U = np.uint64


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most about `bound` labelled rows with their texts (doc_id, text, label), chosen by a hash of the id.

    The sample has a bounded size, so it is broadcast; the documents aren't shuffled. Ids with labels that differ, and
    null ids or labels, teach nothing.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(keep & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(rows), "doc_id")


def per_text(words: Words, mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[words.doc_bytes[1:]] - total[words.doc_bytes[:-1]]


def per_words(words: Words, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]


def distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: different values, and how often the most frequent one is there."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    tag = np.sort(mix(value + owner.astype(U) * U(0x9E3779B97F4A7C15)) >> U(24) | (owner.astype(U) << U(40)))
    new = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
    runs = np.diff(np.r_[new, len(tag)])
    who = (tag[new] >> U(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, who, runs)
    return np.bincount(who, minlength=n).astype(float), top


STATS = ("log_words", "mean_word", "long_words", "upper_words", "upper", "digits", "bang", "signs", "pipes", "marks", "stops", "unique", "unique_pairs", "top_word", "repeat_next", "line_repeat", "line_words", "hapax_bytes")


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of whole texts, each a double; 0 for texts without words."""
    words, start, end = bare_words(text)
    b, n = words.bytes, words.counts.astype(float)
    some = np.maximum(n, 1)
    size = np.diff(words.doc_bytes).astype(float)
    solid = np.maximum(per_text(words, ~IS_SPACE[b]), 1)
    h, doc = words.hashes(start, end), words.doc()
    after = np.append(b[1:], 0).astype(np.uint8) if len(b) else b
    upper = ((b >= 65) & (b <= 90)) | ((b == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    lower = ((b >= 97) & (b <= 122)) | ((b == 0xC3) & (after >= 0x9F))
    ups = np.r_[0, np.cumsum(upper)]
    lows = np.r_[0, np.cumsum(lower)]
    length = end - start
    shout = (ups[end] - ups[start] >= 2) & (lows[end] == lows[start]) if len(start) else np.zeros(0)
    unique, top = distinct(doc, h, len(n))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pair_ok = doc[1:] == doc[:-1]
    pairs, _ = distinct(doc[1:][pair_ok], mix(h[:-1][pair_ok] * U(3) + h[1:][pair_ok]), len(n))
    ends = np.unique(np.r_[np.flatnonzero(b == 10), words.doc_bytes[1:]])
    starts = np.r_[words.doc_bytes[0], ends[:-1] + (b[np.minimum(ends[:-1], max(len(b) - 1, 0))] == 10 if len(b) else 0)] if len(ends) else ends
    full = ends - starts > 20
    starts, ends = starts[full], ends[full]
    line_doc = np.searchsorted(words.doc_bytes, starts, "right") - 1
    lines, _ = distinct(line_doc, words.hashes(starts, ends), len(n))
    n_lines = np.bincount(line_doc, minlength=len(n)).astype(float)
    return {
        "log_words": np.log1p(n),
        "mean_word": per_words(words, length) / some,
        "long_words": per_words(words, length > 16) / some,
        "upper_words": per_words(words, shout) / some,
        "upper": per_text(words, upper) / solid,
        "digits": per_text(words, (b >= 48) & (b <= 57)) / solid,
        "bang": per_text(words, (b == 33) | (b == 63)) / solid,
        "signs": per_text(words, np.isin(b, np.frombuffer(b"*#%&$@^~=<>", np.uint8))) / solid,
        "pipes": per_text(words, b == 124) / solid,
        "marks": per_text(words, IS_MARK[b]) / solid,
        "stops": per_words(words, np.isin(h, _anchor_keys())) / some,
        "unique": unique / some,
        "unique_pairs": pairs / np.maximum(n - 1, 1),
        "top_word": top / some,
        "repeat_next": per_words(words, same) / some,
        "line_repeat": 1 - lines / np.maximum(n_lines, 1) * (n_lines > 0) - (n_lines == 0),
        "line_words": np.log1p(n / np.maximum(n_lines, 1)),
        "hapax_bytes": unique / np.maximum(np.sqrt(size), 1),
    }
