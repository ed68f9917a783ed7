"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialize, mix, text_slices
from .labelled import fold, per_text, per_words, sample
from .spotsigs import IS_MARK, bare_words

U = np.uint64

#: Labelled rows to learn from, at most about; keys of the learned lexicon, at most; texts that a key must be in.
BOUND, LEXICON, SUPPORT = 12_000, 4_000, 5

# Words that address a reader, in English, French, Spanish and German.
SECOND = "you your yours yourself u ur tu toi te vous votre vos ton ta tes tú usted ustedes su vuestro du dich dir dein deine ihr euch euer sie".split()

FEATURES = ("log_words", "lexicon", "lexicon_hits", "lexicon_kinds", "prefix", "prefix_hits", "near_second", "second", "capitals", "shouted", "marks", "bang", "obfuscated")

#: Bytes of the word beginnings that the lexicon may hold beside whole words (accented letters have two).
STEMS = (4, 5, 6, 7, 8, 9)


def lexicon_keys(words: Words, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Keys of the whole words, and of their beginnings of each length in STEMS (0 where the word isn't longer)."""
    out = [words.hashes(start, end)]
    for n in STEMS:
        long = end - start > n
        key = np.zeros(len(start), U)
        key[long] = mix(words.hashes(start[long], start[long] + n) + U(n))
        out.append(key)
    return out


def learn_lexicon(rows: DataFrame, most: int = LEXICON, support: int = SUPPORT, lift: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words, and of beginnings, that toxic texts of the sample have at least `lift` times as often as others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", 1 << 20):
            words, start, end = bare_words(b.column(0))
            label, doc = b.column(1).to_numpy(), words.doc()
            for kind, key in enumerate(lexicon_keys(words, start, end)):
                on = key != 0
                pair = np.unique(np.stack([doc[on].astype(np.int64), key[on].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], kind, np.int32)), pa.array(pair[1]), pa.array(label[pair[0]].astype(np.int64))], names=["kind", "key", "label"])

    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return np.zeros(0, U), np.zeros(0, U)
    counts = rows.select("text", "label").mapInArrow(run, "kind int, key long, label long").groupBy("kind", "key").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    ratio = (F.col("toxic") / toxic) / ((F.col("n") - F.col("toxic") + 0.5) / (total - toxic))
    best = counts.where(F.col("toxic") >= support).withColumn("ratio", ratio).where(F.col("ratio") >= lift).orderBy(F.desc("toxic"), "kind", "key").limit(most).collect()
    both = [np.array([r.key for r in best if (r.kind > 0) == stem], np.int64).view(U) for stem in (False, True)]
    return np.unique(both[0]), np.unique(both[1])


def features(text: pa.Array, lexicon: tuple[np.ndarray, np.ndarray], second: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: densities a word or a byte, and counts as logarithms."""
    words, start, end = bare_words(text)
    b, n, doc = words.bytes, words.counts.astype(float), words.doc()
    some, solid = np.maximum(n, 1), np.maximum(np.diff(words.doc_bytes), 1)
    key, *stems = lexicon_keys(words, start, end)
    whole = np.isin(key, lexicon[0])
    begin = np.zeros(len(key), bool)
    for s in stems:
        begin |= np.isin(s, lexicon[1])
    toxic = whole | begin
    kinds = np.zeros(len(n))
    if toxic.any():
        pairs = np.unique(np.stack([doc[toxic].astype(np.int64), key[toxic].view(np.int64)]), axis=1)
        kinds = np.bincount(pairs[0], minlength=len(n)).astype(float)
    you = np.isin(key, second)
    spread = np.zeros(len(key), bool)
    for k in range(1, 6):  # within five words of the same text
        for a, z in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            spread[a] |= you[z] & (doc[a] == doc[z]) if len(key) > k else False
    upper = (b >= 65) & (b <= 90)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    ups, lets, odds = (np.r_[0, np.cumsum(x)] for x in (upper, letter, ((b >= 48) & (b <= 57)) | np.isin(b, np.frombuffer(b"*@$#!", np.uint8))))
    length = end - start
    shouted = (ups[end] - ups[start] == length) & (length > 2)
    odd = (odds[end] - odds[start] > 0) & (lets[end] - lets[start] > 1) & (lets[end] - lets[start] >= (length + 1) // 2) & (length < 20)
    cols = {
        "log_words": np.log1p(n),
        "lexicon": per_words(words, whole) / some,
        "lexicon_hits": np.log1p(per_words(words, whole)),
        "lexicon_kinds": np.log1p(kinds),
        "prefix": per_words(words, begin) / some,
        "prefix_hits": np.log1p(per_words(words, begin)),
        "near_second": per_words(words, toxic & spread) / np.maximum(per_words(words, toxic), 1),
        "second": per_words(words, you) / some,
        "capitals": per_text(words, upper) / solid,
        "shouted": per_words(words, shouted) / some,
        "marks": per_text(words, IS_MARK[b]) / solid,
        "bang": per_text(words, b == 33) / solid,
        "obfuscated": per_words(words, odd) / some,
    }
    return np.stack([cols[f].astype(float) for f in FEATURES], 1)


def with_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], keep: str) -> DataFrame:
    """The column `keep` and the array x of features of text."""
    kind = dict(docs.dtypes)[keep]
    second = np.unique(Words(pa.array(SECOND, pa.large_string())).hashes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            x = features(b.column(1), lexicon, second)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=[keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


class Model:
    """A learned lexicon, boosted trees and the isotonic step; score(docs) -> doc_id, score."""

    def __init__(self, docs: DataFrame, labels: DataFrame, bound: int = BOUND, trees: int = 15, depth: int = 3, seed: int = 9):
        rows = materialize(sample(docs, labels, "toxic", fold(F.col("doc_id"), 3) != 1, bound).repartition(6), "toxic-sample")
        self.lexicon = learn_lexicon(rows)
        part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0  # a quarter is left for the isotonic step
        half = rows.select("text", F.struct("label", part.alias("later")).alias("y"))
        data = with_features(half, self.lexicon, "y").select("y.label", "y.later", array_to_vector("x").alias("features")).cache()
        n, ones, early, early_ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.count_if(~F.col("later")), F.coalesce(F.sum(F.when(~F.col("later"), F.col("label"))), F.lit(0))).first()
        self.trees = self.steps = None
        self.share = ones / n if n else 0.0
        if 0 < early_ones < early and early < n:
            self.trees = GBTClassifier(labelCol="label", maxDepth=depth, maxIter=trees, seed=seed, minInstancesPerNode=5, maxBins=48).fit(data.where("not later"))
            self.steps = IsotonicRegression(labelCol="label", featuresCol="raw").fit(self._raw(data.where("later")))
        data.unpersist()

    def _raw(self, data: DataFrame) -> DataFrame:
        return self.trees.transform(data).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")

    def score(self, docs: DataFrame) -> DataFrame:
        x = with_features(docs.select("doc_id", F.col("text").cast("string").alias("text")), self.lexicon, "doc_id")
        if self.trees is None:
            return x.select("doc_id", F.lit(self.share).alias("score"))
        # the isotonic steps tie many rows; a thousandth of the trees' own probability keeps their order
        out = self.steps.setPredictionCol("step").transform(self._raw(x.withColumn("features", array_to_vector("x"))))
        return out.select("doc_id", (0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("step"))) + 0.001 * F.col("raw")).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null texts score as empty ones, repeated rows alike, and other
    columns are ignored. With no labels, or labels of one kind only, the score is the share of toxic labels (0 if none)."""
    scored = Model(docs, labels).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
