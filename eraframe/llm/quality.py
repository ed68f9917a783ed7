"""Quality classifier: a sparse ensemble of rules from tree paths, with lasso logistic weights, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .labelled import STATS, fold, sample, statistics

#: Labelled rows to learn from, at most about.
BOUND = 12_000


def with_statistics(docs: DataFrame, prefix: str = "stat_") -> DataFrame:
    """All columns of docs and a column for each statistic of its text."""
    at = docs.columns.index("text")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *(f"{prefix}{s} double" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            done = 0
            for b in text_slices(iter([raw]), "text"):
                stats = statistics(b.column(at))
                own = raw.slice(done, b.num_rows)
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(stats[s].astype(float)) for s in STATS)], names=[*own.schema.names, *(prefix + s for s in STATS)])

    return docs.mapInArrow(run, schema)


@dataclass
class Rule:
    """A conjunction of (statistic, above, threshold) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            c = F.col(prefix + name)
            out = out & ((c > at) if above else (c <= at))
        return out


def tree_rules(model, names: tuple[str, ...]) -> list[tuple[tuple[str, bool, float], ...]]:
    """The path to every node of every tree, as a conjunction with one bound a statistic and side; none twice."""
    found: dict[tuple, None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found.setdefault(tuple(sorted((n, a, t) for (n, a), t in path.items())))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        left, right = (name, False), (name, True)
        walk(node.leftChild(), path | {left: min(at, path.get(left, math.inf))})
        walk(node.rightChild(), path | {right: max(at, path.get(right, -math.inf))})

    for tree in model.trees:
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") and tree._java_obj is not None else tree._call_java("rootNode"), {})
    return list(found)


@dataclass
class RuleModel:
    rules: list[Rule]
    bias: float

    def score(self, prefix: str = "stat_") -> Column:
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(prefix), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(rows: DataFrame, prefix: str = "stat_", trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> RuleModel:
    """Fit on rows (label, statistics): boosted trees give the rules, a lasso logistic regression their weights; rules
    with weight 0 are left out. With labels of one kind only, or trees without a split, the model is the share of ones,
    without rules."""
    rows = materialize(rows.repartition(6), "quality-sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = RuleModel([], math.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return share
    rows = rows.withColumn("features", array_to_vector(F.array(*[F.col(prefix + s) for s in STATS]))).cache()
    model = GBTClassifier(labelCol="label", maxDepth=depth, maxIter=trees, subsamplingRate=0.7, seed=seed, minInstancesPerNode=20, maxBins=48).fit(rows)
    paths = tree_rules(model, STATS)
    if not paths:
        rows.unpersist()
        return share
    rules = [Rule(p, 0.0) for p in paths]
    hits = rows.select("label", array_to_vector(F.array(*[r.column(prefix).cast("double") for r in rules])).alias("features"))
    lasso_fit = LogisticRegression(labelCol="label", regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False).fit(hits)
    rows.unpersist()
    weights = lasso_fit.coefficients.toArray()
    return RuleModel([Rule(p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6], float(lasso_fit.intercept))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> RuleModel:
    """Learn labels.quality from rows outside the held-out fold (crc32 of the id as text modulo 5 is 0)."""
    rows = sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, bound)
    return fit_rules(with_statistics(rows.select("text", "label")).drop("text"))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """All columns of docs, then score and predicted. Null texts score as empty ones; repeated rows alike.

    A column of docs named score or predicted is replaced."""
    rows = with_statistics(docs.drop("score", "predicted"), "stat__")
    rows = rows.withColumn("score", model.score("stat__")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return rows.drop(*(f"stat__{s}" for s in STATS))


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of threshold or more, with just their own columns, whatever these are called."""
    rows = with_statistics(docs, "stat__")
    return rows.where(model.score("stat__") >= threshold).drop(*(f"stat__{s}" for s in STATS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
