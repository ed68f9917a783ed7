"""A corpus from documents: quality filter, one document of each near-duplicate group, personal data masked, sources
mixed to their target weights, and the result packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe.llm import jaccard_join, mixing, packing, pii, quality
from eraframe.llm.common import WORD, materialize, scratch, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score of 0.3 or more; the rules are learned from the labelled rows of this stage's input.

    Null texts score as empty ones; repeated rows and ties score alike, so all of them stay or go; without usable labels
    the score is a constant; an empty table gives no rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.train(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by five-word shingles at 0.8: the one with the smallest id, of rows with one id
    the one with the smallest hash of its text, of equal rows any. Rows without an id come last and are kept only where
    no row of their group has one. Rows without words, and null texts, are in no group and stay.
    """
    small_batches(spark)
    groups = jaccard_join.similar_documents(docs, width=5, percent=80).where("n_shingles > 0")
    rows = groups.groupBy("group_key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_key").agg(F.count("*").alias("rows"))
    first = rows.groupBy("group_key").agg(F.min(F.struct("id", "text_key", "rows")).alias("kept")).select(F.col("kept.id").alias("_kept_id"), F.col("kept.text_key").alias("_kept_key"), F.col("kept.rows").alias("_kept_rows"))
    first = materialize(first, "kept")
    text = F.col("text").cast("string")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) == F.col("_kept_id")) & (F.xxhash64(text) == F.col("_kept_key"))
    kept = docs.join(first, same)
    if not first.where("_kept_rows > 1").isEmpty():
        kept = kept.where("_kept_rows = 1").unionByName(kept.where("_kept_rows > 1").dropDuplicates(["_kept_id", "_kept_key"]))
    blank = docs.where(text.isNull() | ~text.rlike(WORD))
    return kept.select(*[docs[c] for c in docs.columns]).unionByName(blank)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind. All rows stay; null and empty texts stay as they are."""
    small_batches(spark)
    return pii.mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each document the words that the mix gives it: repeated, whole, cut at the end of a quota, or none.

    Documents of which nothing is taken go, as do null texts and texts without words; see mix_sources and apply_mix for
    null sources, ties and repeated rows.
    """
    small_batches(spark)
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their place in sequences of at most 2048 tokens; see pack_documents."""
    small_batches(spark)
    return packing.pack_documents(docs, packing.byte_bpe())


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The stages hold a learned model, components and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
