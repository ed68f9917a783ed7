"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).alias("key")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources in code point order, null last, take the weights in turn and share the total of all sizes; a source whose
    share would pass cap times its size stops there, and the excess goes to the rest by weight. With sources in the
    order of cap * size / weight, the sources before the first k for which the rest's common level
    (total - caps before) / (weights from k on) stays within source k's own level are the capped ones. Rows here are
    sources, not documents, so the two windows without a partition hold one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("lambda", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every))
    target = F.least(F.col("lambda") * F.col("w"), F.col("cap"))
    return s.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _shard_words(shards: DataFrame, block_words: int, cap: float) -> DataFrame:
    """Words of each shard (source, shard, source_size, target, shard_size): see mix_sources."""
    size, source = F.col("shard_size"), Window.partitionBy("source")
    s = shards.withColumn("most", F.floor(F.lit(float(cap)) * size))
    s = s.withColumn("goal", F.least(F.round("target").cast("long"), F.sum("most").over(source)))
    claim = F.col("goal") * (size / F.greatest(F.col("source_size"), F.lit(1)))
    s = s.withColumn("base", F.floor(F.least(claim + 1e-9, F.col("most")) / block_words))
    s = s.withColumn("next", F.least(F.lit(block_words), F.col("most") - F.col("base") * block_words))
    s = s.withColumn("rest", F.col("goal") - F.sum(F.col("base") * block_words).over(source))
    turn = source.orderBy((size / (2 * F.col("base") + 1)).desc(), "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("before", F.sum("next").over(turn) - F.col("next"))
    more = F.greatest(F.lit(0), F.least(F.col("next"), F.col("rest") - F.col("before")))
    return s.select("source", "shard", "shard_size", (F.col("base") * block_words + more).cast("long").alias("words"))


def mix_sources(docs: DataFrame, seed: int = 7, block_words: int = 16, shard_docs: int = 128, cap: float = 3.0) -> DataFrame:
    """Words to take of each document: doc_id, size, key (hash of the text), source, source_size, target, shard, quota (blocks,
    the last maybe partial), taken.

    Each source is cut into shards of about shard_docs documents by a seeded hash, so a source with a third of all rows
    is many shards. A source hands out its target, rounded to whole words, in blocks of block_words words. A shard's
    claim is its part of the target. It first gets the whole blocks of its claim (not above what cap copies of it
    hold); the rest goes block by block to the highest Sainte-Lague quotients size / (2 k + 1), k the blocks that a
    shard has, until the source's words are out, so they sum to its target. A block is partial where the cap or the
    target ends in it. Within a shard the documents, in seeded order, form a stream that starts again at its end; the
    shard takes the stream's first words. Same rows and seed, same result. The window over the shards of a source
    holds one pre-aggregated row for each shard.

    Null texts have size 0 and nothing is taken of them. A null source is a source of its own, the last. Repeated rows
    count each. An empty table gives no rows. Other columns are ignored, whatever their names. A document may be cut
    by the end of the quota; none is taken more than cap times.
    """
    shard_of = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("key"))
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key(F.col("text"))), "sizes")
    t = source_targets(sizes, cap=cap)
    rows = sizes.alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target", F.pmod(shard_of, F.ceil(F.col("n_docs") / shard_docs)).alias("shard"))
    words = _shard_words(rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size")), block_words, cap)
    rows = rows.alias("d").join(words.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))).select("d.*", "shard_size", "words")
    shard = Window.partitionBy("source", "shard")
    order = shard.orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("key")), "doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(order)).withColumn("quota", F.ceil(F.col("words") / block_words))
    words = F.col("words")
    left = words - F.floor(words / F.col("shard_size")) * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("upto"), left) - (F.col("upto") - F.col("size")))
    taken = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size")) * F.col("size") + part).otherwise(0)
    return rows.select("doc_id", "size", "key", "source", "source_size", "target", "shard", "quota", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Documents as the mix takes them: whole repeats of the text, a line end between them, then its first words, with
    the white space between them, up to what is taken; none if 0.

    Documents are told by id and text, so rows with one id (or none) and different texts each get what is theirs. Equal
    rows share what the mix takes of them evenly, rounded down to whole words. n_chars follows the text. Other columns
    stay as they are; null texts and texts without words are left out, as nothing is taken of them.
    """
    cols = docs.columns
    m = mixed.groupBy("doc_id", "size", "key").agg(F.floor(F.sum("taken") / F.count("*")).alias("taken")).where("taken > 0")
    d = docs.alias("d").join(m.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (text_key(F.col("d.text")) == F.col("m.key")))
    whole, rest = F.floor(F.col("m.taken") / F.col("m.size")).cast("int"), (F.col("m.taken") % F.col("m.size")).cast("int")
    words = F.split(F.col("d.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the white space before it
    head = F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(1))), ""))).otherwise(F.array().cast("array<string>"))
    text = F.when((whole == 1) & (rest == 0), F.col("d.text")).otherwise(F.array_join(F.concat(F.array_repeat(F.col("d.text"), whole), head), "\n"))
    out = d.select(*[text.alias("text") if c == "text" else F.col(f"d.{c}").alias(c) for c in cols])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cols else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
