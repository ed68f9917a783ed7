"""Full-text search: English words reduced by Porter's steps, and a stored inverted index that is read by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# English words that a search ignores.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# Suffixes of Porter's second to fourth step and what stands for them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent (?<=[st])ion ou ism ate iti ous ive ize".split()

#: Consonants and vowels; a y that is a consonant is written Y.
C, V = "[^aeiouy]", "[aeiouy]"
#: At least one, and at least two, runs of vowels with consonants after them.
ONE, TWO = f"^{C}*{V}+{C}", f"^{C}*(?:{V}+{C}+){{2}}"
DOUBLE, SHORT = f"({C})\\1$", f"{C}{V}[^aeiouywxY]$"


def stem_words(df: DataFrame, word: str, out: str) -> DataFrame:
    """Add the stem of each word by Porter's algorithm; null words have none, words of one or two letters stay.

    Each step is a column of its own, since its condition looks at the word several times; stem distinct words."""
    w, cut = F.col("_w"), F.col("_cut")
    stem = F.left(w, F.length(w) - F.length(cut))

    def step(rows: DataFrame, suffixes: list[str], value: Column) -> DataFrame:
        """value tells what becomes of a word with one of the suffixes, the longest."""
        rows = rows.withColumn("_cut", F.regexp_extract("_w", f"({'|'.join(suffixes)})$", 1))
        return rows.withColumn("_w", F.when(cut == "", w).otherwise(value)).drop("_cut")

    def swap(rows: DataFrame, table: dict[str, str]) -> DataFrame:
        new = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), cut)
        return step(rows, list(table), F.when(stem.rlike(ONE), F.concat(stem, new)).otherwise(w))

    rows = df.withColumn("_w", F.regexp_replace(F.lower(F.col(word)), "^y|(?<=[aeiou])y", "Y"))
    rows = step(rows, ["sses", "ies", "ss", "s"], F.when(cut == "sses", F.concat(stem, F.lit("ss"))).when(cut == "ies", F.concat(stem, F.lit("i"))).when(cut == "ss", w).otherwise(stem))
    rows = rows.withColumn("_was", w)
    rows = step(rows, ["eed", "ed", "ing"], F.when(cut == "eed", F.when(stem.rlike(ONE), F.concat(stem, F.lit("ee"))).otherwise(w)).when(stem.rlike(V), stem).otherwise(w))
    shorter = (w != F.col("_was")) & ~F.col("_was").endswith("eed")
    mended = (
        F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE) & ~w.rlike("[lsz]$"), F.left(w, F.length(w) - 1))
        .when(w.rlike(ONE) & ~w.rlike(TWO) & w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w)
    )
    rows = rows.withColumn("_w", F.when(shorter, mended).otherwise(w)).drop("_was")
    rows = step(rows, ["[yY]"], F.when(stem.rlike(V), F.concat(stem, F.lit("i"))).otherwise(w))
    rows = swap(swap(rows, STEP_2), STEP_3)
    rows = step(rows, STEP_4, F.when(stem.rlike(TWO), stem).otherwise(w))
    rows = step(rows, ["e"], F.when(stem.rlike(TWO) | (stem.rlike(ONE) & ~stem.rlike(SHORT)), stem).otherwise(w))
    rows = rows.withColumn("_w", F.when(w.rlike(TWO) & w.rlike("ll$"), F.left(w, F.length(w) - 1)).otherwise(w))
    found = F.when(F.length(F.col(word)) <= 2, F.lower(F.col(word))).otherwise(F.lower(w))
    # through a generator, which no filter on the stem passes: moved into the steps it would hold copies without number
    return rows.select(*df.columns, F.explode(F.array(found)).alias(out))


def words(text: Column) -> Column:
    """The different words of a text, in lower case, without those that a search ignores."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP)))


def index(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """(token, key), each pair once. Each different word is stemmed once and joined back to where it stands."""
    found = rows.select(F.explode(words(F.concat_ws(" ", *texts))).alias("word"), key)
    return found.join(stem_words(found.select("word").distinct(), "word", "token"), "word").select("token", key).distinct()


def store_index(rows: DataFrame, path: str, key: str, *texts: str) -> None:
    """Write the index in order of token and key, so that a reader opens only the row groups of the tokens it asks for; a
    frequent token lies in many files."""
    index(rows, key, *texts).repartitionByRange("token", key).sortWithinPartitions("token", key).write.mode("overwrite").parquet(path)


def wanted(spark: SparkSession, query: str) -> list[str]:
    """The tokens of a query."""
    asked = spark.range(1).select(F.explode(words(F.lit(query))).alias("word"))
    return sorted({r.token for r in stem_words(asked, "word", "token").collect()})


def search_index(idx: DataFrame, key: str, query: str) -> DataFrame:
    """Keys with every word of the query, from an index of whatever length; none for a query of ignored words alone."""
    tokens = wanted(idx.sparkSession, query)
    return idx.where(F.col("token").isin(tokens)).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == (len(tokens) or -1)).select(key)


def search(rows: DataFrame, key: str, query: str, *texts: str) -> DataFrame:
    """Rows that have every word of the query, without a stored index; none for a query of ignored words alone. The key
    must tell rows apart. No step of a stem changes a word's first letter, so only words that begin as a token of the query
    are stemmed. Those with its stems are few and are sent to the rows, which stay where they are: a word that all rows
    hold is in no single task."""
    tokens = wanted(rows.sparkSession, query)
    found = rows.select(F.explode(words(F.concat_ws(" ", *texts))).alias("word"), key).where(F.substring("word", 1, 1).isin([t[0] for t in tokens]))
    same = stem_words(found.select("word").distinct(), "word", "token").where(F.col("token").isin(tokens))
    has = {f"_has{i}": F.bool_or(F.col("token") == t) for i, t in enumerate(tokens)}
    keys = found.join(F.broadcast(same), "word").groupBy(key).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in has.items()])
    keys = keys.where(" and ".join(has) or "false").select(key)
    return rows.join(keys, key, "left_semi")
