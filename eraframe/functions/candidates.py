"""Items of chronology pages: which kind each is, and its years, its own or those of what it stands under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import extract_spans
from .text import strip, strip_citations

# Words of items that are no events (without those of a single topic or site; pass those as no_event), the centuries that a page gives to undated items, and their years.
NO_EVENT = ("see also", "references", "external links", "bibliography", "sources", "navigation", "categories", "history of", "^ ")
CENTURIES = {"19th": (1801, 1900), "20th": (1901, 2000), "21st": (2001, 2026)}
UNKNOWN = (1900, 1900)
DATE_LIKE = r"(?i)\b\d{1,4}\s*(?:BC|AD|BCE|CE)\b|\bcirca\b|\b\d{1,4}(?:st|nd|rd|th)\s+century\b|\b\d{4}\b"


def clause_title(text: Column) -> Column:
    """The first sentence with its period; without one, up to the first comma or semicolon; when that has five characters
    or fewer, the first 50."""
    sentence = F.regexp_extract(text, r"(?s)^([^.]+\.)", 1)
    part = strip(F.when(sentence != "", sentence).otherwise(F.regexp_extract(text, r"(?s)^([^,;]+)", 1)))
    return F.when(F.length(part) > 5, part).otherwise(strip(F.substring(text, 1, 50)))


def sentence_title(text: Column) -> Column:
    """The first sentence of more than ten characters without its bullet, else up to 15 words that end at the first comma
    or semicolon, else the first 80 characters."""
    sentence = F.split(text, r"(?<=[.!?])\s+").getItem(0)
    words = F.array_join(F.slice(F.split(text, r"\s+"), 1, 15), " ")
    clause = F.regexp_extract(words, r"^[^,;]*[,;]?", 0)
    return F.when(F.length(sentence) > 10, F.regexp_replace(strip(sentence), r"^\s*[-•]\s*", "")).when(F.size(F.split(text, r"\s+")) > 3, clause).otherwise(strip(F.substring(text, 1, 80)))


def candidate_kinds(df: DataFrame, text: str, article_title: str, century: str, no_event: tuple[str, ...] = NO_EVENT) -> DataFrame:
    """Add candidate: struct<kind, title, start_year, end_year, is_bc_start, is_bc_end, precision>, null for items that
    are no events.

    kind is "reference" (names a main article), "header" (short, ends with a colon), "dated" (an own date in front of it)
    or "undated": ten characters or more, no word of a list or source section, and a century of the page or something
    like a date. Undated ones take the century that the article's title names, else that of the page's century column,
    else 1900, at a precision of 0.1. References and headers have no years. Null texts have no kind."""
    own = "_own"
    rows = df.withColumnRenamed("weight", "_own_weight").withColumn("_item", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = extract_spans(rows, "_item", F.lit(None).cast("int"), F.lit(False), "inline", own).drop("weight")
    item, title, age = F.col("_item"), F.coalesce(F.col(article_title), F.lit("")), F.col(century)
    bare = strip(F.regexp_replace(item, r"\[\d+\]", ""))
    listed = F.exists(F.array(*[F.lit(w) for w in no_event]), lambda w: F.contains(F.lower(item), w))
    placed = title.contains("19th") | F.coalesce(age.isin(*CENTURIES), F.lit(False)) | item.rlike(DATE_LIKE)
    kind = (
        F.when(item.rlike(r"(?i)Main article:\s*."), "reference").when(bare.endswith(":") & (F.length(bare) < 50), "header").when(F.col(own).isNotNull(), "dated")
        .when((F.length(item) >= 10) & ~listed & placed, "undated")
    )
    side = lambda i: F.coalesce(*[F.when(title.contains(c), y[i]) for c, y in CENTURIES.items()], *[F.when(age == c, y[i]) for c, y in CENTURIES.items()], F.lit(UNKNOWN[i]))
    dated, undated = F.col("_kind") == "dated", F.col("_kind") == "undated"
    years = {
        "title": F.when(dated, clause_title(item)).when(undated, sentence_title(strip_citations(item))),
        "start_year": F.when(dated, F.col(own).start_year).when(undated, side(0)), "end_year": F.when(dated, F.col(own).end_year).when(undated, side(1)),
        "is_bc_start": F.when(dated, F.col(own).start_year_is_bc).when(undated, False), "is_bc_end": F.when(dated, F.col(own).end_year_is_bc).when(undated, False),
        "precision": F.when(dated, 1.0).when(undated, 0.1),
    }
    found = F.struct(F.col("_kind").alias("kind"), *[c.alias(n) for n, c in years.items()])
    return rows.withColumn("_kind", kind).withColumn("candidate", F.when(F.col("_kind").isNotNull(), found)).drop("_item", "_kind", own).withColumnRenamed("_own_weight", "weight")
