"""Columns over historical years: a positive year and a BC flag.

Three numberings: signed (BC is negative), fractional (signed plus the part of the year), continuous (1 BC is 0).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Days of the months and before them, 365 days a year.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
DAYS_BEFORE = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# Precision levels of spans.
EXACT, APPROXIMATE, YEAR_ONLY, MONTH_ONLY, SEASON_ONLY, CIRCA, FALLBACK = 1000.0, 100.0, 10.0, 1.0, 0.25, 0.01, 0.0

SPAN = "struct<start_year:int,start_month:int,start_day:int,end_year:int,end_month:int,end_day:int,start_year_is_bc:boolean,end_year_is_bc:boolean,match_type:string,precision:double>"


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _bc(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def signed_year(year: Column, is_bc: Column) -> Column:
    return F.when(_bc(is_bc), -year).otherwise(year)


def day_of_year(month: Column, day: Column) -> Column:
    """Day of the year; a missing day is the middle of the month by integer division; null without a month."""
    m = F.when(month.between(1, 12), month).cast("int")
    return F.get(_numbers(DAYS_BEFORE), m - 1) + F.coalesce(day.cast("int"), F.floor(F.get(_numbers(MONTH_DAYS), m - 1) / 2).cast("int"))


def fractional_year(year: Column, is_bc: Column, month: Column, day: Column) -> Column:
    """Signed year plus day of the year over 365; null for a null year; the plain year without a month."""
    return signed_year(year, is_bc).cast("double") + F.coalesce(day_of_year(month, day) / F.lit(365.0), F.lit(0.0))


def continuous_year(year: Column, is_bc: Column) -> Column:
    return F.when(_bc(is_bc), 1 - year).otherwise(year)


def weight_days(span: Column, single_day: Column | None = None) -> Column:
    """Days that a span covers, at least 1; a missing or zero month or day counts as 1; fallback spans and single days weigh 1."""
    one = lambda c: F.when(c > 0, c).otherwise(1)
    day = lambda m, d: F.get(_numbers(DAYS_BEFORE), one(m) - 1) + one(d)
    years = continuous_year(span.end_year, span.end_year_is_bc) - continuous_year(span.start_year, span.start_year_is_bc)
    days = years * 365 + day(span.end_month, span.end_day) - day(span.start_month, span.start_day) + 1
    fixed = F.coalesce(span.precision == FALLBACK, F.lit(False))
    if single_day is not None:
        fixed = fixed | single_day
    return F.when(span.isNotNull(), F.when(fixed, 1).otherwise(F.greatest(F.lit(1), days)))


def war_weight(start: Column, start_bc: Column, end: Column, end_bc: Column) -> Column:
    return F.greatest(F.lit(1), continuous_year(end, end_bc) - continuous_year(start, start_bc) + 1) * 365


def food_weight(start: Column, start_bc: Column, end: Column, end_bc: Column) -> Column:
    """Years by continuous numbering, so a span across the eras isn't shortened."""
    return (F.abs(continuous_year(end, end_bc) - continuous_year(start, start_bc)) + 1) * 365


def upload_weight(weight: Column, precision: Column, start: Column, end: Column) -> Column:
    return F.coalesce(weight.cast("int"), (precision * F.abs(end - start) * 365).cast("int"), F.lit(0))


def span_is_valid(span: Column) -> Column:
    """No year 0, months 1-12, days 1-31, and the start not after the end (within a year by month, then day)."""
    start, end = continuous_year(span.start_year, span.start_year_is_bc), continuous_year(span.end_year, span.end_year_is_bc)
    ok = lambda c, top: c.isNull() | c.between(1, top)
    both = lambda a, b: a.isNull() | b.isNull()
    months = both(span.start_month, span.end_month) | (span.start_month < span.end_month) | ((span.start_month == span.end_month) & (both(span.start_day, span.end_day) | (span.start_day <= span.end_day)))
    fields = ok(span.start_month, 12) & ok(span.end_month, 12) & ok(span.start_day, 31) & ok(span.end_day, 31)
    return F.coalesce((span.start_year > 0) & (span.end_year > 0) & fields & ((start < end) | ((start == end) & months)), F.lit(False))


def display_year(year: Column, is_bc: Column) -> Column:
    return F.when((year.isNotNull()) & (year != 0), F.concat_ws(" ", year.cast("string"), F.when(_bc(is_bc), "BC").otherwise("AD")))


def date_range_text(start: Column, start_bc: Column, end: Column, end_bc: Column) -> Column:
    a, b = display_year(start, start_bc), display_year(end, end_bc)
    return F.when(b.isNull() | (a == b), a).otherwise(F.concat_ws(" to ", a, b))


def padded_date(year: Column, month: Column, day: Column, is_bc: Column) -> Column:
    parts = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.when(month.isNotNull(), day).cast("string"), 2, "0"))
    return F.when(year.isNotNull(), F.concat_ws(" ", parts, F.when(_bc(is_bc), "BC").otherwise("AD")))


def date_string(year: Column, is_bc: Column, month: Column, day: Column, confidence: Column) -> Column:
    """Prefix by confidence ("c." approximate, "?" contentious or legendary), day and month name where known."""
    name = F.initcap(F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1))
    prefix = F.when(confidence == "approximate", "c.").when(confidence.isin("contentious", "legendary"), "?")
    return F.concat_ws(" ", prefix, F.when(name.isNotNull(), day.cast("string")), name, display_year(F.abs(year), _bc(is_bc)))


def period_name(year: Column) -> Column:
    return F.when(year <= -753, "Legendary").when(year.between(-509, -28), "Early Republic").when(year.between(-27, 476), "Imperial").when(year.between(477, 1453), "Byzantine").otherwise("Ancient")


def confidence_for_year(year: Column, stated: Column) -> Column:
    return F.when((year <= -753) | (year == 0), "legendary").otherwise(stated)


def confidence_precision(confidence: Column) -> Column:
    return F.when(confidence == "explicit", 100.0).when(confidence == "inferred", 75.0).when(confidence == "approximate", 50.0).when(confidence == "contentious", 25.0).when(confidence == "legendary", 10.0)


def food_confidence(match_type: Column, contentious: Column, inferred: Column) -> Column:
    kind = F.lower(match_type)
    rough = kind.contains("circa") | kind.contains("century") | kind.contains("decade") | kind.contains("years ago") | kind.contains("tilde")
    return F.when(contentious, "contentious").when(inferred, "inferred").when(kind.contains("fallback"), "fallback").when(rough, "approximate").otherwise("explicit")


def ancient_precision(year: Column, is_bc: Column, precision: Column) -> Column:
    return F.when(_bc(is_bc) & (year > 10000) & (precision > 0.3), F.greatest(F.lit(0.1), precision * 0.5)).otherwise(precision)


def bc_ad_normalise(start: Column, end: Column) -> Column:
    """Signed years to struct<start_year, start_year_is_bc, end_year, end_year_is_bc, error>."""
    error = F.when((start == 0) | (end == 0), "year 0").when((start > 0) & (end > 0) & (start > end), "reversed range")
    return F.struct(F.abs(start).alias("start_year"), (start < 0).alias("start_year_is_bc"), F.abs(end).alias("end_year"), (end < 0).alias("end_year_is_bc"), error.alias("error"))


def century_years(n: Column, is_bc: Column, part: Column | None = None) -> Column:
    """struct<start, end> of the n-th century, or its early, mid or late third (parts of 33, 34 and 33 years)."""
    first = F.when(is_bc, n * 100).otherwise((n - 1) * 100 + 1)
    step = F.when(is_bc, -1).otherwise(1)
    lo, hi = F.lit(0), F.lit(99)
    if part is not None:
        lo = F.when(part == "mid", 33).when(part == "late", 67).otherwise(0)
        hi = F.when(part == "early", 32).when(part == "mid", 66).otherwise(99)
    return F.struct((first + step * lo).alias("start"), (first + step * hi).alias("end"))


def century_scope(n: Column, is_bc: Column) -> Column:
    """The scope of a century page: (n-1)*100 and the 99 years after it for AD, as century_years for BC."""
    own = century_years(n, is_bc)
    return F.struct(F.when(is_bc, own.start).otherwise((n - 1) * 100).alias("start"), F.when(is_bc, own.end).otherwise((n - 1) * 100 + 99).alias("end"))


def scope_from_title(title: Column) -> Column:
    """struct<precision, start, end, is_bc> from a year, decade or century page title; null for other titles."""
    get = lambda p, i=1: F.regexp_extract(title, p, i)
    bc = title.rlike(r"(?i)\bBCE?\b")
    number = lambda p: F.when(get(p) != "", get(p)).cast("int")
    century, decade, year = number(r"(?i)^\s*(\d{1,2})(?:st|nd|rd|th)[ _]century"), number(r"(?i)^\s*(\d{1,4})s\b"), number(r"(?i)^\s*(?:AD[ _])?(\d{1,4})(?:[ _](?:BCE?|AD|CE))?\s*$")
    span = century_scope(century, bc)
    make = lambda p, a, b: F.struct(F.lit(p).alias("precision"), a.cast("int").alias("start"), b.cast("int").alias("end"), bc.alias("is_bc"))
    by_decade = make("decade", F.when(bc, decade + 9).otherwise(decade), F.when(bc, F.greatest(decade, F.lit(1))).otherwise(decade + 9))
    return F.when(century.isNotNull(), make("century", span.start, span.end)).when(decade.isNotNull(), by_decade).when(year.isNotNull(), make("year", year, year))


def parse_year_bound(text: Column) -> Column:
    """"150 BC" -> struct<year, is_bc>; null when it isn't a year."""
    number = F.regexp_extract(text, r"(?i)^\s*(\d{1,5})\s*(?:BCE?|AD|CE)?\s*$", 1)
    return F.when(number != "", F.struct(number.try_cast("int").alias("year"), text.rlike(r"(?i)BCE?\s*$").alias("is_bc")))


def in_year_bounds(year: Column, is_bc: Column, low: Column, high: Column) -> Column:
    """Inclusive bounds as parse_year_bound gives them, null for none, compared on continuous years."""
    at = continuous_year(year, is_bc)
    return (low.isNull() | (at >= continuous_year(low.year, low.is_bc))) & (high.isNull() | (at <= continuous_year(high.year, high.is_bc)))


def month_number(name: Column, short: bool = False) -> Column:
    """1-12 of an English month name, with short also of its first three letters."""
    n = F.lower(F.trim(name))
    found = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), n)
    if short:
        found = F.greatest(found, F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.rtrim(n, F.lit("."))))
    return F.when(found > 0, found.cast("int"))


def belongs_to_bin(midpoint: Column, left: Column, width: Column, bins: int = 15) -> Column:
    """Number of the bin that holds the midpoint, null outside; the right edge belongs to the last bin."""
    at = F.floor((midpoint - left) / width).cast("int")
    return F.when((midpoint >= left) & (midpoint <= left + width * bins), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)))


def register_sql(spark: SparkSession) -> None:
    """SQL functions get_signed_position(year, is_bc) and to_fractional_year(year, is_bc, month, day)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION get_signed_position(y INT, bc BOOLEAN) RETURNS INT RETURN CASE WHEN bc THEN -y ELSE y END")
    before, days = (f"array({', '.join(map(str, v))})" for v in (DAYS_BEFORE, MONTH_DAYS))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION to_fractional_year(y INT, bc BOOLEAN, m INT, d INT) RETURNS DOUBLE RETURN CASE WHEN bc THEN -y ELSE y END + coalesce((get({before}, m - 1) + coalesce(d, get({days}, m - 1) div 2)) / 365.0D, 0.0D)")
