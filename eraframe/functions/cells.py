"""Dates in table cells, rows of war tables, and numbers scored as years by their context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import PatternRule
from .text import collapse_dashes, split_belligerents, strip
from .years import CIRCA, MONTHS, SEASON_ONLY, YEAR_ONLY, confidence_for_year, month_number

# First and last months of the seasons.
SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 12)}
MONTH = f"({'|'.join([*MONTHS, *(m[:3] for m in MONTHS)])})\\.?"


CELL_YEAR = PatternRule(r"^\s*(?:c(?:a|irca)?\.?\s*)?(?:(BCE?|AD|CE)\s*)?(\d{1,4})\s*(BCE?|AD|CE)?(?:-(?:(BCE?|AD|CE)\s*)?(\d{1,4})\s*(BCE?|AD|CE)?)?", None)


def _cell_parts(year: Column, text: Column) -> dict[str, Column]:
    """What the cells say: the groups of the year cell, the date cell's month, day and season."""
    get = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return {
        "found": CELL_YEAR.groups(year), "month": month_number(get(rf"(?i)\b{MONTH}\s*\d{{0,2}}", 1), short=True), "season": F.coalesce(*[F.when(text.contains(s), F.lit(s)) for s in SEASONS]),
        "day": F.coalesce(get(rf"(?i)(\d{{1,2}})\s+{MONTH}", 1), get(rf"(?i)\b{MONTH}\s+(\d{{1,2}})\b", 2)).try_cast("int"),
    }


def _cell_years(found: Column) -> dict[str, Column]:
    """Signed years of a year cell, each bound with its own era or else the other's; null unless both are over 0."""
    part = lambda i: F.nullif(F.get(found, F.lit(i - 1)), F.lit(""))
    era1, era2 = F.coalesce(part(1), part(3)), F.coalesce(part(4), part(6))
    first, last = part(2).try_cast("int"), part(5).try_cast("int")
    is_bc = lambda e: F.coalesce(F.upper(e).startswith("BC"), F.lit(False))
    start = _signed(first, is_bc(F.coalesce(era1, F.when(last.isNotNull(), era2))))
    end = F.coalesce(_signed(last, is_bc(F.coalesce(era2, era1))), start)
    ok = (first > 0) & (F.coalesce(last, F.lit(1)) > 0)
    return {"start": F.when(ok, start), "end": F.when(ok, end)}


def _cell_date(year: Column, text: Column, parts: dict[str, Column], years: dict[str, Column]) -> Column:
    m, day, season = parts["month"], parts["day"], parts["season"]
    s_first = F.coalesce(*[F.when(season == s, a) for s, (a, _) in SEASONS.items()])
    s_last = F.coalesce(*[F.when(season == s, b) for s, (_, b) in SEASONS.items()])
    rough, doubt = year.rlike(r"(?i)^\s*c(?:a|irca)?\.?\s*\d"), year.contains("?") | text.contains("?")
    stated = F.when(doubt, "contentious").when(rough, "approximate").otherwise("explicit")
    precision = F.when(rough, CIRCA).when(m.isNotNull() & day.isNotNull(), 1000.0).when(m.isNotNull(), 1.0).when(season.isNotNull(), SEASON_ONLY).otherwise(YEAR_ONLY)
    fields = years | {"start_month": F.coalesce(m, s_first), "start_day": F.when(m.isNotNull(), day), "end_month": F.coalesce(m, s_last), "precision": precision, "confidence": confidence_for_year(years["start"], stated)}
    return F.when(years["start"].isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def table_cell_date(year_cell: Column, date_cell: Column) -> Column:
    """struct<start, end, start_month, start_day, end_month, precision, confidence>, years signed; null without a year.

    The year cell is a year with its era after or before it, or a range; "c." makes it approximate and "?" contentious.
    The date cell gives a day and month in either order, a month, or a season. Years up to 753 BC are legendary."""
    year, text = collapse_dashes(F.coalesce(year_cell, F.lit(""))), F.lower(strip(F.coalesce(date_cell, F.lit(""))))
    parts = _cell_parts(year, text)
    return _cell_date(year, text, parts, _cell_years(parts["found"]))


def with_cell_date(df: DataFrame, year_cell: str, date_cell: str, out: str = "date") -> DataFrame:
    """Add table_cell_date in steps of columns, which keeps the generated code small, behind a generator, which no filter
    passes."""
    c = F.col
    rows = df.withColumns({"_year": collapse_dashes(F.coalesce(year_cell, F.lit(""))), "_text": F.lower(strip(F.coalesce(date_cell, F.lit(""))))})
    parts = _cell_parts(c("_year"), c("_text"))
    rows = rows.withColumns({f"_{n}": v for n, v in parts.items()}).withColumns({f"_{n}": v for n, v in _cell_years(c("_found")).items()})
    date = _cell_date(c("_year"), c("_text"), {n: c(f"_{n}") for n in parts}, {"start": c("_start"), "end": c("_end")})
    return rows.select(*[x for x in df.columns if x != out], F.explode(F.array(date)).alias(out))


def _signed(year: Column, before: Column) -> Column:
    return F.when(before, -year).otherwise(year)


# How many digits the years of a shape have.
DIGITS = {"long": r"\d{3,4}", "two": r"\d{2}", "short": r"\d{1,2}"}

BETWEEN = PatternRule(r"\(Between\s+(\d{1,4})\s+and\s+(\d{1,4})\s*(BC|AD)?E?\)", None)
RANGED = PatternRule(r"(\d{1,4})\s*(BCE?|AD|CE)?-(?:c\.\s*)?(?:(BCE?|AD|CE)\s*)?(\d{1,4})(?:\s*(BCE?|AD|CE))?", None)
CENTURY = PatternRule(r"(?:(Early|Mid|Late)[\s-]*)?(\d{1,2})(?:st|nd|rd|th)?\s*century\s*(BC|AD)?", None)


@dataclass
class _Shape:
    """A form of a war table's row: when it applies, its signed years, and the cell that holds the name."""

    name: str
    applies: Column
    start: Column
    end: Column
    title_at: int


def _war_shapes() -> list[_Shape]:
    """The nine shapes, in the order in which they are tried, over the columns that war_row makes first."""
    c = F.col
    group = lambda found, i: F.nullif(F.get(c(found), F.lit(i - 1)), F.lit(""))
    year = lambda found, i: group(found, i).try_cast("int")
    bc = lambda text: F.coalesce(text.rlike("(?i)bc"), F.lit(False))
    marked = lambda i, digits: c(f"_{digits}{i}") & c(f"_marked{i}")

    def one(digits: str) -> _Shape:
        second = c(f"_{digits}1") & c("_era1")
        return _Shape("date", (c("_width") >= 3) & marked(0, digits) & ~second & ~c("_open"), c("_year0"), c("_year0"), 1)

    def two(digits: str, any_era: bool = False) -> _Shape:
        is_date = (lambda i: c(f"_{digits}{i}")) if any_era else (lambda i: marked(i, digits))
        return _Shape("two dates", (c("_width") >= 4) & is_date(0) & (is_date(1) | c("_open")), c("_year0"), F.when(c("_open"), c("_year0")).otherwise(c("_year1")), 2)

    start_era, end_era = group("_ranged", 2), F.coalesce(group("_ranged", 3), group("_ranged", 5))
    era_bc = lambda mine, other: F.when(F.coalesce(mine, other).isNotNull(), bc(F.coalesce(mine, other))).otherwise(bc(c("_c0")))
    between_bc = bc(group("_between", 3))
    n, part, before = year("_century", 2), F.lower(group("_century", 1)), bc(group("_century", 3))
    first = F.when(before, -n * 100).otherwise((n - 1) * 100 + 1)
    low = F.when(part == "mid", 34).when(part == "late", 67).otherwise(0)
    high = F.when(part == "early", 33).when(part == "mid", 66).otherwise(99)
    has = lambda found: (c("_width") >= 2) & c(found).isNotNull()
    return [
        _Shape("between", has("_between"), _signed(year("_between", 1), between_bc), _signed(year("_between", 2), between_bc), 1),
        _Shape("range", has("_ranged"), _signed(year("_ranged", 1), era_bc(start_era, end_era)), _signed(year("_ranged", 4), era_bc(end_era, start_era)), 1),
        one("long"), two("long"), _Shape("century", has("_century"), first + low, first + high, 1), one("two"), two("two"), two("long", any_era=True), two("short"),
    ]


def war_row(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Add war: struct<shape, start_year, end_year, title, belligerents, notes>, years signed; null where no shape fits.

    Nine shapes are tried in order: "(Between a and b)", a range in one cell, one marked date, two marked dates, a
    century or its early, mid or late third, and then dates of two digits, two bare years, and dates of one digit. A date
    is marked by BC, AD or "c.". The cells after the dates are the name (without [n] marks), who fought, and notes, which
    are joined by a space. Centuries run in order of time, each end of a range has its own era or else the other's, and
    "present" in place of an end repeats the start. Rows without cells have no war.

    What a pattern finds in a cell is a column, which all shapes read; war leaves through a generator, which no filter
    passes, so that filters hold no copies of the shapes."""
    c = F.col
    cell = {f"_c{i}": collapse_dashes(strip(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))) for i in (0, 1)}
    rows = df.withColumns(cell | {"_width": F.size(cells)})
    found = {f"_{name}{i}": c(f"_c{i}").rlike(digits) for name, digits in DIGITS.items() for i in (0, 1)}
    found |= {f"_marked{i}": c(f"_c{i}").rlike(r"BC|AD|c\.") for i in (0, 1)} | {"_era1": c("_c1").rlike("BC|AD"), "_open": c("_c1").rlike("(?i)^(?:ongoing|present|current)$")}
    found |= {f"_year{i}": _signed(F.regexp_extract(f"_c{i}", r"(\d+)", 1).try_cast("int"), c(f"_c{i}").rlike("(?i)bc")) for i in (0, 1)}
    found |= {name: rule.groups(c("_c0")) for name, rule in (("_between", BETWEEN), ("_ranged", RANGED), ("_century", CENTURY))}
    shapes = _war_shapes()
    rows = rows.withColumns(found).withColumn("_shape", F.coalesce(*[F.when(s.applies, F.lit(i)) for i, s in enumerate(shapes)]))
    chosen = lambda f: F.coalesce(*[F.when(c("_shape") == i, f(s)) for i, s in enumerate(shapes)])
    rows = rows.withColumns({"_at": chosen(lambda s: F.lit(s.title_at)), "_start": chosen(lambda s: s.start), "_end": chosen(lambda s: s.end), "_name": chosen(lambda s: F.lit(s.name))})
    at = c("_at")
    title = F.regexp_replace(strip(F.regexp_replace(F.get(cells, at), r"(?U)\s+", " ")), r"\[\d+\]", "")
    fought = F.coalesce(split_belligerents(F.get(cells, at + 1)), F.array().cast("array<string>"))
    notes = strip(F.array_join(F.slice(cells, at + 3, F.greatest(F.size(cells) - at - 2, F.lit(0))), " "))
    fields = {"shape": c("_name"), "start_year": c("_start"), "end_year": c("_end"), "title": title, "belligerents": fought, "notes": notes}
    war = F.when(c("_start").isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))
    return rows.select(*df.columns, F.explode(F.array(war)).alias("war"))


# Units that make a number near them a measure, and words near a number that make it a year.
UNITS = r"\b(mm|cm|m|km|meter|meters|metre|metres|ft|feet|%|kg|g)\b"
YEAR_WORDS = ("in ", "c. ", "circa ", "born ", "died ", "founded ", "established ", "reigned ", "during ", "from ", "to ", "between ")
OLDEST_BC = 5000


def number_contexts(df: DataFrame, key: str, text: str, around: int = 25) -> DataFrame:
    """key, pos, number, era (BC, AD or empty), context: each number of one to four digits with the characters around it."""
    import re

    kind = dict(df.dtypes)[key]
    found = re.compile(r"(?<!\d)(\d{1,4})(?!\d)(?:\s*(BCE?|AD|CE)\b)?", re.I)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, m.start(), int(m[1]), {"B": "BC", "A": "AD", "C": "AD"}.get((m[2] or "-")[0].upper(), ""), t[max(0, m.start() - around) : m.end() + around].lower()) for k, t in zip(pdf[key], pdf[text], strict=True) if t for m in found.finditer(t)]
            yield pd.DataFrame(rows, columns=[key, "pos", "number", "era", "context"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, number int, era string, context string")


def scored_years(df: DataFrame, key: str, text: str, current_year: int = 2025) -> DataFrame:
    """key, start_year, is_bc, end_year, confidence: the best-scored number is the start (the first of equals); where its
    era has more numbers, the greatest of them is the end, else null. Texts without a fit number have no row.

    Left out are measures, numbers below 100 without an era, zeros, years over ten after current_year, and before 5000 BC.
    A score is 1, and 1 more near a word of time, 0.5 more from 1000 on, 0.2 less below 500 without an era; confidence is
    the least of 1 and 0.3 + 0.2 times the score."""
    c = F.col
    rows = number_contexts(df, key, text).withColumn("is_bc", c("era") == "BC").where(~c("context").rlike(UNITS) & (c("number") > 0))
    rows = rows.where((c("era") != "") | (c("number") >= 100)).where(F.when(c("is_bc"), c("number") <= OLDEST_BC).otherwise(c("number") <= current_year + 10))
    near = F.when(_any([c("context").contains(w) for w in YEAR_WORDS]), 1.0).otherwise(0.0)
    rows = rows.withColumn("score", 1.0 + near + F.when(c("number") >= 1000, 0.5).otherwise(0.0) - F.when((c("era") == "") & (c("number") < 500), 0.2).otherwise(0.0))
    at = F.struct(F.round("score", 6).alias("score"), -c("pos"))
    top = lambda bc: F.max(F.when(c("is_bc") == bc, c("number")))
    many = lambda bc: F.count_if(c("is_bc") == bc)
    best = rows.groupBy(key).agg(F.max_by(F.struct("number", "is_bc", "score"), at).alias("b"), F.struct(top(True).alias("bc"), top(False).alias("ad"), many(True).alias("n_bc"), many(False).alias("n_ad")).alias("t"))
    end = F.when(c("b.is_bc"), F.when(c("t.n_bc") > 1, c("t.bc"))).otherwise(F.when(c("t.n_ad") > 1, c("t.ad")))
    return best.select(key, c("b.number").alias("start_year"), c("b.is_bc").alias("is_bc"), end.alias("end_year"), F.least(F.lit(1.0), 0.3 + 0.2 * c("b.score")).alias("confidence"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def wikitable_events(rows: DataFrame) -> DataFrame:
    """Events of year/date/event tables: rows (page_id, tbl, row, year_filled, inherited, date_cell, event_cell) after
    rowspan_fill, to page_id, row, title, date, confidence (a carried year is inferred); rows without a year or text go."""
    out = with_cell_date(rows, "year_filled", "date_cell").where("date is not null and trim(event_cell) <> ''")
    sure = F.when(F.col("inherited") & (F.col("date.confidence") == "explicit"), "inferred").otherwise(F.col("date.confidence"))
    return out.select("page_id", "row", F.substring(strip(F.col("event_cell")), 1, 500).alias("title"), "date", sure.alias("confidence"))


