"""Date spans in text, as columns: rules, and profiles that take the first rule with a valid span."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse_dashes
from .years import APPROXIMATE, CIRCA, EXACT, FALLBACK, MONTH_DAYS, MONTH_ONLY, MONTHS, YEAR_ONLY, century_years, month_number, span_is_valid, weight_days

# Parts of phrases.
ERA = r"(BCE?|AD|CE)"
ORD = r"(?:st|nd|rd|th)"
MONTH = f"({'|'.join(MONTHS)})"
ABOUT = r"(?:c\s*\.|ca\s*\.|circa)\s*"
AD_OR_BC = rf"(?:\s*{ERA}\b)?"

#: Between groups of a match that are kept together.
CUT = "\u0001"


@dataclass
class Page:
    """What a rule may use beside the text: the page's year (also the anchor of "years ago") and its era."""

    year: Column
    bc: Column


Groups = Callable[[int], Column]
Rule = Callable[[Column, Page], Column]


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _is(era: Column, kind: str) -> Column:
    return F.coalesce(F.upper(era).isin(*(("BC", "BCE") if kind == "BC" else ("AD", "CE"))), F.lit(False))


def _bc(era: Column, page: Page, other: Column | None = None) -> Column:
    """BC by its own era; where neither it nor the other bound states one, by the page's."""
    bare = era.isNull() if other is None else era.isNull() & other.isNull()
    return _is(era, "BC") | (bare & F.coalesce(page.bc, F.lit(False)))


def span(start: Column, end: Column, start_bc: Column, end_bc: Column, kind: str, precision: float, months: tuple[Column, Column] | None = None, days: tuple[Column, Column] | None = None) -> Column:
    a, b = months or (F.lit(1), F.lit(12))
    c, d = days or (F.lit(1), F.lit(31))
    fields = {"start_year": _int(start), "start_month": _int(a), "start_day": _int(c), "end_year": _int(end), "end_month": _int(b), "end_day": _int(d), "start_year_is_bc": start_bc, "end_year_is_bc": end_bc, "match_type": F.lit(kind), "precision": F.lit(precision)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


class PatternRule:
    """A pattern on the text with dashes closed up, and a function of its groups (null where empty)."""

    def __init__(self, pattern: str, build: Callable[[Groups, Page], Column]):
        self.full, self.build, self.parts = f"(?i){pattern}", build, [self]
        self.count = re.compile(pattern).groups

    def groups(self, text: Column) -> Column:
        """All groups of the first match as one array, null without a match: the pattern runs once for all of them."""
        all_of_it = f"(?is)^.*?(?:{self.full[4:]}).*$"
        return F.when(text.rlike(self.full), F.split(F.regexp_replace(text, all_of_it, CUT.join(f"${i + 1}" for i in range(self.count))), CUT))

    def __call__(self, text: Column, page: Page) -> Column:
        found = self.groups(text)
        return F.when(found.isNotNull(), self.of(found, page))

    def of(self, found: Column, page: Page) -> Column:
        return self.build(lambda i: F.nullif(F.get(found, F.lit(i - 1)), F.lit("")), page)


class Either:
    """The first of some rules that matches."""

    def __init__(self, *rules: PatternRule):
        self.parts = list(rules)

    def __call__(self, text: Column, page: Page) -> Column:
        return F.coalesce(*[r(text, page) for r in self.parts])


rule = PatternRule


def _range(at: tuple[int, int, int, int], kind: str, precision: float) -> Callable[[Groups, Page], Column]:
    """A year range: BC at the end alone holds for the start too; without eras the page's era holds for both."""

    def build(g: Groups, page: Page) -> Column:
        s, e = g(at[1]), g(at[3])
        page_bc = s.isNull() & e.isNull() & F.coalesce(page.bc, F.lit(False))
        end = _is(e, "BC") | page_bc
        return span(g(at[0]), g(at[2]), _is(s, "BC") | page_bc | (_is(e, "BC") & ~_is(s, "AD")), end, kind, precision)

    return build


def _one(at: int, era: int | None, kind: str, precision: float) -> Callable[[Groups, Page], Column]:
    def build(g: Groups, page: Page) -> Column:
        bc = F.coalesce(page.bc, F.lit(False)) if era is None else _is(g(era), "BC") | (g(era).isNull() & F.coalesce(page.bc, F.lit(False)))
        return span(g(at), g(at), bc, bc, kind, precision)

    return build


def _short(g: Groups, page: Page) -> Column:
    """The end takes the start's century; AD rolls on to the next where it would precede the start, BC back."""
    bc = _is(g(2), "BC") | _is(g(4), "BC") | (g(2).isNull() & g(4).isNull() & F.coalesce(page.bc, F.lit(False)))
    start, low = _int(g(1)), _int(g(3))
    end = F.floor(start / 100).cast("int") * 100 + low
    end = F.when(~bc & (end < start), end + 100).when(bc & (end > start), end - 100).otherwise(end)
    return span(start, end, bc, bc, "Short year range", YEAR_ONLY)


def _decade(at: int, era: int, kind: str, precision: float) -> Callable[[Groups, Page], Column]:
    def build(g: Groups, page: Page) -> Column:
        bc, d = _bc(g(era), page), _int(g(at))
        return span(F.when(bc, d + 9).otherwise(d), F.when(bc, d).otherwise(d + 9), bc, bc, kind, precision)

    return build


def _decades(g: Groups, page: Page) -> Column:
    end_bc = _bc(g(4), page, g(2))
    start_bc = _is(g(2), "BC") | (end_bc & ~_is(g(2), "AD"))
    a, b = _int(g(1)), _int(g(3))
    return span(F.when(start_bc, a + 9).otherwise(a), F.when(end_bc, b).otherwise(b + 9), start_bc, end_bc, "Decade range", APPROXIMATE)


def _mirrored(g: Groups, page: Page) -> Column:
    s, e = F.coalesce(g(1), g(3)), F.coalesce(g(4), g(6))
    opposite = (_is(s, "BC") & _is(e, "AD")) | (_is(s, "AD") & _is(e, "BC"))
    return F.when(opposite, span(g(2), g(5), _is(s, "BC"), _is(e, "BC"), "Mirrored eras", YEAR_ONLY))


def _centuries(first: int, last: int, era: int, kind: str, precision: float, start_era: int | None = None) -> Callable[[Groups, Page], Column]:
    def build(g: Groups, page: Page) -> Column:
        end_bc = _bc(g(era), page, None if start_era is None else g(start_era))
        start_bc = end_bc if start_era is None else _is(g(start_era), "BC") | (end_bc & ~_is(g(start_era), "AD"))
        return span(century_years(_int(g(first)), start_bc).start, century_years(_int(g(last)), end_bc).end, start_bc, end_bc, kind, precision)

    return build


def _century_number(number: Column, suffix: Column) -> Column:
    """"17" with "00s" is the 18th century."""
    return _int(number) + F.when(F.lower(suffix) == "00s", 1).otherwise(0)


def _modified(g: Groups, page: Page) -> Column:
    part = F.lower(g(1))
    first, bc = _century_number(g(2), g(3)), _bc(g(6), page)
    last = F.coalesce(_century_number(g(4), F.coalesce(g(5), g(3))), first)
    own = century_years(first, bc, part)
    return span(own.start, F.when(g(4).isNull(), own.end).otherwise(century_years(last, bc).end), bc, bc, "Part of a century", APPROXIMATE)


def _before(g: Groups, page: Page) -> Column:
    """The century before the one named."""
    bc, n = _bc(g(3), page), _century_number(g(1), g(2))
    before = F.when(bc, n + 1).otherwise(n - 1)
    own = century_years(before, bc)
    return F.when(before > 0, span(own.start, own.end, bc, bc, "Before a century", APPROXIMATE))


def _ago(first: int, last: int, unit: int) -> Callable[[Groups, Page], Column]:
    def build(g: Groups, page: Page) -> Column:
        times = F.when(F.lower(g(unit)) == "million", 1_000_000.0).when(F.lower(g(unit)) == "thousand", 1_000.0).otherwise(1.0)
        ago = lambda i: (F.regexp_replace(g(i), ",", "").try_cast("double") * times).try_cast("int")
        return span(F.abs(page.year - ago(first)), F.abs(page.year - ago(last)), F.lit(True), F.lit(True), "Years ago", CIRCA)

    return build


def _days(year: Column | None, at: tuple[int, int, int, int], kind: str, years: tuple[int, int] | None = None) -> Callable[[Groups, Page], Column]:
    def build(g: Groups, page: Page) -> Column:
        a, b = (page.year, page.year) if years is None else (g(years[0]), g(years[1]))
        bc = F.coalesce(page.bc, F.lit(False))
        return span(a, b, bc, bc, kind, EXACT, (month_number(g(at[0])), month_number(g(at[2]))), (g(at[1]), g(at[3])))

    return build


def _month(g: Groups, page: Page) -> Column:
    m, bc = month_number(g(1)), F.coalesce(page.bc, F.lit(False))
    return span(page.year, page.year, bc, bc, "Month only", MONTH_ONLY, (m, m), (F.lit(1), F.get(F.array(*[F.lit(d) for d in MONTH_DAYS]), m - 1)))


def _fallback(text: Column, page: Page) -> Column:
    bc = F.coalesce(page.bc, F.lit(False))
    return F.when(page.year.isNotNull(), span(page.year, page.year, bc, bc, "Fallback", FALLBACK))


Y, YL, END = r"(\d{1,4})", r"(\d{3,4})", r"\s*\)\s*$"
PLACE = r"\(\s*[^()]+?\s*,\s*"
CENTURY = r"(00s|(?:st|nd|rd|th)\s+century)"

RULES: dict[str, Rule] = {
    "R1": rule(rf"^\s*{MONTH}\s+(\d{{1,2}}),\s*{Y}-{MONTH}\s+(\d{{1,2}}),\s*{Y}", _days(None, (1, 2, 4, 5), "Day range across years", (3, 6))),
    "R2": rule(rf"^\s*{MONTH}\s+(\d{{1,2}})-{MONTH}\s+(\d{{1,2}})", _days(None, (1, 2, 3, 4), "Day range across months")),
    "R3": rule(rf"^\s*{MONTH}\s+(\d{{1,2}})-(\d{{1,2}})", _days(None, (1, 2, 1, 3), "Day range in a month")),
    "R4": rule(rf"^\s*{MONTH}\s+(\d{{1,2}})(?!\d)", _days(None, (1, 2, 1, 2), "Single day")),
    "R5": rule(rf"^\s*{MONTH}\b", _month),
    "R6": rule(rf"\(\s*{YL}{AD_OR_BC}-(\d{{2}}){AD_OR_BC}{END}", _short),
    "R7": rule(rf"\(\s*{Y}{AD_OR_BC}-{Y}{AD_OR_BC}{END}", _range((1, 2, 3, 4), "Parenthesized range", YEAR_ONLY)),
    "R8": rule(rf"{PLACE}{Y}{AD_OR_BC}-{Y}{AD_OR_BC}{END}", _range((1, 2, 3, 4), "Parenthesized range with place", YEAR_ONLY)),
    "R9": rule(rf"\(\s*(?:{ERA}\s*)?{Y}{AD_OR_BC}-(?:{ERA}\s*)?{Y}{AD_OR_BC}{END}", _mirrored),
    "R10": rule(rf"\(\s*(?:[^()]+?\s*,\s*)?(\d{{3}}0)s{AD_OR_BC}-(\d{{3}}0)s{AD_OR_BC}{END}", _decades),
    "R11": rule(rf"\(\s*({ABOUT})?{Y}{AD_OR_BC}{END}", lambda g, p: F.when(g(1).isNull(), _one(2, 3, "Parenthesized year", YEAR_ONLY)(g, p)).otherwise(_one(2, 3, "Parenthesized circa year", CIRCA)(g, p))),
    "R12": rule(rf"\(\s*(?:{ABOUT}|≈\s*){Y}{AD_OR_BC}-(?:{ABOUT}|≈\s*)?{Y}{AD_OR_BC}{END}", _range((1, 2, 3, 4), "Parenthesized circa range", CIRCA)),
    "R13": rule(rf"{PLACE}{ABOUT}{Y}{AD_OR_BC}-(?:{ABOUT})?{Y}{AD_OR_BC}{END}", _range((1, 2, 3, 4), "Parenthesized circa range with place", CIRCA)),
    "R14": rule(rf"\(\s*(?:[^()]+?\s*,\s*)?(\d{{3}}0)s{AD_OR_BC}{END}", _decade(1, 2, "Parenthesized decade", APPROXIMATE)),
    "R15": rule(rf"^\s*{Y}{AD_OR_BC}-{Y}{AD_OR_BC}", _range((1, 2, 3, 4), "Year range", YEAR_ONLY)),
    "R16": rule(rf"^\s*{Y}\s*{ERA}\b", _one(1, 2, "Year with era", YEAR_ONLY)),
    "R17": rule(rf"^\s*{YL}\b", _one(1, None, "Year only", YEAR_ONLY)),
    "R18": rule(rf"^\s*{ABOUT}{YL}{AD_OR_BC}\b", _one(1, 2, "Circa year", CIRCA)),
    "R19": rule(rf"^\s*~\s*{YL}{AD_OR_BC}\b", _one(1, 2, "Tilde circa year", CIRCA)),
    "R20": rule(rf"^\s*(\d{{1,2}}){ORD}\s+century{AD_OR_BC}\b", _centuries(1, 1, 2, "Century", APPROXIMATE)),
    "R21": rule(rf"^\s*(\d{{1,2}}){ORD}-(\d{{1,2}}){ORD}\s+centuries{AD_OR_BC}\b", _centuries(1, 2, 3, "Century range", APPROXIMATE)),
    "R22": Either(rule(rf"^\s*(Early|Mid|Late)[\s-]+(\d{{1,2}}){CENTURY}(?:-(\d{{1,2}}){CENTURY}?)?{AD_OR_BC}\b", _modified), rule(rf"^\s*Before\s+(\d{{1,2}}){CENTURY}{AD_OR_BC}\b", _before)),
    "R23": Either(rule(r"^\s*([\d,.]+)-([\d,.]+)\s+(million|thousand)?\s*years?\s+ago\b", _ago(1, 2, 3)), rule(r"^\s*([\d,.]+)\s+(million|thousand)?\s*years?\s+ago\b", _ago(1, 1, 2))),
    "R24": rule(rf"^\s*(\d{{3}}0)s{AD_OR_BC}\b", _decade(1, 2, "Decade", YEAR_ONLY)),
    "R25": Either(rule(rf"{PLACE}(\d{{1,2}}){ORD}?{AD_OR_BC}-(\d{{1,2}}){ORD}?\s*(?:centuries|century)?{AD_OR_BC}{END}", _centuries(1, 3, 4, "Century range with place", YEAR_ONLY, 2)), rule(rf"{PLACE}(\d{{1,2}}){ORD}\s+century{AD_OR_BC}{END}", _centuries(1, 1, 2, "Century with place", YEAR_ONLY))),
    "R26": _fallback,
}

PROFILES: dict[str, tuple[str, ...]] = {
    "years": ("R6", "R1", "R2", "R3", "R4", "R5", "R15", "R11", "R16", "R17", "R18", "R26"),
    "time_periods": ("R6", "R7", "R12", "R14", "R10", "R11", "R9", "R8", "R13", "R25", "R12"),
    "inline": ("R6", "R1", "R2", "R3", "R4", "R5", "R15", "R11", "R16", "R17", "R18"),
    "food": ("R16", "R15", "R7", "R6", "R23", "R17", "R18", "R19", "R12", "R21", "R22", "R20", "R24", "R10", "R14", "R11", "R26"),
}
#: Food rules in sections: without the fallback, so that a heading's span can be inherited.
PROFILES["food_inline"] = PROFILES["food"][:-1]
#: Year cells of war tables: ranges before single years.
PROFILES["war"] = ("R15", "R21", "R20", "R16", "R18", "R17")


def add_rule(name: str, own: Rule, profile: str, first: bool = False) -> None:
    """Put a rule of one's own into a profile."""
    RULES[name] = own
    PROFILES[profile] = (name, *PROFILES[profile]) if first else (*PROFILES[profile], name)


def valid(candidate: Column) -> Column:
    return F.when(span_is_valid(candidate), candidate)


@cache
def _columns(rules: tuple[Rule, ...], session: object) -> tuple[dict[str, Column], dict[str, Column], Column, Column]:
    """Groups and spans of rules over _text, _year and _bc, the first valid span, and its weight. Built once a session:
    columns don't know the rows they will be used on."""
    page = Page(F.col("_year"), F.col("_bc"))
    parts = [part for r in dict.fromkeys(rules) for part in getattr(r, "parts", [r])]
    matched = {f"_groups{i}": part.groups(F.col("_text")) for i, part in enumerate(parts) if isinstance(part, PatternRule)}
    found = {f"_rule{i}": F.when(F.col(f"_groups{i}").isNotNull(), part.of(F.col(f"_groups{i}"), page)) if isinstance(part, PatternRule) else part(F.col("_text"), page) for i, part in enumerate(parts)}
    first = F.coalesce(*[valid(F.col(n)) for n in found])
    return matched, found, first, weight_days(F.col("_span"), F.col("_span").match_type == "Single day")


def extract_spans(df: DataFrame, text: str, page_year: str | Column, page_bc: str | Column, profile: str, out: str = "span") -> DataFrame:
    """Add a span column, the first rule of the profile that gives a valid span (null without one), and its weight in days.

    The groups of each rule's match are columns of their own, then the rules' spans, so that each pattern runs once and
    the generated code stays small. Span and weight leave through a generator of one row, through which the optimizer
    moves no filter: a filter on a span would otherwise hold a copy of all rules for each time that they name each other.
    Where rows choose their profile, use extract_by_profile.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    matched, found, first, weight = _columns(tuple(RULES[n] for n in PROFILES[profile]), df.sparkSession.sparkContext._jsc)
    rows = df.withColumns({"_text": collapse_dashes(F.col(text)), "_year": column(page_year), "_bc": column(page_bc)})
    rows = rows.withColumns(matched).withColumns(found).withColumn("_span", first).withColumn("_weight", weight)
    keep = [c for c in df.columns if c not in (out, "weight")]
    rows = rows.select(*keep, F.explode(F.array(F.struct("_span", "_weight"))).alias("_dated"))
    return rows.select(*keep, F.col("_dated._span").alias(out), F.col("_dated._weight").alias("weight"))


def extract_by_profile(df: DataFrame, text: str, page_year: str, page_bc: str, profile: str) -> DataFrame:
    """As extract_spans, with the profile named by a column; unknown names take the years profile."""
    known = [p for p in PROFILES if p != "years"]
    parts = [extract_spans(df.where(F.col(profile) == p), text, page_year, page_bc, p) for p in known]
    out = extract_spans(df.where(~F.coalesce(F.col(profile).isin(known), F.lit(False))), text, page_year, page_bc, "years")
    for p in parts:
        out = out.unionByName(p)
    return out


def year_tokens(text: Column) -> Column:
    """Up to 50 numbers of one to four digits with their era, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?<![\d#])(\d{1,4}(?:\s*(?:BCE?|AD|CE)\b)?)(?!\d)"), 1)
    number = lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")
    return F.transform(F.slice(found, 1, 50), lambda x: F.struct(number(x).alias("year"), x.rlike(r"(?i)BCE?$").alias("is_bc"), x.rlike("(?i)[A-Z]").alias("marked")))


def first_last_years(text: Column) -> Column:
    """struct<start, end, confidence> of the first and last numbers."""
    t = year_tokens(text)
    return F.when(F.size(t) > 0, F.struct(F.get(t, F.lit(0)).alias("start"), F.get(t, F.size(t) - 1).alias("end"), F.lit(0.2).alias("confidence")))


def best_extraction(rows: DataFrame, key: str) -> DataFrame:
    """For each key the extraction with a start year, then the most confident one."""
    item = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(item, F.struct(F.col("start_year").isNotNull().alias("has"), "confidence")).alias("best")).select(key, "best.*")


def date_chunks(text: Column) -> Column:
    """Parts of a text that may be a date: in brackets, between commas, after "between", "from", "around" and the like."""
    patterns = (r"\(([^()]{3,80})\)", r",\s*([^,()]{3,60})(?=,|$)", r"(?i)\b(?:between|from|around|about|by|in)\s+([^,.;()]{3,60})")
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: F.trim(x)) for p in patterns])


def embedded_date(df: DataFrame, key: str, text: str, page_year: str, page_bc: str) -> DataFrame:
    """The first valid food span among the date_chunks of a text."""
    rows = df.select(key, page_year, page_bc, F.posexplode(date_chunks(F.col(text))).alias("pos", "chunk"))
    spans = extract_spans(rows, "chunk", page_year, page_bc, "food_inline").where("span is not null")
    return spans.groupBy(key).agg(F.min_by("span", "pos").alias("span"), F.min_by("chunk", "pos").alias("chunk"))
