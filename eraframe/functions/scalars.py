"""Dates of cells, war rows and food spans of one text in Python, for jobs that read whole pages in a worker.

The rules are those of the columns in cells and spans, to which the tests hold them. Texts have no white space but single
blanks, as blocks have them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from .cells import BETWEEN, CELL_YEAR, CENTURY, RANGED, SEASONS
from .cells import MONTH as CELL_MONTH
from .spans import PROFILES, RULES, PatternRule
from .text import META
from .years import APPROXIMATE, CIRCA, MONTHS, SEASON_ONLY, YEAR_ONLY

MOST_INT = 2**31 - 1
_DASHES, _CLOSED = re.compile("[‐-―−]"), re.compile(" *-+ *")


def remembered(f: Callable) -> Callable:
    """f of a text with what it gave for the last 20,000 short ones; longer ones would take too much memory."""
    short = lru_cache(20000)(f)
    return lambda text, *more: short(text, *more) if len(text) <= 100 else f(text, *more)


def compiled(pattern: str, case: bool = False) -> re.Pattern:
    """A pattern as Java reads it on texts that `plain` gives: classes and case are ASCII, word ends are not."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)"), re.A if case else re.A | re.I)


class _Plain(dict):
    """Other letters, digits and marks on them as one letter, all else but dashes and ≈ as a point: patterns tell no more of them."""

    def __missing__(self, char: int) -> str:
        c = chr(char)
        kind = unicodedata.category(c)
        self[char] = out = c if char < 128 or c in "≈−" or "‐" <= c <= "―" else "é" if kind[0] == "L" or kind in ("Nd", "Mn") else "·"
        return out


_plain = _Plain()


def plain(text: str) -> str:
    return text if text.isascii() else text.translate(_plain)


def closed(text: str) -> str:
    """One dash without blanks around it."""
    if not text.isascii():
        text = _DASHES.sub("-", text)
    return _CLOSED.sub("-", text) if "-" in text else text


def whole(digits: str | None) -> int | None:
    """An int of digits, null where it is none or too large."""
    if not digits:
        return None
    n = int(digits) if len(digits) < 4000 else MOST_INT + 1
    return n if n <= MOST_INT else None


# Cells of year tables

_CELL_YEAR = compiled(CELL_YEAR.full[4:])
_CELL_MONTH, _DAY_MONTH, _MONTH_DAY = compiled(rf"\b{CELL_MONTH}\s*\d{{0,2}}"), compiled(rf"(\d{{1,2}})\s+{CELL_MONTH}"), compiled(rf"\b{CELL_MONTH}\s+(\d{{1,2}})\b")
_ROUGH = compiled(r"^\s*c(?:a|irca)?\.?\s*\d")
_MONTH_AT = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)}


def _is_bc(era: str | None) -> bool:
    return era is not None and era[0] in "bB"


def _cell_years(year: str) -> tuple[int, int, bool, bool] | None:
    """Signed years, whether about, whether doubtful."""
    m = _CELL_YEAR.match(year)
    if not m:
        return None
    a, first, b, c, last, d = (x or None for x in m.groups())
    era1, era2 = a or b, c or d
    start, end = int(first), last and int(last)
    if start <= 0 or end is not None and end <= 0:
        return None
    low = -start if _is_bc(era1 or (end is not None and era2 or None)) else start
    high = low if end is None else -end if _is_bc(era2 or era1) else end
    return low, high, _ROUGH.match(year) is not None, "?" in year


def _cell_day(text: str) -> tuple[int | None, int | None, str | None, bool]:
    """Month, day and season of a date cell in small letters, and whether it is doubtful."""
    doubt = "?" in text
    season = next((s for s in SEASONS if s in text), None)
    m = _CELL_MONTH.search(text)
    month = _MONTH_AT[m[1].lower()] if m else None
    m = _DAY_MONTH.search(text)
    day = m[1] if m else None
    if day is None:
        m = _MONTH_DAY.search(text)
        day = m[2] if m else None
    return month, whole(day), season, doubt


@remembered
def _cell_date_years(year: str) -> tuple[int, int, bool, bool] | None:
    return _cell_years(plain(closed(year)))


@remembered
def _cell_date_day(text: str) -> tuple[int | None, int | None, str | None, bool]:
    return _cell_day(plain(text.strip(" ").lower()))


def cell_date(year_cell: str | None, date_cell: str | None) -> tuple | None:
    """table_cell_date: start, end, start_month, start_day, end_month, precision, confidence; none without a year."""
    years = _cell_date_years(year_cell or "")
    if years is None:
        return None
    start, end, rough, doubt = years
    month, day, season, unsure = _cell_date_day(date_cell or "")
    if month is None:
        day = None
    first, last = (month, month) if month else SEASONS[season] if season else (None, None)
    precision = CIRCA if rough else 1000.0 if day is not None else 1.0 if month else SEASON_ONLY if season else YEAR_ONLY
    sure = "legendary" if start <= -753 else "contentious" if doubt or unsure else "approximate" if rough else "explicit"
    return start, end, first, day, last, precision, sure


# Rows of war tables

_MARKED, _ERA, _OPEN, _NUMBER = compiled(r"BC|AD|c\.", True), compiled("BC|AD", True), compiled("^(?:ongoing|present|current)$"), compiled(r"\d+")
_BETWEEN, _RANGED, _CENTURY = (compiled(r.full[4:]) for r in (BETWEEN, RANGED, CENTURY))
_FIGURES = compiled(r"\d{1,4}")
_SPLITS = [compiled(p) for p in (r"\s+vs\.?\s+", r"\s+v\.?\s+", r"\s+versus\s+", ";", ",")]
_MARKS = compiled(r"\[\d+\]")


def _bc(text: str | None) -> bool:
    return text is not None and "bc" in text.lower()


def _sign(year: int | None, before: bool) -> int | None:
    return year if year is None or not before else -year


@remembered
def _cell(text: str) -> tuple[int, bool, bool, int | None, bool]:
    """Of a cell: the most digits that follow each other (four at most), whether it is marked as a date and by an era, its signed year,
    whether it says that a war goes on."""
    text = plain(closed(text))
    found = _FIGURES.findall(text)
    if not found:
        return 0, False, False, None, _OPEN.search(text) is not None
    return max(map(len, found)), _MARKED.search(text) is not None, _ERA.search(text) is not None, _sign(whole(_NUMBER.search(text)[0]), _bc(text)), False


@remembered
def _war_span(c0: str) -> tuple[str, int | None, int | None] | None:
    """A shape that one cell tells, before and after those of dates: between and range; century."""
    c0 = plain(closed(c0))
    m = _BETWEEN.search(c0)
    if m:
        before = _bc(m[3])
        return "between", _sign(int(m[1]), before), _sign(int(m[2]), before)
    m = _RANGED.search(c0)
    if m:
        mine, other = m[2] or None, m[3] or m[5] or None
        bc = lambda a, b: _bc(a or b or c0)
        return "range", _sign(int(m[1]), bc(mine, other)), _sign(int(m[4]), bc(other, mine))
    m = _CENTURY.search(c0)
    if not m:
        return None
    n, part = int(m[2]), (m[1] or "").lower()
    first = -n * 100 if _bc(m[3]) else (n - 1) * 100 + 1
    return "century", first + {"mid": 34, "late": 67}.get(part, 0), first + {"early": 33, "mid": 66}.get(part, 99)


def war_dates(cells: list[str]) -> tuple[str, int | None, int | None, int] | None:
    """The shape of a war table's row, its signed years, and the place of its name; none where no shape fits."""
    width = len(cells)
    if width < 2:
        return None
    c0, c1 = cells[0], cells[1]
    told = _war_span(c0)
    if told and told[0] != "century":
        return *told, 1
    n0, marked0, _, year0, _ = _cell(c0)
    if width < 3 or not n0:
        return (*told, 1) if told else None
    n1, marked1, era1, year1, current = _cell(c1)

    def date(least: int) -> tuple | None:
        if n0 >= least and marked0 and not (n1 >= least and era1) and not current:
            return "date", year0, year0, 1
        return None

    def dates(least: int, any_era: bool = False) -> tuple | None:
        if width >= 4 and n0 >= least and (any_era or marked0) and (current or (n1 >= least and (any_era or marked1))):
            return "two dates", year0, year0 if current else year1, 2
        return None

    return date(3) or dates(3) or ((*told, 1) if told else None) or date(2) or dates(2) or dates(3, any_era=True) or dates(1)


@remembered
def belligerents(text: str) -> list[str]:
    for sep in _SPLITS:
        parts = sep.split(text)
        if len(parts) > 1:
            break
    else:
        parts = [text]
    return [p for p in (x.strip(" ") for x in parts) if p]


def war_event(cells: list[str]) -> tuple | None:
    """A row of a war table as war_row reads it: shape, start, end (signed), title, belligerents, notes."""
    dates = war_dates(cells)
    if dates is None or dates[1] is None:
        return None
    shape, start, end, at = dates
    title = cells[at].strip(" ") if at < len(cells) else None
    if title and "[" in title:
        title = _MARKS.sub("", title)
    fought = belligerents(cells[at + 1]) if at + 1 < len(cells) else []
    return shape, start, end, title, fought, " ".join(cells[at + 2 :]).strip(" ")


# Spans of the food profile in sections: pages without an era, and a year that "years ago" counts from


Span = tuple[int, int, bool, bool, str, float]
Found = Callable[[re.Match, int], tuple | None]


def _era(text: str | None, kind: str = "b") -> bool:
    """BC or BCE; AD or CE with kind "a"."""
    return bool(text) and (text[0] in "bB") == (kind == "b")


def _range(kind: str, precision: float) -> Found:
    def build(m: re.Match, anchor: int) -> tuple:
        s, e = m[2], m[4]
        return int(m[1]), int(m[3]), _era(s) or (_era(e) and not _era(s, "a")), _era(e), kind, precision

    return build


def _one(at: int, era: int | None, kind: str, precision: float) -> Found:
    def build(m: re.Match, anchor: int) -> tuple:
        bc = era is not None and _era(m[era])
        return int(m[at]), int(m[at]), bc, bc, kind, precision

    return build


def _short(m: re.Match, anchor: int) -> tuple:
    bc, start = _era(m[2]) or _era(m[4]), int(m[1])
    end = start // 100 * 100 + int(m[3])
    end += 100 if not bc and end < start else -100 if bc and end > start else 0
    return start, end, bc, bc, "Short year range", YEAR_ONLY


def _decade(kind: str, precision: float) -> Found:
    def build(m: re.Match, anchor: int) -> tuple:
        bc, d = _era(m[2]), int(m[1])
        return (d + 9, d, bc, bc, kind, precision) if bc else (d, d + 9, bc, bc, kind, precision)

    return build


def _decades(m: re.Match, anchor: int) -> tuple:
    end_bc = _era(m[4])
    start_bc = _era(m[2]) or (end_bc and not _era(m[2], "a"))
    a, b = int(m[1]), int(m[3])
    return a + 9 if start_bc else a, b if end_bc else b + 9, start_bc, end_bc, "Decade range", APPROXIMATE


def _century_years(n: int, bc: bool, part: str | None = None) -> tuple[int, int]:
    first, step = (n * 100, -1) if bc else ((n - 1) * 100 + 1, 1)
    return first + step * {"mid": 33, "late": 67}.get(part or "", 0), first + step * {"early": 32, "mid": 66}.get(part or "", 99)


def _centuries(last: int, era: int, kind: str) -> Found:
    def build(m: re.Match, anchor: int) -> tuple:
        bc = _era(m[era])
        return _century_years(int(m[1]), bc)[0], _century_years(int(m[last]), bc)[1], bc, bc, kind, APPROXIMATE

    return build


def _number(digits: str, suffix: str) -> int:
    return int(digits) + (suffix.lower() == "00s")


def _modified(m: re.Match, anchor: int) -> tuple:
    part, first, bc = m[1].lower(), _number(m[2], m[3]), _era(m[6])
    start, end = _century_years(first, bc, part)
    if m[4]:
        end = _century_years(_number(m[4], m[5] or m[3]), bc)[1]
    return start, end, bc, bc, "Part of a century", APPROXIMATE


def _before(m: re.Match, anchor: int) -> tuple | None:
    bc, n = _era(m[3]), _number(m[1], m[2])
    n += 1 if bc else -1
    return (*_century_years(n, bc), bc, bc, "Before a century", APPROXIMATE) if n > 0 else None


def _ago(last: int, unit: int) -> Found:
    def build(m: re.Match, anchor: int) -> tuple | None:
        times = {"million": 1_000_000.0, "thousand": 1_000.0}.get((m[unit] or "").lower(), 1.0)
        years = []
        for i in (1, last):
            try:
                ago = float(m[i].replace(",", "")) * times
            except ValueError:
                return None
            if ago >= MOST_INT + 1:
                return None
            years.append(abs(anchor - int(ago)))
        return *years, True, True, "Years ago", CIRCA

    return build


def _circa(m: re.Match, anchor: int) -> tuple:
    return _one(2, 3, "Parenthesized circa year", CIRCA)(m, anchor) if m[1] else _one(2, 3, "Parenthesized year", YEAR_ONLY)(m, anchor)


_BUILT: dict[str, tuple[Found, ...]] = {
    "R6": (_short,), "R7": (_range("Parenthesized range", YEAR_ONLY),), "R10": (_decades,), "R11": (_circa,), "R12": (_range("Parenthesized circa range", CIRCA),), "R14": (_decade("Parenthesized decade", APPROXIMATE),),
    "R15": (_range("Year range", YEAR_ONLY),), "R16": (_one(1, 2, "Year with era", YEAR_ONLY),), "R17": (_one(1, None, "Year only", YEAR_ONLY),), "R18": (_one(1, 2, "Circa year", CIRCA),), "R19": (_one(1, 2, "Tilde circa year", CIRCA),),
    "R20": (_centuries(1, 2, "Century"),), "R21": (_centuries(2, 3, "Century range"),), "R22": (_modified, _before), "R23": (_ago(2, 3), _ago(1, 2)), "R24": (_decade("Decade", YEAR_ONLY),),
}
#: The profile and its rules as they are here; a caller's own rules are columns alone.
_PROFILE, _OF = PROFILES["food_inline"], {n: RULES[n] for n in PROFILES["food_inline"]}
#: Patterns with what is made of their groups: those that begin with a bracket, which need one in the text, and those at its start.
_FOOD = [(p.startswith(r"\("), compiled(p), build) for n in _PROFILE for part, build in zip(_OF[n].parts, _BUILT[n], strict=True) for p in [part.full[4:]] if isinstance(part, PatternRule)]


def has_own_rules() -> bool:
    """Whether a caller changed the rules of food_inline."""
    return PROFILES["food_inline"] != _PROFILE or any(RULES[n] is not r for n, r in _OF.items())


@remembered
def _span(text: str, anchor: int) -> Span | None:
    text = plain(closed(text))
    bracket = "(" in text
    for inside, pattern, build in _FOOD:
        if inside:
            if not bracket:
                continue
            m = pattern.search(text)
        else:
            m = pattern.match(text)
        if m:
            s = build(m, anchor)
            if s is not None and s[0] > 0 and s[1] > 0 and (1 - s[0] if s[2] else s[0]) <= (1 - s[1] if s[3] else s[1]):
                return s
    return None


_DIGIT = compiled(r"\d")


def food_span(text: str, anchor: int) -> Span | None:
    """The first valid span of food_inline: years, whether BC, match_type, precision. All its rules need a digit."""
    return _span(text, anchor) if _DIGIT.search(text) else None


_CHUNKS = [(sign, compiled(p)) for sign, p in (("(", r"\(([^()]{3,80})\)"), (",", r",\s*([^,()]{3,60})(?=,|$)"), (" ", r"\b(?:between|from|around|about|by|in)\s+([^,.;()]{3,60})"))]


def chunks(text: str) -> Iterator[str]:
    """date_chunks of a text, as plain gives them."""
    text = plain(text)
    for sign, pattern in _CHUNKS:
        if sign in text:
            for x in pattern.findall(text):
                yield x.strip(" ")


_TWO = compiled(r"^\s*(\d{1,4})\s*[-–—−]\s*(\d{1,4})\s*(BCE|BC|CE|AD)?\s*$")
_CITED, _DOUBT = compiled(r"\[(?:\d+|[a-z]|note \d+|citation needed)\]", True), compiled(r"\b(?:contentious|disputed)\b")
_STOP, _CLAUSE, _CUT, _BLANKS = compiled(r"(?s)^(.*?)\.(?:\s|$)"), compiled(r"^([^,;]*)"), compiled(r"(?s)^(.{50,70})(?=\s)"), compiled(r"\s+")
_META = frozenset(META)


def said(text: str) -> str:
    """A text without citations and [edit] marks."""
    return _CITED.sub("", text).strip(" ").replace("[edit]", "").strip(" ") if "[" in text else text.strip(" ")


def heading_years(text: str, level: int, own: Span | None) -> tuple[int, int, bool, bool] | None:
    m = _TWO.search(text)
    if m:
        bc = _era(m[3])
        return int(m[1]), int(m[2]), bc, bc
    return own[:4] if own and (level == 2 or _DIGIT.search(text)) else None


def is_meta(heading: str | None) -> bool:
    return heading is not None and heading.strip(" ").lower() in _META


def title_of(text: str) -> str:
    """short_title of first_sentence."""
    stop = _STOP.search(text) if "." in text else None
    part = stop[1] if stop and stop[1] else _CLAUSE.search(text)[1] if "," in text or ";" in text else text
    title = " ".join(_BLANKS.split(part)[:15]) if len(part) > 28 or "  " in part else part  # 15 words have 29 characters at least
    if len(title) <= 70:
        return title
    cut = _CUT.search(title)
    return cut[1] if cut else title[:70]


@remembered
def _confidence(match_type: str) -> str:
    kind = match_type.lower()
    return "fallback" if "fallback" in kind else "approximate" if any(x in kind for x in ("circa", "century", "decade", "years ago", "tilde")) else "explicit"


def food_confidence(match_type: str, doubtful: bool, inferred: bool) -> str:
    return "contentious" if doubtful else "inferred" if inferred else _confidence(match_type)


def is_doubtful(text: str) -> bool:
    low = text.lower()
    return ("contentious" in low or "disputed" in low) and _DOUBT.search(plain(text)) is not None
