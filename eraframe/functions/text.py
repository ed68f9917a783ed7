"""Columns over titles, links, labels, keys and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, at either end.
EDGES = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def event_key(title: Column, start: Column, end: Column, description: Column) -> Column:
    """SHA-256 of title|start|end|description, stripped; missing years are 0; null for an empty title."""
    name = strip(title)
    body = F.concat_ws("|", name, F.coalesce(start, F.lit(0)).cast("string"), F.coalesce(end, F.lit(0)).cast("string"), F.coalesce(strip(description), F.lit("")))
    return F.when(name != "", F.sha2(body, 256))


def is_event_key(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def food_event_key(date: Column, title: Column, source: Column) -> Column:
    return F.md5(F.concat_ws("|", date, title, source))


def hash_ip(ip: Column, salt: str) -> Column:
    return F.sha2(F.concat(ip, F.lit(salt)), 256)


def normalise_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "[‐-―−]", "-")


def collapse_dashes(text: Column) -> Column:
    """One dash without white space around it."""
    return F.regexp_replace(normalise_dashes(text), r"(?U)\s*-+\s*", "-")


def is_circa_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)(?:\bc\.|\bca\.|\bcirca\b|~|≈)"), F.lit(False))


def trim_leading_date(text: Column) -> Column:
    """A title without the date in front of it: months with days and years, eras, circa, ranges, plain years and decades,
    then marks. A number of up to four digits that begins the title also goes."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    era, dash = r"(?:\s*(?:BCE?|AD|CE)\b\.?)?", r"\s*[-–—]\s*"
    day = rf"{month}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{1,4}}\b{era})?"
    year = rf"(?:c(?:a|irca)?\.?\s*|AD\s+)?\d{{1,4}}s?\b{era}"
    for pattern in (rf"{day}(?:{dash}(?:{day}|\d{{1,2}}\b))?", rf"\d{{1,2}}\s+{month}\b(?:\s+\d{{1,4}}\b{era})?", rf"{month}\b", rf"{year}(?:(?:{dash}|\s+to\s+){year})?"):
        text = F.regexp_replace(text, rf"(?iU)^\s*\(?{pattern}\)?", "")
        text = F.regexp_replace(text, r"(?U)^[\s:;,.\-–—]+", "")
    return text


def normalise_title(title: Column) -> Column:
    return F.lower(strip(F.regexp_replace(title, r"(?U)\s+", " ")))


def short_title(title: Column) -> Column:
    """At most 70 characters, cut at the last space after the first 50 where there is one."""
    cut = F.regexp_extract(title, r"(?s)^(.{50,70})(?=\s)", 1)
    return F.when(F.length(title) <= 70, title).when(cut != "", cut).otherwise(F.substring(title, 1, 70))


def first_sentence(text: Column, words: int = 15) -> Column:
    """Up to the first period; without one, up to the first comma or semicolon; at most so many words."""
    clean = strip(text)
    stop = F.regexp_extract(clean, r"(?s)^(.*?)\.(?:\s|$)", 1)
    part = F.when(stop != "", stop).otherwise(F.regexp_extract(clean, r"(?s)^([^,;]*)", 1))
    return F.array_join(F.slice(F.split(part, r"\s+"), 1, words), " ")


def label(text: Column, most: int = 30) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def strip_citations(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\[(?:\d+|[a-z]|note \d+|citation needed)\]", ""))


def citation_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))


def wiki_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"href=\"/wiki/([^\"#:]+)\""), 1)


def split_belligerents(text: Column) -> Column:
    """Parts by the first separator that splits the text: vs, v, versus, semicolon, comma."""
    out = F.array(strip(text))
    for sep in (",", ";", r"(?i)\s+versus\s+", r"(?i)\s+v\.?\s+", r"(?i)\s+vs\.?\s+"):
        parts = F.split(text, sep)
        out = F.when(F.size(parts) > 1, parts).otherwise(out)
    return F.filter(F.transform(out, strip), lambda x: x != "")


def canonical_url(url: Column) -> Column:
    return F.split(url, "#").getItem(0)


def title_from_url(url: Column) -> Column:
    """The page name of a /wiki/ path, percent-decoded, underscores as spaces; plus signs stay."""
    path = F.regexp_extract(url, r"/wiki/([^?#]+)", 1)
    return F.when(path != "", F.regexp_replace(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), "_", " "))


def _first(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The value of the first row one of whose words, parted by |, is in the text."""
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in words.split("|")]), lambda w: F.contains(text, w)), F.lit(value)) for words, value in table]
    return F.coalesce(*hits, F.lit(default))


# Words of semantic classes and their colours, in the order in which they are tried, and the colour of none.
SEMANTIC = [
    ("war|battle|conflict|invasion|revolt|rebellion", "#fa709a"),
    ("peace|treaty|diplomacy|alliance|negotiation|accord", "#4facfe"),
    ("science|technology|invention|discovery|research|innovation", "#43e97b"),
    ("politics|government|election|revolution|policy|administration", "#ffa751"),
    ("religion|culture|art|literature|music|philosophy|tradition", "#f093fb"),
    ("economy|trade|commerce|finance|business|industry|market", "#fee140"),
    ("exploration|geography|travel|colony|discovery|expedition|migration", "#00f2fe"),
    ("military|army|navy|defense|strategy|tactics", "#764ba2"),
    ("education|school|university|learning|teaching|academy", "#38f9d7"),
]
SEMANTIC_DEFAULT = "#667eea"

# Words of labels and the standard category that they stand for, in the order in which they are tried.
CLOSEST = [
    ("military", "War & Conflict"), ("warfare", "War & Conflict"), ("battle", "War & Conflict"), ("government", "Politics"), ("political", "Politics"),
    ("science", "Science & Technology"), ("technology", "Science & Technology"), ("invention", "Science & Technology"), ("art", "Arts & Culture"), ("culture", "Arts & Culture"),
    ("music", "Arts & Culture"), ("literature", "Arts & Culture"), ("religious", "Religion"), ("church", "Religion"), ("economy", "Economics & Trade"),
    ("economic", "Economics & Trade"), ("trade", "Economics & Trade"), ("disaster", "Natural Disasters"), ("earthquake", "Natural Disasters"), ("flood", "Natural Disasters"),
    ("exploration", "Exploration & Discovery"), ("discovery", "Exploration & Discovery"), ("social", "Social Movements"), ("movement", "Social Movements"),
]
STANDARD = ["Politics", "War & Conflict", "Science & Technology", "Arts & Culture", "Religion", "Economics & Trade", "Natural Disasters", "Exploration & Discovery", "Social Movements", "Crime & Punishment", "Sports", "Other"]


def semantic_category(category: Column) -> Column:
    """The colour of a category's semantic class, by the words in it."""
    return _first(F.lower(category), SEMANTIC, SEMANTIC_DEFAULT)


def closest_category(name: Column, standard: list[str] | None = None) -> Column:
    """A name that is a standard category (a caller may have more of them), or the one that its words stand for, else Other."""
    return F.when(name.isin(standard or STANDARD), name).otherwise(_first(F.lower(name), CLOSEST, "Other"))


# Signs of command-line clients, bots and browsers in user agents, in the order in which they are tried.
CLI = ["curl", "wget", "httpie", "python-requests", "python-urllib", "postman", "insomnia"]
BOTS = ["bot", "crawler", "spider", "scraper", "slurp"]
BROWSERS = [
    (r"mozilla/5\.0.*edg/[\d.]+", "Edge"),
    (r"mozilla/5\.0.*(opr|opera)/[\d.]+", "Opera"),
    (r"mozilla/5\.0.*chrome/[\d.]+", "Chrome"),
    (r"mozilla/5\.0.*firefox/[\d.]+", "Firefox"),
    (r"mozilla/5\.0.*safari/[\d.]+", "Safari"),
]


def client_class(user_agent: Column) -> Column:
    """struct<client_type, browser, confidence, detail>: command-line clients first, then bots, then browsers; other
    agents that name Mozilla are browsers of half the confidence, and an empty agent is unknown."""
    ua = F.lower(F.coalesce(user_agent, F.lit("")))
    none = F.lit(None).cast("string")

    def made(kind: str, browser: Column, sure: float, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("client_type"), browser.alias("browser"), F.lit(sure).alias("confidence"), detail.alias("detail"))

    def named(words: list[str]) -> Column:
        """The first of the words in the agent, as the agent writes it."""
        return F.coalesce(*[F.when(ua.contains(w), F.substring(user_agent, F.locate(w, ua), F.lit(len(w)))) for w in words])

    cli, bot, browser = named(CLI), named(BOTS), F.coalesce(*[F.when(ua.rlike(sign), F.lit(name)) for sign, name in BROWSERS])
    return (
        F.when(ua == "", made("unknown", none, 0.0, F.lit("No user-agent provided")))
        .when(cli.isNotNull(), made("cli", none, 0.95, F.concat(F.lit("CLI tool: "), cli)))
        .when(bot.isNotNull(), made("bot", none, 0.95, F.concat(F.lit("Bot/crawler: "), bot)))
        .when(browser.isNotNull(), made("browser", browser, 0.9, F.concat(F.lit("Browser: "), browser)))
        .when(ua.contains("mozilla"), made("browser", F.lit("Unknown Browser"), 0.5, F.lit("Unknown Mozilla-based client")))
        .otherwise(made("unknown", none, 0.3, F.lit("Unknown user-agent")))
    )


def exclude_item(text: Column, in_navigation: Column | None = None) -> Column:
    """The reason why a list item is left out, null if it stays."""
    t = strip(F.coalesce(text, F.lit("")))
    out = F.when(t == "", "empty").when(F.length(t) < 3, "too_short").when(t.rlike("(?i)^Category:"), "category")
    return out if in_navigation is None else out.when(in_navigation, "navigation")


def is_war_table(headers: Column) -> Column:
    return F.exists(headers, lambda h: F.lower(h).rlike(r"\b(?:year|date|start|began|from)\b"))


# Headings of sections without events.
META = ["see also", "references", "notes", "external links", "further reading", "bibliography", "sources", "citations", "footnotes", "contents"]


def is_meta_section(heading: Column) -> Column:
    return F.lower(strip(heading)).isin(META)


def is_dated_section(heading: Column) -> Column:
    return F.coalesce(heading.rlike(r"(?i)\d{1,4}|century|centuries|decade|prehistor|ancient|medieval|modern|before|years ago"), F.lit(False)) & ~is_meta_section(heading)


def normalise_event(row: dict[str, Column], debug: Column | None = None) -> dict[str, Column]:
    """Columns of an event with defaults, lengths and ranges in order: title stripped, at most 500 characters, the title for
    a missing description, Uncategorized for a missing category, precision at most 100. debug, any struct, array, map or
    text, becomes _debug_extraction, as JSON unless it is text already; null stays null."""
    out = row | {
        "title": F.substring(strip(row["title"]), 1, 500), "description": F.coalesce(row["description"], row["title"]), "category": F.coalesce(row["category"], F.lit("Uncategorized")),
        "precision": F.least(row["precision"].cast("double"), F.lit(100.0)),
    }
    if debug is not None:
        # a text is written by to_json as one with quotes, so it is told by being a field of a struct
        whole = F.to_json(F.struct(debug.alias("d")))
        text = F.get_json_object(whole, "$.d")
        out["_debug_extraction"] = F.when(debug.isNotNull(), text)
    return out


def validate_event(title: Column, start_year: Column, end_year: Column, start_month: Column, start_day: Column, end_month: Column, end_day: Column, weight: Column) -> Column:
    """The first fault of an event as text, null if there is none."""
    out = lambda c, top: c.isNotNull() & ~c.between(1, top)
    return (
        F.when(title.isNull() | (strip(title) == ""), "title is required").when(F.length(strip(title)) < 3, "title is too short").when(start_year.isNull(), "start_year is required").when(end_year.isNull(), "end_year is required")
        .when((start_year == 0) | (end_year == 0), "year 0").when(out(start_month, 12) | out(end_month, 12), "month out of range").when(out(start_day, 31) | out(end_day, 31), "day out of range").when(weight < 0, "weight is negative")
    )
