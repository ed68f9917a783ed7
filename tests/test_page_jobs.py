"""Page jobs on small pages: nested periods, chronologies, sections, tables with spans."""

import pytest
from pyspark.sql import functions as F

from eraframe.functions import candidates
from eraframe.sources import pages


def _pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


PERIODS = """<h2>African periods[edit]</h2><div><h3>Nile</h3><div><ul><li>Reed Time (3100 BC – 2700 BC)</li>
<li><b>Kingdoms</b><ul><li><a href="/wiki/Old_One">Old One</a> (2600 BC – 2100 BC)</li><li>Shores<ul><li>Last Shore[3] (1900–present)</li></ul></li>
<li>Middle (2000 BC – 1700 BC)<ul><li>Part of it (1800 BC – 1750 BC)</li></ul></li></ul></li><li>Undated thing</li></ul></div>
<h3>Coast</h3><ul><li>Shell Period (900 BC – 700 BC)</li></ul></div><h2>Other things</h2><ul><li>Not a period (500–600)</li></ul><nav><ul><li>Menu (1000–1100)</li></ul></nav>"""


def test_nested_periods(spark):
    df = pages.period_events(_pages(spark, ("u", PERIODS), ("v", None), ("w", ""), ("x", "<ul><li>No heading (500–600)</li></ul>")))
    rows = {r.title: r for r in df.collect()}
    assert set(rows) == {"Reed Time", "Kingdoms - Old One", "Kingdoms - Shores - Last Shore", "Kingdoms - Middle", "Kingdoms - Part of it", "Shell Period"}
    assert rows["Reed Time"].category == "African periods" and rows["Kingdoms - Old One"].category == "Kingdoms"
    one = rows["Kingdoms - Old One"]
    assert (one.span.start_year, one.span.end_year, one.span.start_year_is_bc, one.span.end_year_is_bc, one.url, one.description) == (2600, 2100, True, True, "/wiki/Old_One", "Old One (from Kingdoms)")
    last = rows["Kingdoms - Shores - Last Shore"]
    assert (last.span.start_year, last.span.end_year, last.debug.headers) == (1900, pages.PRESENT, ["Kingdoms", "Shores"])


def test_sections_by_name_and_level(spark):
    html = "<h2>A</h2><h3>Wanted</h3><ul><li>In (501–600)</li></ul><h4>Deeper</h4><ul><li>Too (601–700)</li></ul><h3>Next</h3><ul><li>Out (701–800)</li></ul>"
    assert {r.title for r in pages.period_events(_pages(spark, ("u", html)), ["Wanted"]).collect()} == {"In", "Too"}


CENTURY = """<h1>A century</h1><h2>Years</h2><h3>1807</h3><ul><li>A bridge was built, it was long</li><li>Short</li></ul><ul><li>Of a second list, left out</li></ul>
<h3>1810s</h3><ul><li>No single year stands here</li></ul><h3>1811</h3><p>none</p><h2>See also</h2><h3>1812</h3><ul><li>Beyond the end of the page</li></ul>"""
NESTED = "<h1>B</h1><ul><li>1901 in general<ul><li>A thing that happened</li><li>tiny</li></ul></li><li>1902 – Another thing. More of it</li><li>An undated happening in town</li></ul>"
MAIN = "<h1>C</h1><p>x</p><h2>Early</h2><ul><li>1234 – Something was said. More</li><li>Nothing dated was said here</li></ul><h2>References</h2><ul><li>1500 – A book about it</li></ul><h3>See also</h3><ul><li>1600 – Over and done</li></ul>"
ARTICLE = "<h1>D</h1><ul><li>300 BC – Long ago it was</li><li>Main article: Other</li></ul>"


def test_chronologies(spark):
    df = pages.chronology_events(_pages(spark, ("/wiki/19th_century_things", CENTURY), ("/wiki/20th_century_things", NESTED), ("/wiki/Chronicle_of_the_history", MAIN), ("/wiki/D", ARTICLE), ("/wiki/E", None)))
    found = sorted((r.page_id, r.page_kind, r.kind, r.title, r.start_year, r.end_year, r.is_bc_start) for r in df.collect())
    assert found == [
        (0, "century", "dated", "1807 – A bridge was built", 1807, 1807, False),
        (1, "century", "dated", "1901 – A thing that happened", 1901, 1901, False),
        (1, "century", "dated", "1902 – Another thing.", 1902, 1902, False),
        (1, "century", "undated", "An undated happening in town", 1901, 2000, False),
        (2, "main", "dated", "1234 – Something was said.", 1234, 1234, False),
        (3, "article", "dated", "300 BC – Long ago it was", 300, 300, True),
    ]


SECTIONS = """<h2>4000–2000 BCE</h2><ul><li>Bread without a date</li><li>1500 BCE: Salt was mined</li><li>Fish, which was disputed, around 1200 BCE, was dried</li></ul>
<h3>Sweet things</h3><ul><li>Honey</li></ul><h2>Without date</h2><ul><li>Nothing known</li></ul>
<h2>19th century</h2><table><tr><th>Year</th><th>What</th></tr><tr><td>1802</td><td>Tins[2] were sealed. Then more</td></tr><tr><td>soon</td><td>1820: Ice was sold</td></tr><tr><td>later</td><td>Undated jam</td></tr><tr><td>1900</td></tr></table>
<h2>References</h2><ul><li>1950 A book</li></ul>"""


def test_sections_and_two_column_tables(spark):
    df = pages.sectioned_events(_pages(spark, ("u", SECTIONS), ("v", None)))
    found = [(r.title, r.start_year, r.end_year, r.is_bc_start, r.confidence, r.source) for r in df.orderBy("seq").collect()]
    assert found == [
        ("Bread without a date", 4000, 2000, True, "inferred", "bullet"),
        ("1500 BCE: Salt was mined", 1500, 1500, True, "explicit", "bullet"),
        ("Fish", 1200, 1200, True, "contentious", "bullet"),
        ("Honey", 4000, 2000, True, "inferred", "bullet"),
        ("Tins were sealed", 1802, 1802, False, "explicit", "table"),
        ("1820: Ice was sold", 1820, 1820, False, "explicit", "table"),
        ("Undated jam", 1801, 1900, False, "inferred", "table"),
    ]


TABLE = """<table class="wikitable sortable"><tr><th>Year</th><th>Date</th><th>Event</th></tr>
<tr><td rowspan="3">44 BC</td><td>15 March</td><td>One <i>fell</i></td></tr><tr><td>April</td><td>Two</td></tr><tr><td></td><td></td></tr>
<tr><td>c. 14</td><td colspan="2">19 August</td></tr><tr><td>alone</td></tr><tr><td>none</td><td>x</td><td>Text</td></tr><tr><td rowspan="99">69</td><td>y</td><td>Four</td><td>more</td></tr><tr><td>z</td><td>Five</td></tr></table>
<table class="other"><tr><td>70</td><td></td><td>Elsewhere</td></tr></table>"""


def test_year_tables(spark):
    found = pages.dated_tables(_pages(spark, ("u", TABLE), ("v", None))).orderBy("row").collect()
    assert [(r.row, r.date and r.date.start, r.date and r.date.start_month, r.description, r.confidence, r.fault) for r in found] == [
        (1, -44, 3, "One fell", "explicit", None), (2, -44, 4, "Two", "inferred", None), (3, -44, None, "", "inferred", "no text"),
        (4, 14, 8, "19 August", "approximate", None), (5, None, None, "", None, "short"), (6, None, None, "Text", None, "no date"), (7, 69, None, "Four more", "explicit", None), (8, 69, None, "Five", "inferred", None),
    ]
    counts = pages.table_counts(pages.dated_tables(_pages(spark, ("u", TABLE)))).first().asDict()
    assert counts == {"page_id": 0, "tables": 1, "rows": 8, "events": 5, "n_short": 1, "n_no_date": 1, "n_no_text": 1}
    assert pages.table_events(_pages(spark, ("u", TABLE)), "").where("tbl = 2").count() == 1


def test_grid_of_spans(spark):
    html = "<table><tr><td rowspan='2' colspan='2'>a</td><td>b</td></tr><tr><td rowspan='0'>c</td><td>d<table><tr><td>in</td></tr></table></td></tr><tr><td>e</td><td>f</td></tr></table><td>stray</td>"
    grid = {(r.tbl, r.row, r.col): r.text for r in pages.table_grid(pages.page_blocks(_pages(spark, ("u", html)))).collect()}
    assert {k: v for k, v in grid.items() if k[0] == 1} == {(1, 0, 0): "a", (1, 0, 1): "a", (1, 1, 0): "a", (1, 1, 1): "a", (1, 0, 2): "b", (1, 1, 2): "c", (1, 2, 2): "c", (1, 1, 3): "d", (1, 2, 0): "e", (1, 2, 1): "f"}
    assert grid[2, 0, 0] == "in"


@pytest.mark.parametrize("job", ["period_events", "chronology_events", "sectioned_events", "year_page_events", "table_events"])
def test_plans_stay_small(spark, job):
    """Filters on spans must not copy the rules into themselves."""
    rows = getattr(pages, job)(_pages(spark, ("u", ""))).where("page_id > 0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000 and rows.count() == 0


def test_own_words_of_no_events(spark):
    df = spark.createDataFrame([("A register of old houses, 1900",)], "t string").withColumn("a", F.lit("")).withColumn("c", F.lit("19th"))
    kind = lambda *w: candidates.candidate_kinds(df, "t", "a", "c", *w).first().candidate
    assert kind().kind == "undated" and kind(("register of",)) is None


def test_links(spark):
    html = "<p>Main article: <a href='/wiki/One'>One</a></p><p><a href='/wiki/Two'>Two</a></p><li><a href='https://h.example/wiki/Wars'>List of wars: old</a><a href='https://o.example/wiki/W'>List of wars: other</a><a href='/wiki/Help:X'>List of wars: help</a></li><p>Main articles: <a href='//o.example/x'>Far</a></p>"
    df = _pages(spark, ("https://h.example/wiki/Start", html), ("https://h.example/wiki/One#a", "1"), ("https://h.example/wiki/Wars", "2"), ("https://h.example/wiki/Two", "3"))
    found = pages.discover_period_links(pages.page_blocks(df), "h.example")
    assert {r.href for r in found.collect()} == {"/wiki/One", "https://h.example/wiki/Wars"}
    assert {(r.html, r.found_on) for r in pages.follow_links(found, df, "h.example").collect()} == {("1", 0), ("2", 0)}
    years = "".join(f"<a href='/wiki/{x}'>y</a>" for x in ("100_BC", "200_BC", "AD_5", "44", "44", "000", "1999", "Year"))
    rows = pages.discover_year_links(pages.page_blocks(_pages(spark, ("u", years))), "150 BC", "44").collect()
    assert sorted((r.year, r.is_bc) for r in rows) == [(5, False), (44, False), (100, True)]


def test_debug_of_an_event_as_text(spark):
    from eraframe.functions.text import normalise_event

    df = spark.createDataFrame([(" T ", None, None, 200.0, ("m", 1), "said"), ("x", "d", "c", 5.0, None, None)], "title string, description string, category string, precision double, debug struct<method:string,n:int>, own string")
    row = {c: F.col(c) for c in ("title", "description", "category", "precision")}
    got = df.select(*[c.alias(n) for n, c in normalise_event(row, F.col("debug")).items()]).collect()
    assert got[0]._debug_extraction == '{"method":"m","n":1}' and got[1]._debug_extraction is None and (got[0].title, got[0].category, got[0].precision) == ("T", "Uncategorized", 100.0)
    assert [r[0] for r in df.select(normalise_event(row, F.col("own"))["_debug_extraction"]).collect()] == ["said", None]
