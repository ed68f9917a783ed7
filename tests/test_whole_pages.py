"""Pages read whole by one task: no shuffle, and the same as the columns say."""

import random

from pyspark.sql import functions as F

from eraframe.functions import cells, scalars
from eraframe.sources import pages

DATES = ["44 BC", "c. 500 BCE", "AD 14", "27 BC – AD 14", "1914–18", "60–58 BC", "(1200 BC - 1100 BC)", "(Rome, c. 1450)", "(1450s–1460s AD)", "≈ 1200", "~900", "(≈ 900–800 BC)", "(1999-05)", "0", "99", "99999999999 BC", "1066²", "1066é", "Late 13th century BC", "mid 2nd–3rd century", "Before 17th century BC", "8th–7th centuries BCE", "early 17 00s", "1490s", "490s BC", "1,500 years ago", "2.5-2 million years ago", "9999 million years ago", "1.2.3 years ago", "(Between 753 and 716 BC)", "5001 BC−300", "present", "Ongoing"]
WORDS = ["15 March", "Sept. 3", "spring", "?", "May²", "émay", "Line", "disputed", "A vs. B", "x v y", "Orra; Velm", "a, b", "A versus B", "[1]", "[a]", "[edit]", "été.", "in", "around", "between", ",", "(", ")", ";", "year", "War 2[1]", "and then it was told at great length that nobody came back"]


def _said(rng):
    return " ".join("".join(rng.choice([rng.choice(DATES), rng.choice(WORDS)]) + rng.choice([" ", " ", "", ", ", " ("]) for _ in range(rng.choice([0, 1, 1, 2, 4]))).split())


def _pages(spark, html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def _is_read_in_place(rows):
    return "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_year_tables_are_read_in_place(spark):
    row = "<tr><td rowspan='2'>44 BC</td><td>15 March</td><td>One</td></tr><tr><td></td><td>Two</td></tr>"
    rows = pages.table_events(_pages(spark, [f"<table class='wikitable'>{row}</table>", None]))
    assert _is_read_in_place(rows) and [(r.description, r.date.start, r.date.start_day, r.confidence) for r in rows.orderBy("row").collect()] == [("One", -44, 15, "explicit"), ("Two", -44, None, "inferred")]


def test_cell_dates_as_columns(spark):
    rng = random.Random(1)
    texts = [(i, rng.choice([rng.choice(DATES), _said(rng)]), rng.choice([None, _said(rng), rng.choice(WORDS)])) for i in range(3000)]
    got = spark.createDataFrame(texts, "i int, y string, d string").select("i", cells.table_cell_date(F.col("y"), F.col("d")).alias("x")).collect()
    assert {r.i: r.x and tuple(r.x) for r in got} == {i: scalars.cell_date(y, d) for i, y, d in texts}


def test_year_tables_as_columns(spark):
    """Random tables with spans, nested and unclosed ones, on the grid that columns make."""
    rng = random.Random(2)
    cell = lambda: f"<t{rng.choice('dddh')}{rng.choice(['', '', ' rowspan=2', ' rowspan=0', ' colspan=3', ' rowspan=3 colspan=2'])}>{rng.choice([_said(rng), rng.choice(DATES)])}{rng.choice(['</td>', ''])}"
    html = ["".join(rng.choice(["<table class='wikitable x'>", "<table>", "</table>", "<nav>", "</nav>"] + ["<tr>"] * 5 + [cell()] * 12) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    grid = pages.table_grid(pages.page_blocks(_pages(spark, html)))
    rows = grid.groupBy("page_id", "tbl", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text", "from_row"))).alias("c"), F.bool_and("is_th").alias("head")).where("not head")
    want = {(r.page_id, r.tbl, r.row): ([x.text for x in r.c if x.col == 0], " ".join(x.text for x in r.c if x.col >= 2).strip(" "), len(r.c) < 2) for r in rows.collect()}
    got = {(r.page_id, r.tbl, r.row): ([] if r.year_text is None else [r.year_text], r.description, r.fault == "short") for r in pages.dated_tables(_pages(spark, html), "").collect()}
    assert len(want) > 300 and got == want


def test_batches_of_pages_as_page_by_page():
    """Pages alike and odd, long ones and none, in one batch and a part of it."""
    import pyarrow as pa

    rng = random.Random(5)
    tags = ["<td>", "</td>", "<tr>", "<li>", "<ul>", "</ul>", "<p>", "<h2>", "</h2>", "<b>", "<table class='x'>", "</table>", "<a href='/wiki/A'>", "<a href='/wiki/B'>", "<td rowspan=2>", "<!-- c -->", "<script>a<b</script>", "<nav>"]
    text = lambda: rng.choice(["", "a ", " b", "&amp;", "c > d", "é"])
    html = [None, "", "x", "<", *["".join(rng.choice(tags[: rng.choice([14, 18])]) + text() for _ in range(rng.randint(0, 9))) for _ in range(5000)], "<td>a" * 1500, "<p>" + "é" * 800_000, "<td>b</td>"]
    rows = lambda found: [[*r[:3], "".join(r[3]), *r[5:]] for r in found]  # noqa: E731  href apart
    read = [rows(r) for r in pages._read_pages(pa.array(html).slice(1))]
    assert read == [rows(pages._Blocks().read(h)) for h in html[1:]] and len(pages._orders) > 100


def test_wars_are_read_in_place(spark):
    html = "<table><tr><th>Year</th><th>Name</th></tr><tr><td>431–404 BC</td><td>Long War</td><td>A v B</td></tr></table>"
    rows = pages.war_events(_pages(spark, [html, None]))
    assert _is_read_in_place(rows) and [(r.title, r.start_year, r.end_year, r.weight, r.description) for r in rows.collect()] == [("Long War", 431, 404, 28 * 365, "Belligerents: A, B")]


def test_war_rows_as_columns(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.choice(DATES), rng.choice(DATES), _said(rng)]) for _ in range(rng.randint(0, 6))]) for i in range(3000)]
    got = cells.war_row(spark.createDataFrame(rows, "i int, cells array<string>")).collect()
    assert {r.i: r.war and tuple(r.war) for r in got} == {i: scalars.war_event(c) for i, c in rows}


SECTION = "<h2>4000–2000 BCE</h2><ul><li>Bread</li><li>Fish, around 1200 BCE, was dried</li></ul>"


def test_sections_are_read_in_place(spark):
    rows = pages.sectioned_events(_pages(spark, [SECTION, None]))
    assert _is_read_in_place(rows) and [(r.title, r.start_year, r.end_year, r.match_type) for r in rows.orderBy("seq").collect()] == [("Bread", 4000, 2000, "Section"), ("Fish", 1200, 1200, "Year with era")]


def test_sections_as_columns(spark):
    """Random pages give the events that columns make of their stored blocks."""
    rng = random.Random(4)
    said = lambda: rng.choice([_said(rng), rng.choice(DATES) + ": " + _said(rng), _said(rng) + " (" + rng.choice(DATES) + ")"])
    part = lambda: rng.choice([f"<h{rng.randint(1, 5)}>{rng.choice([rng.choice(DATES), 'References', _said(rng)])}</h2>", f"<ul><li>{said()}<li>{said()}</ul>", f"<table><tr><th>a<th>b</tr><tr><td>{rng.choice(DATES)}</td><td>{said()}</td></tr><tr><td>{said()}<td>{said()}<td>c</table>", "<nav>", "</nav>", "</h1></h3></h4>"])
    df = _pages(spark, ["".join(part() for _ in range(rng.randint(0, 9))) for _ in range(1000)])
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (pages.sectioned_events(df), pages.sectioned_events(df, blocks=pages.page_blocks(df))))
    assert len(want) > 1000 and got == want


def test_own_rules_hold_in_sections(spark):
    from eraframe.functions import spans

    before = spans.PROFILES["food_inline"]
    own = spans.rule(r"^Dynasty (\d+)", lambda g, page: spans.span(g(1), g(1), F.lit(False), F.lit(False), "Own", 10.0))
    try:
        spans.add_rule("own", own, "food_inline", first=True)
        assert [(r.start_year, r.match_type) for r in pages.sectioned_events(_pages(spark, ["<h2>x</h2><li>Dynasty 12 rose</li>"])).collect()] == [(12, "Own")]
    finally:
        spans.PROFILES["food_inline"] = before
        del spans.RULES["own"]
    assert not scalars.has_own_rules()
