import json

from pyspark.sql import functions as F

from eraframe.operators import events as ev
from eraframe.sources import artifacts, pages
from eraframe.streaming.enrichment import enrich_new, stored_categories


def _pages(spark, *html, url="u"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_war_events(spark):
    war = "<table><tr><th>Start</th><th>End</th><th>Name</th><th>Who</th></tr><tr><td>431 BC</td><td>404 BC</td><td>Long <a href='/wiki/L'>War</a>[1]</td><td>A vs. B</td><td>n1</td><td>n2</td></tr><tr><td>x</td><td>y</td><td>z</td></tr><tr><td>1914</td><td>1918</td></tr></table>"
    other = "<table><tr><th>Name</th><th>Place</th></tr><tr><td>1914</td><td>1918</td><td>W</td><td>A</td></tr></table>"
    rows = pages.war_events(_pages(spark, war, other, None, "", other + war)).orderBy("page_id").collect()
    assert [(r.page_id, r.tbl, r.row) for r in rows] == [(0, 1, 1), (4, 2, 1)]
    r = rows[0]
    assert (r.title, r.description, r.start_year, r.end_year, r.is_bc_start, r.is_bc_end, r.weight, r.category) == ("Long War", "Belligerents: A, B. n1 n2", 431, 404, True, True, 28 * 365, "War")


def test_curated_and_exclusions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"events": [{"title": "Good one", "start_year": 5, "end_year": 6}, {"title": "No", "start_year": 5, "end_year": 6, "_debug_extraction": "own"}, {"start_year": 1}]}))
    rows = artifacts.curated_events(spark, str(tmp_path / "c.json")).orderBy("index").collect()
    assert [r.error for r in rows] == [None, "title is too short", "title is required"] and rows[1]._debug_extraction == "own"
    assert json.loads(rows[0]._debug_extraction) == {"method": "curated_events", "source": "manual_curation", "file": "c.json", "index": 0}
    artifacts.write_exclusions(spark.createDataFrame([("empty", 2, ["a"])], "reason string, n long, samples array<string>"), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).first().asDict() == {"reason": "empty", "n": 2, "samples": ["a"]}


def test_category_audit(spark):
    cols = "event_key string, category_id int, title string, description string, category string, weight int"
    target = spark.createDataFrame([("a", 2, "t", "d", "c", 5), ("b", 2, "t", "d", "c", 6)], cols)
    new = spark.createDataFrame([("b", 0, "new", "d", "c", 9, 0), ("c", 0, "x", "d", "c", 9, 1)], cols + ", index int")
    row = ev.category_audit(ev.replace_category(target, new, 1, False), 1, "s", "20250101T000000Z", "2025", "me", False).first()
    assert (row.category_id, row.filename, row.events_count, row.events_updated, row.status) == (1, "s_20250101T000000Z.json", 2, 1, "completed")
    assert json.loads(row.metadata) == {"run_id": "20250101T000000Z", "generated_at_utc": "2025", "overwrite": False}


def test_enrichment_of_new_events(spark, tmp_path):
    def drop(name, *titles):
        events = [{"title": t, "description": "d", "start_year": 5, "end_year": 6} for t in titles]
        (tmp_path / "in" / name).write_text(json.dumps({"strategy": "s", "run_id": "20250101T000000Z", "event_count": len(events), "events": events}))

    asked = []

    def categorise(events):
        asked.append(sorted(r.title for r in events.collect()))
        return events.select("event_key", F.lit("Science").alias("category"), F.when(F.col("title") == "low", 0.1).otherwise(0.9).alias("confidence"))

    (tmp_path / "in").mkdir()
    where = [str(tmp_path / n) for n in ("in", "cp", "out")]
    drop("a.json", "one", "two", "two", "low")
    enrich_new(spark, *where, categorise, "m1")
    drop("b.json", "two", "three")
    enrich_new(spark, *where, categorise, "m1")
    rows = stored_categories(spark, where[2]).collect()
    assert asked[0] == ["low", "one", "two"] and asked[-1] == ["three"] and len(rows) == 3 and {r.llm_source for r in rows} == {"m1"} and {r.batch for r in rows} == {0, 1}


def test_plain_tags_are_read_as_the_parser_reads_them(spark):
    """Random pages, plain and odd, give the rows that HTMLParser alone gives; blocks hold the wanted columns alone."""
    import random

    from eraframe.sources import pages

    class Parser(pages._Blocks):
        def read(self, html):
            self.feed(html)
            self.close()
            return self.rows

    rng = random.Random(2)
    tags = "ul ol li li p a td th tr table h1 h2 h3 div nav footer title script style textarea TD".split()
    plain = [' class="x y"', ' rowspan="2"', " colspan='3'", ' href="/wiki/A&amp;b"', "", ""]
    odd = [" checked", " href=foo", ' a="b>c"', ' href = "z"', ' a="1"b="2"', "/", " /"]
    texts = ["text ", "a & b", "&amp;", "1 > 2", "<!-- c -->", "<style>p{}</style>", "<script>if (a<b) y</script>", "<!doctype html>"]
    strange = ["< 3", "&#65", "<b", "<!--><li>-->", "<!-- a -- b -->", "<?php x ?>", "<![CDATA[x]]>", "<>", "</>", "<script>a</b></script>", "<", "&"]
    for i in range(3000):
        few = i % 2
        html = "".join(rng.choice([f"<{rng.choice(tags)}{rng.choice(plain + odd * few)}>", f"</{rng.choice(tags)}>", rng.choice(texts + strange * few)]) for _ in range(rng.randint(0, 25)))
        assert pages._Blocks().read(html) == Parser().read(html), html
    html = "<p>a</p>" * 40
    df = spark.range(0, 600, 1, 1).selectExpr("id page_id", f"'{html}' html", "concat('u', id) url")
    blocks = pages.page_blocks(df, ("seq", "text"), ("p",), ("url",))
    assert blocks.columns == ["page_id", "seq", "text", "url"] and blocks.where("url = concat('u', page_id) and text = 'a'").count() == 600 * 40
