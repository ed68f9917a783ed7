import json
import random

from pyspark.sql import functions as F

from eraframe.operators import events as ev
from eraframe.operators import intervals as iv
from eraframe.operators.lanes import pack_lanes
from eraframe.sources import artifacts, pages
from eraframe.streaming import authlog


def test_range_join_and_bins_equal_brute_force(spark):
    rng = random.Random(1)
    events = [(i, a := rng.uniform(-50, 50), a + rng.choice([0, rng.uniform(0, 3), rng.uniform(0, 40)]), 1) for i in range(300)]
    views = [(i, a := rng.uniform(-50, 50), a + rng.uniform(0, 8)) for i in range(60)]
    e = spark.createDataFrame(events, "id long, frac_start double, frac_end double, weight int")
    v = spark.createDataFrame(views, "viewport_id long, v_low double, v_high double")
    got = sorted((r.id, r.viewport_id) for r in iv.range_join(e, v, 5.0).collect())
    assert got == sorted((x[0], y[0]) for x in events for y in views if x[1] <= y[2] and x[2] >= y[1])
    got = sorted((r.id, r.bin_num) for r in iv.explode_bins(e, -10.0, 2.0, 5).collect())
    assert got == sorted((x[0], k) for x in events for k in range(5) if x[1] <= -10 + 2 * k + 2 and x[2] >= -10 + 2 * k)


def test_range_totals_and_whole_tables(spark):
    from eraframe.plans import catalog

    rng = random.Random(2)
    events = [(i, a := rng.uniform(-50, 50), a + rng.uniform(0, 9), i % 5) for i in range(200)]
    views = [(i, float(i % 7) * 5 - 20, float(i % 7) * 5 - 18) for i in range(90)] + [(90, 900.0, 901.0)]
    e = spark.createDataFrame(events, "id long, frac_start double, frac_end double, weight int")
    v = spark.createDataFrame(views, "viewport_id long, v_low double, v_high double")
    got = {r.viewport_id: (r.n, r.w) for r in iv.range_totals(e, v, 5.0, [F.count("*").alias("n"), F.sum("weight").alias("w")]).collect()}
    want = {y[0]: [x[3] for x in events if x[1] <= y[2] and x[2] >= y[1]] for y in views}
    assert got == {k: (len(w), sum(w)) for k, w in want.items() if w}
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["range_join_customers"](spark, sf).count() > 28
    seen = iv.explode_bins(catalog.positioned(spark, sf), 1992.0, 0.5, 14).select("id").distinct().count()
    lanes = catalog.QUERIES["lane_layouts"](spark, sf)
    owners = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert lanes.count() == seen and owners * 0.9 < lanes.select("layout_id").distinct().count() <= owners


def test_lanes(spark):
    rows = [(1, 1, 7, 5, 0.0, 2.0, None), (1, 2, 7, 9, 1.0, 3.0, None), (1, 3, 6, 1, 1.5, 1.8, None), (1, 4, 0, 1, 5.0, 6.0, 1), (2, 5, 7, 1, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "layout_id long, id long, bin_num int, weight int, x_start double, x_end double, cached_lane int")
    assert {r.id: r.lane for r in pack_lanes(df, 2).collect()} == {2: 0, 1: 1, 3: None, 4: 1, 5: 0}


def test_rowspan_and_sections(spark):
    cells = spark.createDataFrame([(1, 1, 0, "44 BC", 2), (1, 1, 1, None, None), (1, 1, 2, None, None), (1, 1, 3, "31 BC", 1)], "page_id long, `table` int, row int, year_cell string, rowspan int")
    assert [r.year_filled for r in ev.rowspan_fill(cells).orderBy("row").collect()] == ["44 BC", "44 BC", None, "31 BC"]
    heads = spark.createDataFrame([(1, 1, 2, "A"), (1, 2, 3, None), (1, 3, 4, None), (1, 4, 3, "C"), (1, 5, 4, None), (1, 6, 2, None), (1, 7, 3, None)], "page_id long, seq int, level int, span string")
    assert [r.section_span for r in ev.section_inherit(heads).orderBy("seq").collect()] == ["A", "A", "A", "C", "C", None, None]


def test_replace_category(spark):
    cols = "event_key string, category_id int, title string, description string, category string, weight int"
    target = spark.createDataFrame([("a", 1, "t", "d", "c", 5), ("b", 2, "t", "d", "c", 6)], cols)
    new = spark.createDataFrame([("b", 0, "new", "d", "c", 9, 0), ("c", 0, "x", "d", "c", 9, 1), ("c", 0, "y", "d", "c", 9, 2)], cols + ", index int")
    got = {r.event_key: (r.category_id, r.title, r.weight, r.action) for r in ev.replace_category(target, new, 1, True).collect()}
    assert got == {"b": (1, "new", 6, "updated"), "c": (1, "x", 9, "inserted")}


def test_pages(spark):
    html = """<html><head><title>44 BC</title></head><body><nav><ul><li><a href="/wiki/1">1</a></li></ul></nav><h1>44 BC</h1><h2>Events</h2><h3>March</h3>
    <ul><li>March 15 – Caesar is killed.</li><li>v</li><li>Outer <ul><li>April 2 – inner thing</li></ul></li></ul><h3>Rome</h3><ul><li>A law is passed</li></ul><h2>Births</h2><ul><li>Someone</li></ul>
    <a href="/wiki/45_BC">45</a><a href="/wiki/AD_5">5</a><table><tr><th>Year</th><th>Event</th></tr><tr><td rowspan="2">44 BC</td><td>x</td></tr><tr><td>y</td></tr></table></body></html>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    blocks = pages.page_blocks(df).cache()
    assert {(r.href, r.year, r.is_bc) for r in pages.discover_year_links(blocks).collect()} == {("/wiki/1", 1, False), ("/wiki/45_BC", 45, True), ("/wiki/AD_5", 5, False)}
    got = {r.title: (r.span.start_year, r.span.start_year_is_bc, r.span.start_month, r.category) for r in pages.year_page_events(df).collect()}
    assert got["Caesar is killed."] == (44, True, 3, None) and got["inner thing"][2] == 4 and got["A law is passed"] == (44, True, 1, "Rome")
    assert "Someone" not in got and "v" not in got
    assert sorted(r.cells for r in pages.table_rows(blocks).collect()) == [["44 BC", "x"], ["y"]]


def test_artifacts(spark, tmp_path):
    good = {"strategy": "s", "run_id": "20240101T000000Z", "event_count": 1, "events": [{"title": "T", "start_year": 1, "end_year": 2, "is_bc_start": True, "_debug_extraction": {"m": 1}}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"strategy": "s", "events": []}))
    rows = {r.file: r for r in artifacts.read_artifacts(spark, str(tmp_path / "*.json")).collect()}
    assert rows["a.json"].title == "T" and rows["a.json"]["index"] == 0 and rows["b.json"].file_error == "run_id is missing"
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.json").write_text(json.dumps([{"title": "U"}]))
    (tmp_path / "c/y.json").write_text(json.dumps({"events": [{"title": "V"}]}))
    assert {r.title for r in artifacts.read_curated(spark, str(tmp_path / "c/*.json")).collect()} == {"U", "V"}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 1.7e9 + 10.0 * i) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, key long, s double").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    batch = {r.event_id: r.allowed for r in authlog.rate_limit(log, 1, 60.0).collect()}
    stream = authlog.rate_limit_stream(authlog.log_stream(spark, str(tmp_path / "log"), "event_id long, key long, ts timestamp"), 1, 60.0)
    w = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == batch
    assert batch[0] and not batch[3] and batch[6]


def test_registered_queries_agree_with_sql(spark):
    import duckdb

    from eraframe.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("events_by_bins", "events_viewport", "category_facets", "sessions", "span_bc_ranges"):
        assert catalog.QUERIES[name](spark, d).count() == len(con.execute(catalog.ORACLE_SQL[name]).fetchall()) > 0


def test_lanes_over_batches(spark):
    """Layouts that lie across Arrow batches, long ones and odd bounds are packed as a scan of all taken intervals packs them."""
    import random

    from eraframe.operators.lanes import BIN_ORDER

    rng = random.Random(4)
    cols = "layout_id long, id long, bin_num int, weight int, x_start double, x_end double, cached_lane int"
    rows = []
    for i in range(1500):
        a = rng.choice([None, *[float(x) for x in range(60)]]) if i % 9 == 0 else float(rng.randint(0, 60))
        b = None if a is None else a + rng.choice([0.0, 0.0, 1.0, 3.0, -1.0])
        rows.append((None if i % 50 == 0 else rng.choice([1, 1, 1, 2, i]), i, rng.choice([None, 0, 7, 8, 14, 15]), rng.choice([None, 1, 5]), a, b, rng.choice([None, 0, 2, 9, -1])))
    want = {}
    nan = float("nan")
    for layout in {r[0] for r in rows}:
        taken = [[] for _ in range(3)]
        key = lambda r: (BIN_ORDER.get(r[2], 15), -(r[3] or 0), r[4] is None, r[4] or 0, r[5] is None, r[5] or 0, r[1])
        for r in sorted((r for r in rows if r[0] == layout), key=key):
            a, b = (nan if x is None else x for x in r[4:6])
            first = [r[6]] if r[6] is not None and 0 <= r[6] < 3 else []
            lane = next((k for k in [*first, *range(3)] if all(b <= x or a >= y for x, y in taken[k])), None)
            if lane is not None:
                taken[lane].append((a, b))
            want[r[1]] = lane
    few = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(few)
    spark.conf.set(few, 7)
    packed = pack_lanes(spark.createDataFrame(rows, cols), 3)
    assert {r.id: r.lane for r in packed.collect()} == want
    spark.conf.set(few, was)
    assert "FlatMapGroupsInPandas" not in packed._jdf.queryExecution().toString()
