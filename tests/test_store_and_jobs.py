"""Versions of stored tables, batches merged once, artifacts against their schema, source jobs and extractors by name."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from eraframe.operators import events as ev
from eraframe.sources import artifacts, jobs, store
from eraframe.streaming import authlog

URLS = "url string, v int"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, URLS)
    assert store.read_table(spark, path, URLS).count() == 0
    with pytest.raises(ValueError):
        store.read_table(spark, path)
    assert store.replace_table(df(("a", 1)), path) == 1
    held = store.read_table(spark, path)

    @F.udf("int")
    def fails(v):
        raise RuntimeError("no")

    with pytest.raises(PythonException):
        store.replace_table(df(("b", 2)).withColumn("v", fails("v")), path)
    assert [tuple(r) for r in store.read_table(spark, path).collect()] == [("a", 1)]
    assert store.replace_table(held.unionByName(df(("c", 3))), path) == 2 and held.count() == 1  # readers of the one before go on
    assert store.replace_table(df(("d", 4)), path) == 3 and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version=2", "version=3"]


def test_batches_are_merged_once(spark, tmp_path):
    load = store.upsert_batch(str(tmp_path / "t"), URLS)
    df = lambda *rows: spark.createDataFrame(rows, URLS)
    for batch, rows in ((0, [("a", 1), (None, 7)]), (0, [("a", 1), (None, 7)]), (1, [("a", 2), ("b", 3)]), (1, [("a", 2), ("b", 3)]), (0, [("z", 1)])):
        load(df(*rows), batch)
    assert sorted((r.url or "", r.v) for r in store.read_table(spark, str(tmp_path / "t")).collect()) == [("", 7), ("a", 2), ("b", 3)]


def test_stream_into_versions(spark, tmp_path):
    schema = "strategy string, title string, url string"
    load = store.upsert_batch(str(tmp_path / "t"), schema)
    (tmp_path / "in").mkdir()
    for name, title in (("a.json", "one"), ("b.json", "two")):
        (tmp_path / "in" / name).write_text(json.dumps({"strategy": "s", "run_id": "20250101T000000Z", "event_count": 1, "events": [{"title": title, "url": "u"}]}))
        artifacts.load_stream(spark, str(tmp_path / "in"), str(tmp_path / "cp"), load)
    assert [r.title for r in store.read_table(spark, str(tmp_path / "t")).collect()] == ["two"]


def _artifact(**change):
    event = {"title": "Event", "start_year": 5, "end_year": 6, "is_bc_start": False, "is_bc_end": False, "precision": 1, "weight": 3, "url": "u", "span_match_notes": "n", "description": "d", "category": "c"}
    meta = {"total_events_found": 1, "total_events_parsed": 1, "sections_identified": 0, "parsing_start_utc": "2025-01-01T00:00:00Z", "parsing_end_utc": "2025-01-01T00:00:09Z", "elapsed_seconds": 9, "events_per_second": 0.1}
    meta |= {"confidence_distribution": dict.fromkeys(artifacts.CONFIDENCES, 0), "undated_events": {"total_undated": 0, "events": []}}
    return {"strategy": "s", "run_id": "20250101T000000Z", "generated_at_utc": "2025-01-01T00:00:10Z", "event_count": 1, "metadata": meta | change.pop("meta", {}), "events": [event | change.pop("event", {})]} | change


def test_artifact_schema(spark, tmp_path):
    cases = [
        ({}, None), ({"run_id": "2025"}, "run_id has another form"), ({"generated_at_utc": "soon"}, "generated_at_utc is no time"), ({"event_count": 2}, "event_count is not the number of events"),
        ({"meta": {"elapsed_seconds": None}}, "metadata.elapsed_seconds is missing"), ({"meta": {"total_events_found": -1}}, "metadata.total_events_found is negative"), ({"meta": {"confidence_distribution": {"explicit": 1}}}, "metadata.inferred is missing"),
        ({"meta": {"undated_events": {"total_undated": 0}}}, "metadata.undated_events.events is missing"), ({"metadata": None}, "metadata is missing"), ({"event": {"url": None}}, "event 0: url is missing"), ({"event": {"precision": 101}}, "event 0: precision out of range"),
        ({"event": {"start_month": 13}}, "event 0: start_month out of range"), ({"event": {"weight": -1}}, "event 0: weight out of range"),
    ]
    for i, (change, _) in enumerate(cases):
        (tmp_path / f"{i:02}.json").write_text(json.dumps(_artifact(**change)))
    rows = spark.read.schema(artifacts.ARTIFACT).option("multiLine", True).json(str(tmp_path)).withColumn("file", F.col("_metadata.file_name"))
    fault = artifacts.validate_artifact(*[F.col(c) for c in ("strategy", "run_id", "generated_at_utc", "event_count", "metadata", "events")])
    assert [r.fault for r in rows.withColumn("fault", fault).orderBy("file").collect()] == [want for _, want in cases]


def test_written_artifacts_pass_their_schema(spark, tmp_path):
    cols = "strategy string, title string, start_year int, confidence string, section string"
    rows = jobs.as_events(spark.createDataFrame([("a", "One", 5, "explicit", "x"), ("a", "Two", 6, "inferred", "y"), ("a", "No date", None, "explicit", "y")], cols).drop("strategy"), "a")
    full = rows.withColumns({"weight": F.lit(1), "precision": F.lit(2.0), "url": F.lit("u"), "span_match_notes": F.lit("n")})
    path = str(tmp_path / "w")
    artifacts.write_artifacts(full, path, "20250101T000000Z", "2025-01-01 00:00:00", "2025-01-01 00:00:04")
    assert [tuple(r) for r in artifacts.check_written(spark, path).collect()] == [("a", 2, 2, None)]
    m = spark.read.schema(f"metadata {artifacts.METADATA}").json(f"{path}/summary").first().metadata
    assert (m.total_events_found, m.total_events_parsed, m.sections_identified, m.elapsed_seconds, m.events_per_second, m.confidence_distribution.inferred) == (3, 2, 2, 4.0, 0.5, 1)
    assert (m.undated_events.total_undated, m.undated_events.events) == (1, [{"title": "No date"}])
    assert {r.title for r in artifacts.read_written(spark, path).collect()} == {"One", "Two"}
    artifacts.write_artifacts(rows, path + "2", "20250101T000000Z")
    assert artifacts.check_written(spark, path + "2").first().error == "precision is missing"


def test_jobs_by_name(spark, tmp_path):
    year = "<title>1500</title><h1>1500</h1><h2>Events</h2><ul><li>March 3 – A thing happened</li></ul>"
    war = "<table><tr><th>Start</th><th>End</th><th>Name</th><th>Who</th></tr><tr><td>431 BC</td><td>404 BC</td><td>Long War</td><td>A vs. B</td></tr></table>"
    spark.createDataFrame([(1, "https://h.example/wiki/1500", year), (2, "https://h.example/wiki/Wars", war)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    run = lambda name, source: jobs.run_job(spark, name, str(tmp_path / source), str(tmp_path / "out"), "20250101T000000Z").collect()
    [r] = run("year_pages", "pages")
    assert (r.strategy, r.start_year, r.start_month, r.start_day, r.is_bc_start) == ("year_pages", 1500, 3, 3, False)
    [r] = run("wars", "pages")
    assert (r.title, r.start_year, r.end_year, r.is_bc_start, r.run_id) == ("Long War", 431, 404, True, "20250101T000000Z")
    (tmp_path / "c.json").write_text(json.dumps({"events": [{"title": "Good one", "start_year": 5, "end_year": 6}, {"title": "x"}]}))
    assert [(r.title, r.strategy) for r in run("curated", "c.json")] == [("Good one", "curated")]
    assert {"periods", "sections", "chronologies", "year_tables"} < set(jobs.JOBS)
    jobs.add_job(jobs.Job("own", jobs.stored_pages, lambda rows: jobs.as_events(rows.selectExpr("url title", "1 start_year"), "own")))
    assert len(run("own", "pages")) == 2
    del jobs.JOBS["own"]


def test_extractors_by_name(spark):
    df = spark.createDataFrame([(1, "1200 BC a town was built, and in 900 BC it fell"), (2, "nothing"), (3, None)], "id int, t string")
    found = {(r.id, r.method): (r.start_year, r.is_bc) for r in jobs.extract_with(df, "id", "t").collect()}
    assert found[1, "spans"] == (1200, True) and found[1, "first_last"] == (1200, True) and (1, "scored") in found and not any(k == 2 for k, _ in found)
    jobs.add_extractor("own", lambda rows, key, text: rows.select(key, F.lit(7).alias("start_year"), F.lit(8).alias("end_year"), F.lit(False).alias("is_bc"), F.lit(1.0).alias("confidence")))
    try:
        assert {r.id: (r.start_year, r.method) for r in jobs.best_years(df, "id", "t", ["spans", "own"]).collect()} == {1: (7, "own"), 2: (7, "own"), 3: (7, "own")}
    finally:
        del jobs.EXTRACTORS["own"]


def test_load_counts(spark):
    cols = "strategy string, file string, event_key string, url string, error string"
    rows = [("a", "f", "k1", "u1", None), ("a", "f", "k1", "u1", None), ("a", "g", None, "u2", None), ("b", "h", "k1", "u1", None), ("b", "h", "k2", "u3", None), ("b", "h", "k3", "u3", "bad")]
    target = spark.createDataFrame([("x", "u1"), ("y", "u3"), ("z", "u9"), ("n", None)], "event_key string, url string")
    names = ["strategy", "files", "collected", "valid", "invalid", "failed", "duplicates", "inserted", "deleted"]
    for mode, deleted in (("upsert", 2), ("replace", 4)):
        got = {r.strategy: [r[n] for n in names[1:]] for r in ev.load_counts(spark.createDataFrame(rows, cols), target, mode).collect()}
        assert got == {"a": [2, 3, 3, 0, 1, 1, 1, None], "b": [1, 3, 2, 1, 0, 1, 1, None], None: [3, 6, 5, 1, 1, 2, 2, deleted]}


def test_auth_report_and_minutes(spark, tmp_path):
    rows = [(1, "2025-01-01 10:00:01", "success", None, None, "/a"), (2, "2025-01-01 10:59:00", "success", None, None, "/a"), (3, "2025-01-01 11:00:00", "failure", "expired", None, "/b"), (4, "2025-01-01 11:00:00", "failure", None, None, "/a"), (5, "2025-01-01 11:00:30", "limited", None, None, "/a"), (6, "2025-01-01 11:00:40", "issued", None, "curl/8.1", "/t"), (7, "2025-01-01 11:00:59", "issued", None, "Mozilla/5.0 (X) Gecko Firefox/120.0", "/t"), (8, "2025-01-01 11:02:00", "issued", None, "", "/t")]
    df = spark.createDataFrame(rows, "event_id long, at string, kind string, reason string, user_agent string, endpoint string").withColumn("ts", F.to_timestamp("at")).drop("at")
    got = {(r.measure, r.value): r.n for r in authlog.auth_report(df).collect()}
    assert got == {
        ("successes", "all"): 2, ("successes by hour", "2025-01-01 10:00"): 2, ("failures by reason", "expired"): 1, ("failures by reason", "unknown"): 1, ("rate-limit hits", "all"): 1,
        ("client types", "cli"): 1, ("client types", "browser"): 1, ("client types", "unknown"): 1, ("browsers", "Firefox"): 1, ("browsers", "unknown"): 2,
    }
    assert [r.tokens for r in authlog.tokens_a_minute(df).orderBy("window_start").collect()] == [2, 1]
    assert [tuple(r) for r in authlog.requests_by_endpoint(df).collect()] == [("/a", 4), ("/t", 3), ("/b", 1)]
    df.write.parquet(str(tmp_path / "log"))
    stream = authlog.tokens_a_minute(authlog.log_stream(spark, str(tmp_path / "log"), ", ".join(f"{n} {t}" for n, t in df.dtypes)))
    stream.writeStream.format("memory").queryName("minutes").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.tokens for r in spark.table("minutes").collect()) == [1, 2]
