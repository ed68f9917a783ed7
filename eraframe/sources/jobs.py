"""Source jobs by name: each fetches pages or files, parses events from them, and leaves an artifact; and extractors of
years from texts by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe.functions.cells import scored_years
from eraframe.functions.spans import best_extraction, extract_spans, first_last_years
from eraframe.operators.events import flatten_span

from . import artifacts, pages

Extractor = Callable[[DataFrame, str, str], DataFrame]

FOUND = ("start_year", "end_year", "is_bc", "confidence")


def _first_last(rows: DataFrame, key: str, text: str) -> DataFrame:
    y = F.col("y")
    return rows.select(key, first_last_years(F.col(text)).alias("y")).where("y is not null").select(key, y.start.year.alias("start_year"), y.end.year.alias("end_year"), y.start.is_bc.alias("is_bc"), y.confidence.alias("confidence"))


def _scored(rows: DataFrame, key: str, text: str) -> DataFrame:
    return scored_years(rows, key, text).select(key, *FOUND)


def _spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    s = F.col("span")
    found = extract_spans(rows.select(key, text), text, F.lit(None).cast("int"), F.lit(False), "food_inline").where("span is not null")
    return found.select(key, s.start_year.alias("start_year"), s.end_year.alias("end_year"), s.start_year_is_bc.alias("is_bc"), F.lit(0.9).alias("confidence"))


#: An extractor takes rows and the names of their key and text, and returns key, start_year, end_year, is_bc, confidence.
EXTRACTORS: dict[str, Extractor] = {"spans": _spans, "scored": _scored, "first_last": _first_last}


def add_extractor(name: str, extractor: Extractor) -> None:
    EXTRACTORS[name] = extractor


def extract_with(rows: DataFrame, key: str, text: str, names: Iterable[str] | None = None) -> DataFrame:
    """What each extractor of those names (all of them by default) finds, with its name as method."""
    parts = [EXTRACTORS[n](rows, key, text).select(key, *FOUND).withColumn("method", F.lit(n)) for n in (names or EXTRACTORS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_years(rows: DataFrame, key: str, text: str, names: Iterable[str] | None = None) -> DataFrame:
    """For each key the find with a start year that is surest; keys without any have no row."""
    return best_extraction(extract_with(rows, key, text, names), key)


@dataclass
class Job:
    """fetch(spark, source) gives the input, parse(input) the events, and artifact(events, path, run_id) stores them."""

    name: str
    fetch: Callable[[SparkSession, str], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    artifact: Callable[[DataFrame, str, str], None] = artifacts.write_artifacts


def _event_columns() -> dict[str, Column]:
    """The columns of an event, in order, and what stands for those that a job doesn't give."""
    none = lambda t: F.lit(None).cast(t)
    return {
        "title": none("string"), "description": F.col("title"), "start_year": none("int"), "start_month": none("int"), "start_day": none("int"), "end_year": F.col("start_year"), "end_month": none("int"), "end_day": none("int"),
        "is_bc_start": F.lit(False), "is_bc_end": F.col("is_bc_start"), "weight": none("int"), "precision": none("double"), "category": F.lit("Uncategorized"), "url": none("string"), "span_match_notes": none("string"),
        "confidence": F.lit("explicit"), "section": F.lit("all"),
    }


def as_events(rows: DataFrame, strategy: str) -> DataFrame:
    """Rows of a job as events: its own columns of those names, else their defaults, and the job's name as strategy."""
    if "span" in rows.columns:
        rows = flatten_span(rows)
    for name, default in _event_columns().items():
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    return rows.select(F.lit(strategy).alias("strategy"), *_event_columns())


def stored_pages(spark: SparkSession, source: str) -> DataFrame:
    """A table of pages (page_id, url, html), one a canonical url."""
    return pages.read_pages(spark, source)


def _of_pages(name: str, events: Callable[[DataFrame], DataFrame]) -> Job:
    return Job(name, stored_pages, lambda rows: as_events(events(rows), name))


def _tables(rows: DataFrame) -> DataFrame:
    d = F.col("date")
    return pages.table_events(rows).select("title", "description", F.abs(d.start).alias("start_year"), F.abs(d.end).alias("end_year"), d.start_month.alias("start_month"), d.start_day.alias("start_day"), d.end_month.alias("end_month"), (d.start < 0).alias("is_bc_start"), (d.end < 0).alias("is_bc_end"), d.precision.alias("precision"), "confidence", F.col("tbl").cast("string").alias("section"))


def _curated(rows: DataFrame) -> DataFrame:
    return as_events(rows.where("error is null").drop("strategy"), "curated")


JOBS: dict[str, Job] = {
    j.name: j
    for j in (
        _of_pages("year_pages", pages.year_page_events),
        _of_pages("wars", pages.war_events),
        _of_pages("periods", pages.period_events),
        _of_pages("sections", pages.sectioned_events),
        _of_pages("chronologies", pages.chronology_events),
        _of_pages("year_tables", _tables),
        Job("curated", artifacts.curated_events, _curated),
    )
}


def add_job(job: Job) -> None:
    JOBS[job.name] = job


def run_job(spark: SparkSession, name: str, source: str, path: str, run_id: str) -> DataFrame:
    """Run a job's three phases and return its events as they were stored."""
    job = JOBS[name]
    job.artifact(job.parse(job.fetch(spark, source)), f"{path}/{name}", run_id)
    return artifacts.read_written(spark, f"{path}/{name}")
