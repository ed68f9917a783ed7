"""Dedupe, identity, categories, enrichment and loads of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraframe.functions.text import closest_category, normalise_title

from .intervals import topk


def dedupe_events(events: DataFrame) -> DataFrame:
    """One event for each (normalised title, start, end, BC start): the first by file and index; adds `copies`."""
    key = [normalise_title(F.col("title")), F.col("start_year"), F.col("end_year"), F.col("is_bc_start")]
    w = Window.partitionBy(*key)
    rows = events.withColumn("nth", F.row_number().over(w.orderBy("file", "index"))).withColumn("copies", F.count("*").over(w) - 1)
    return rows.where("nth = 1").drop("nth")


def dedupe_identity(events: DataFrame, order: list[str]) -> DataFrame:
    """Keep the first row of each identity (title, years, flags, url) and then of each event_key; a null part never equals."""
    for key in (["title", "start_year", "end_year", "is_bc_start", "is_bc_end", "url"], ["event_key"]):
        named = F.lit(True)
        for c in key:
            named = named & F.col(c).isNotNull()
        events = topk(events.where(named), key, 1, [F.asc(c) for c in order]).drop("rank").unionByName(events.where(~named))
    return events


def page_dedupe(pages: DataFrame) -> DataFrame:
    """The first page of each page id, or of its url where it has none."""
    return topk(pages.withColumn("k", F.coalesce(F.col("page_id").cast("string"), F.col("url"))), ["k"], 1, [F.asc("seq")]).drop("rank", "k")


def latest_debug(debug: DataFrame) -> DataFrame:
    """The newest debug row of each event."""
    row = F.struct(*[c for c in debug.columns if c != "event_id"])
    return debug.groupBy("event_id").agg(F.max_by(row, F.struct("created_at", "debug_id")).alias("d")).select("event_id", "d.*")


def upsert_categories(have: DataFrame, new: DataFrame, min_confidence: float, allowed: list[str] | None = None) -> DataFrame:
    """Last write wins for each (event_key, category, llm_source); new rows need the confidence and an allowed category."""
    new = new.where(F.col("confidence") >= min_confidence)
    if allowed is not None:
        new = new.where(F.col("category").isin(allowed))
    rows = have.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
    order = [F.desc("late"), F.desc("created_at"), F.desc_nulls_last("confidence")]
    return topk(rows, ["event_key", "category", "llm_source"], 1, order).drop("rank", "late")


def attach_categories(events: DataFrame, categories: DataFrame) -> DataFrame:
    """Add `categories`, an array of (category, llm_source, confidence): model-made ones by confidence, then others; the
    event's own category last if it isn't among them."""
    item = F.struct((F.col("llm_source") == "").alias("own"), (-F.coalesce("confidence", F.lit(-1.0))).alias("low"), "category", "llm_source", "confidence")
    rows = categories.groupBy("event_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = F.transform(F.coalesce("items", F.array()), lambda x: F.struct(x.category, x.llm_source, x.confidence))
    out = events.join(rows, "event_key", "left").withColumn("items", F.when(F.col("items").isNotNull(), items).otherwise(F.array().cast("array<struct<category:string,llm_source:string,confidence:double>>")))
    missing = F.col("category").isNotNull() & ~F.exists("items", lambda x: x.category == F.col("category"))
    own = F.array(F.struct(F.col("category").alias("category"), F.lit("").alias("llm_source"), F.lit(None).cast("double").alias("confidence")))
    return out.withColumn("categories", F.when(missing, F.concat("items", own)).otherwise(F.col("items"))).drop("items")


def has_category(events: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """Events whose own category is in names or that have one of them in the category table."""
    keys = categories.where(F.col("category").isin(names)).select("event_key").distinct().withColumn("named", F.lit(True))
    return events.join(keys, "event_key", "left").where(F.col("category").isin(names) | F.col("named")).drop("named")


def without_model_category(events: DataFrame, categories: DataFrame) -> DataFrame:
    return events.join(categories.where("llm_source <> ''").select("event_key"), "event_key", "left_anti")


def orphans(rows: DataFrame, events: DataFrame) -> DataFrame:
    return rows.join(events.select("event_key"), "event_key", "left_anti")


def prune(rows: DataFrame, events: DataFrame) -> DataFrame:
    return rows.join(events.select("event_key"), "event_key", "left_semi")


def upsert_by_url(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Target rows of no incoming url, and the incoming rows; a null url matches nothing."""
    return target.join(incoming.select("url").distinct(), "url", "left_anti").select(target.columns).unionByName(incoming.select(target.columns))


def reimport(target: DataFrame, incoming: DataFrame, enrichments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new events, and the enrichments that no event has any more; enrichments stay attached by event_key."""
    events = upsert_by_url(target, incoming)
    return events, orphans(enrichments, events)


def replace_category(target: DataFrame, upload: DataFrame, category_id: int, overwrite: bool) -> DataFrame:
    """Put an upload into a category. Rows that the category has are an error unless overwrite, which drops them; a key
    that another row has updates its category_id, title, description and category and keeps the rest. Adds action."""
    if not overwrite and not target.where(F.col("category_id") == category_id).isEmpty():
        raise ValueError(f"category {category_id} has events; set overwrite to replace them")
    rest = target.where(~F.col("category_id").eqNullSafe(F.lit(category_id)))
    new = topk(upload, ["event_key"], 1, [F.asc("index")]).drop("rank", "index").withColumn("category_id", F.lit(category_id))
    n = new.select("event_key", *[F.col(c).alias(f"new_{c}") for c in ("category_id", "title", "description", "category")])
    old = rest.join(n, "event_key", "left")
    hit = F.col("new_category_id").isNotNull()
    old = old.select(*[F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in n.columns else c for c in target.columns], F.when(hit, "updated").otherwise("kept").alias("action"))
    added = new.join(rest.select("event_key"), "event_key", "left_anti").select(*target.columns, F.lit("inserted").alias("action"))
    return old.unionByName(added)


def category_audit(replaced: DataFrame, category_id: int, strategy: str, run_id: str, generated_at: str, uploaded_by: str, overwrite: bool) -> DataFrame:
    """One audit row of a replace_category: who put which file into the category, events put in, and the run as JSON."""
    about = F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.lit(generated_at).alias("generated_at_utc"), F.lit(overwrite).alias("overwrite")))
    made = {"category_id": F.lit(category_id), "uploaded_by": F.lit(uploaded_by), "filename": F.lit(f"{strategy}_{run_id}.json"), "events_count": F.count_if(F.col("action") != "kept"), "events_updated": F.count_if(F.col("action") == "updated"), "status": F.lit("completed"), "metadata": about}
    return replaced.agg(*[c.alias(n) for n, c in made.items()])


def load_report(events: DataFrame) -> DataFrame:
    """Per strategy, and in all (null strategy): collected, valid, invalid."""
    return events.rollup("strategy").agg(F.count("*").alias("collected"), F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error").isNotNull()).alias("invalid"))


def load_counts(events: DataFrame, target: DataFrame, mode: str = "replace") -> DataFrame:
    """What a load of events (strategy, file, event_key, url, error) into target (event_key, url) does, per strategy and in
    all (null strategy): files, collected, valid, invalid, failed (valid, without a key), duplicates (valid rows after the
    first of their key), inserted and deleted. A key counts for the strategy of its first row by file. Replacing deletes all
    of the target, upserting the target's rows of incoming urls; deleted rows are told for the whole load alone."""
    valid = F.col("error").isNull()
    first = F.row_number().over(Window.partitionBy("event_key", F.col("event_key").isNotNull() & valid).orderBy("strategy", "file", "url"))
    kept = valid & F.col("event_key").isNotNull()
    rows = events.withColumn("nth", F.when(kept, first))
    out = rows.rollup("strategy").agg(
        F.count_distinct("file").alias("files"), F.count("*").alias("collected"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(valid & F.col("event_key").isNull()).alias("failed"),
        F.count_if(F.col("nth") > 1).alias("duplicates"), F.count_if(F.col("nth") == 1).alias("inserted"), F.grouping("strategy").alias("whole"),
    )
    gone = target if mode == "replace" else target.join(rows.where("nth = 1").select("url").distinct(), "url", "left_semi")
    gone = gone.agg(F.count("*").alias("deleted")).withColumn("whole", F.lit(1).cast("byte"))
    return out.join(gone, "whole", "left").drop("whole")


def confidence_distribution(events: DataFrame, keys: tuple[str, ...] = ("explicit", "inferred", "approximate", "contentious", "fallback", "legendary")) -> DataFrame:
    return events.groupBy("strategy").agg(*[F.count_if(F.col("confidence") == k).alias(k) for k in keys])


def exclusion_report(rows: DataFrame, per_page: int = 8, overall: int = 25) -> DataFrame:
    """reason, n, samples: counts of all exclusions, and samples of at most so many a page and in all, cut at 200."""
    some = topk(topk(rows, ["reason", "page_id"], per_page, [F.asc("seq")]).drop("rank"), ["reason"], overall, [F.asc("page_id"), F.asc("seq")])
    some = some.groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 200).alias("text")))), lambda x: x.text).alias("samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(some, "reason")


def apply_categorisation(events: DataFrame, results: DataFrame, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, ids on one side only): results (event_key, category, confidence) against the events asked for."""
    both = events.select("event_key", F.lit(1).alias("asked")).join(results.withColumn("given", F.lit(1)), "event_key", "full_outer")
    wrong = both.where("asked is null or given is null").select("event_key", F.when(F.col("given").isNull(), "missing").otherwise("extra").alias("fault"))
    sure = F.coalesce("confidence", F.lit(0.8))
    return both.where("asked = 1 and given = 1").select("event_key", closest_category(F.col("category")).alias("category"), sure.alias("confidence")).where(F.col("confidence") >= min_confidence), wrong


def rowspan_fill(cells: DataFrame) -> DataFrame:
    """Carry year_cell down the rows that its rowspan covers, in a table's row order; adds year_filled, inherited."""
    w = Window.partitionBy("page_id", "table").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    src = F.last(F.when(F.col("year_cell").isNotNull(), F.struct("row", "year_cell", F.coalesce("rowspan", F.lit(1)).alias("rowspan"))), ignorenulls=True).over(w)
    rows = cells.withColumn("src", src)
    covered = F.col("row") - F.col("src.row") < F.col("src.rowspan")
    return rows.withColumn("year_filled", F.when(covered, F.col("src.year_cell"))).withColumn("inherited", covered & F.col("year_cell").isNull()).drop("src")


def section_inherit(headings: DataFrame, levels: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """Give each heading (page_id, seq, level, span) the span of its own, or of its nearest ancestor that has one."""
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, found = headings, F.col("span")
    for n in reversed(levels[:-1]):  # deepest ancestors first; an ancestor counts while no heading at or above it follows
        latest = F.last(F.when(F.col("level") <= n, F.struct("level", "span")), ignorenulls=True).over(w)
        out = out.withColumn(f"at{n}", latest)
        found = F.coalesce(found, F.when((F.col("level") > n) & (F.col(f"at{n}.level") == n), F.col(f"at{n}.span")))
    return out.withColumn("section_span", found).drop(*[f"at{n}" for n in levels[:-1]])


def random_rows(rows: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows in an order by hash of key and seed; the same rows each time."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def attach_debug(events: DataFrame, debug: DataFrame) -> DataFrame:
    """Events with the columns of their latest extraction debug row as a struct `extraction_debug`, null without one."""
    last = latest_debug(debug)
    fields = F.struct(*[F.col(c) for c in last.columns if c != "event_id"]).alias("extraction_debug")
    return events.join(last.select(F.col("event_id").alias("id"), fields), "id", "left")


def flatten_span(events: DataFrame, span: str = "span", notes: str = "match_type") -> DataFrame:
    """Events with the fields of their span as columns of their own and how it matched as span_match_notes."""
    years = {"start_year_is_bc": "is_bc_start", "end_year_is_bc": "is_bc_end", notes: "span_match_notes"}
    names = ("start_year", "end_year", "start_month", "start_day", "end_month", "end_day", "start_year_is_bc", "end_year_is_bc", "precision", notes)
    own = [c for c in events.columns if c != span and c not in {years.get(n, n) for n in names}]
    return events.select(*own, *[F.col(f"{span}.{n}").alias(years.get(n, n)) for n in names])


def run_metadata(events: DataFrame, started: str, ended: str, section: str, by: str = "strategy") -> DataFrame:
    """Per run: events found, parsed (with a start year) and undated, sections, seconds from the first start to the last
    end and events a second (null for no time). started, ended: columns of an event's own times, in seconds."""
    found, elapsed = F.count("*"), F.max(ended) - F.min(started)
    parsed = F.count_if(F.col("start_year").isNotNull())
    return events.groupBy(by).agg(found.alias("total_events_found"), parsed.alias("total_events_parsed"), (found - parsed).alias("total_undated"), F.countDistinct(section).alias("sections_identified"), elapsed.alias("elapsed_seconds"), F.try_divide(found, elapsed).alias("events_per_second"))


def date_formats(events: DataFrame, kind: str = "span_match_notes") -> DataFrame:
    """Events a date format, and their share of all."""
    n = events.groupBy(kind).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a format


def date_quality(events: DataFrame, least: float = 0.95, ancient: int = -1000) -> DataFrame:
    """One row: share of dated events and whether it is `least` or more, rows whose eras contradict their order, and
    events that begin before `ancient` (signed years)."""
    total, dated = F.count("*"), F.count_if(F.col("start_year").isNotNull())
    signed = lambda y, bc: F.when(F.col(bc), -F.col(y)).otherwise(F.col(y))
    start, end = signed("start_year", "is_bc_start"), signed("end_year", "is_bc_end")
    rate = F.try_divide(dated, total)
    return events.agg(total.alias("total"), dated.alias("dated"), rate.alias("success_rate"), (rate >= least).alias("passes"), F.count_if(start > end).alias("inconsistent"), F.count_if(start < ancient).alias("ancient"))


def average_confidence(results: DataFrame, by: str) -> DataFrame:
    """Mean confidence of a run's results, and as a percentage with one decimal; null where none has a confidence."""
    mean = F.avg("confidence")
    return results.groupBy(by).agg(mean.alias("average"), F.concat(F.format_number(mean * 100, 1), F.lit("%")).alias("shown"))
