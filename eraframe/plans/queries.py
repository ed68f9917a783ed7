"""Composite queries over events with positions (see operators.intervals.with_positions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraframe.functions.text import label
from eraframe.functions.years import belongs_to_bin, display_year
from eraframe.operators import events as ev
from eraframe.operators import intervals as iv
from eraframe.operators import search as fts


def _filtered(events: DataFrame, categories: DataFrame | None, names: list[str] | None, strategies: list[str] | None) -> DataFrame:
    if strategies:
        events = events.where(F.col("strategy").isin(strategies))
    if names:
        events = ev.has_category(events, categories, names)
    return events


def events_list(events: DataFrame, categories: DataFrame, start: int | None = None, end: int | None = None, names: list[str] | None = None, strategies: list[str] | None = None, limit: int = 100, offset: int = 0, debug: DataFrame | None = None, strategy_names: DataFrame | None = None) -> DataFrame:
    """A page of events by start and end year with their categories. strategy_names (strategy_id, strategy) names the
    strategies of events by their strategy_id, null for unknown ones; debug rows are attached as extraction_debug."""
    if strategy_names is not None:
        events = events.join(strategy_names, "strategy_id", "left")
    rows = _filtered(events.where(iv.year_range(start, end)), categories, names, strategies)
    rows = rows.orderBy(F.asc_nulls_last("start_year"), F.asc_nulls_last("end_year"), "id").offset(offset).limit(limit)
    if debug is not None:
        rows = ev.attach_debug(rows, debug)
    return ev.attach_categories(rows, categories).withColumn("display_year", display_year(F.col("start_year"), F.col("is_bc_start")))


def events_viewport(events: DataFrame, low: float, high: float, limit: int = 100, bins: int = 10) -> DataFrame:
    """The heaviest events of each bin of a viewport, none much longer than it, each once, by (rank, bin, id)."""
    width = high - low
    k = max(10, limit // 10 + 20)
    rows = iv.explode_bins(events.where(iv.max_span(width) & F.col("weight").isNotNull()), low, width / bins, bins)
    rows = iv.distinct_on(iv.topk(rows, ["bin_num"], k).withColumnRenamed("rank", "rank_in_bin"), "id", [F.asc("rank_in_bin"), F.asc("bin_num")])
    return rows.orderBy("rank_in_bin", "bin_num", "id").limit(limit)


def events_by_bins(events: DataFrame, center: float, span: float, zone: str, limit: int = 100, categories: DataFrame | None = None, names: list[str] | None = None, strategies: list[str] | None = None) -> DataFrame:
    """The heaviest events of the five bins of a zone (left, center, right) of fifteen around the centre."""
    width = span / 5
    first = {"left": 0, "center": 5, "right": 10}[zone]
    left = center - span / 2 + (first - 5) * width
    rows = _filtered(events.where(iv.max_span(span) & iv.max_weight(span)), categories, names, strategies)
    return iv.topk(iv.explode_bins(rows, left, width, 5, first), ["bin_num"], max(1, limit // 5)).orderBy("bin_num", "rank")


def events_count(events: DataFrame, low: int, high: int, categories: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    return _filtered(events.where(iv.overlaps_open_end(low, high)), categories, names, None).agg(F.count("*").alias("n"))


def events_count_fractional(events: DataFrame, low: float, high: float, categories: DataFrame | None = None, names: list[str] | None = None, strategies: list[str] | None = None) -> DataFrame:
    return _filtered(events.where(iv.overlaps(low, high)), categories, names, strategies).agg(F.countDistinct("id").alias("n"))


def event_by_id(events: DataFrame, categories: DataFrame, event_id: int) -> DataFrame:
    return ev.attach_categories(events.where(F.col("id") == event_id), categories.where(F.col("event_key") == event_id))


def extraction_debug(events: DataFrame, debug: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("id") == event_id).select(F.col("id").alias("event_id")).join(ev.latest_debug(debug.where(F.col("event_id") == event_id)), "event_id")


def stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"), F.min("signed_start").alias("earliest"), F.max("signed_end").alias("latest"), F.sort_array(F.collect_set("category")).alias("categories"))


def category_facets(events: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct events a category, own or enriched, and whether a model gave it."""
    own = events.where("category is not null").select("event_key", "category", F.lit(False).alias("by_model"))
    more = categories.select("event_key", "category", (F.col("llm_source") != "").alias("by_model"))
    return own.unionByName(more).distinct().groupBy("category").agg(F.countDistinct("event_key").alias("n"), F.bool_or("by_model").alias("has_model")).orderBy(F.desc("n"), "category")


def strategy_counts(strategies: DataFrame, events: DataFrame) -> DataFrame:
    """Events a strategy, those without any too."""
    n = events.groupBy("strategy").agg(F.count("*").alias("n"))
    return strategies.join(n, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "strategy")


def search(events: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return fts.search(events, "id", query, "title", "description").orderBy(F.asc_nulls_last("start_year"), "id").limit(limit)


def uncategorised(events: DataFrame, categories: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n events without a category of their own or of a model, in an order by hash."""
    rows = ev.without_model_category(events.where("category is null"), categories)
    return ev.random_rows(rows, n, F.col("event_key"), seed)


def users_with_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame, role: str | None = None, email: str | None = None, active: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of users, newest first, with their roles and the number of all that match."""
    rows = users
    if active:
        rows = rows.where("is_active")
    if email:
        rows = rows.where(F.col("email").ilike(f"%{email}%"))
    named = user_roles.join(roles, "role_id").select("user_id", "role_name")
    if role:
        rows = rows.join(named.where(F.col("role_name") == role), "user_id", "left_semi")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("created_at"), "user_id").offset(offset).limit(limit)
    have = named.join(page.select("user_id"), "user_id").groupBy("user_id").agg(F.sort_array(F.collect_set("role_name")).alias("roles"))
    return page.join(have, "user_id", "left").join(F.broadcast(total)).withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))  # total is one row


def category_list(categories: DataFrame, strategy: str | None = None) -> DataFrame:
    rows = categories if strategy is None else categories.where(F.col("strategy_name") == strategy)
    return rows.orderBy("name")


def upload_list(uploads: DataFrame, category_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = uploads if category_id is None else uploads.where(F.col("category_id") == category_id)
    return rows.orderBy(F.desc("uploaded_at"), "upload_id").offset(offset).limit(limit)


def rebin(events: DataFrame, left: float, width: float) -> DataFrame:
    """The bin of each event by its midpoint, and its short label; null outside the view."""
    return events.withColumn("bin_num", belongs_to_bin((F.col("frac_start") + F.col("frac_end")) / 2, F.lit(float(left)), F.lit(float(width)))).withColumn("label", label(F.col("title")))


def merge_zones(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and the new ones whose id isn't among them."""
    return old.unionByName(new.join(old.select("id"), "id", "left_anti"))
