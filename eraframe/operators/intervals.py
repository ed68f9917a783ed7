"""Interval filters, binning, ranking and range joins over events with frac_start and frac_end columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eraframe.functions.years import fractional_year, signed_year


def with_positions(events: DataFrame) -> DataFrame:
    """Add frac_start, frac_end (fractional) and signed_start, signed_end."""
    c = F.col
    return events.select(
        "*",
        fractional_year(c("start_year"), c("is_bc_start"), c("start_month"), c("start_day")).alias("frac_start"), fractional_year(c("end_year"), c("is_bc_end"), c("end_month"), c("end_day")).alias("frac_end"),
        signed_year(c("start_year"), c("is_bc_start")).alias("signed_start"), signed_year(c("end_year"), c("is_bc_end")).alias("signed_end"),
    )


def year_range(start: int | None, end: int | None) -> Column:
    """Unsigned start year from start on; end year up to end or none."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("start_year") >= start)
    if end is not None:
        out = out & ((F.col("end_year") <= end) | F.col("end_year").isNull())
    return out


def overlaps(low: float, high: float) -> Column:
    return (F.col("frac_start") <= F.lit(float(high))) & (F.col("frac_end") >= F.lit(float(low)))


def overlaps_open_end(low: int, high: int) -> Column:
    """By signed years; an event without an end must start within the range."""
    ends = (F.col("signed_end") >= low) | (F.col("signed_end").isNull() & (F.col("signed_start") >= low))
    return ends & (F.col("signed_start") <= high)


def max_span(width: float, times: float = 3.0) -> Column:
    return F.abs(F.col("frac_end") - F.col("frac_start")) <= F.lit(times * width)


def max_weight(width: float) -> Column:
    return F.col("weight") <= F.lit(2 * 365 * width)


def explode_bins(events: DataFrame, left: float, width: float, bins: int, first: int = 0) -> DataFrame:
    """A row for each bin [left + i width, left + (i+1) width], both ends inclusive, that an event overlaps; no join."""
    low = F.greatest(F.lit(0), F.ceil((F.col("frac_start") - left) / width - 1).cast("int"))
    high = F.least(F.lit(bins - 1), F.floor((F.col("frac_end") - left) / width).cast("int"))
    rows = events.where(overlaps(left, left + width * bins)).withColumn("lo", low).withColumn("hi", high).where("lo <= hi")
    return rows.withColumn("bin_num", F.explode(F.sequence(F.col("lo") + first, F.col("hi") + first))).drop("lo", "hi")


def topk(rows: DataFrame, by: list[str], k: int, order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each group, with their rank; by weight, then id."""
    order = order or [F.desc("weight"), F.asc("id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def distinct_on(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return topk(rows, [key], 1, order).drop("rank")


def range_join(events: DataFrame, viewports: DataFrame, width: float) -> DataFrame:
    """Pairs of events and viewports (viewport_id, v_low, v_high) that overlap, each once.

    Both sides are dealt to buckets of the given width and joined on the bucket; a pair is kept only in the later of
    the buckets in which the two begin. Events much longer than width have many buckets: choose width near the usual
    viewport, and bound long events by max_span first.
    """
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    e = events.where("frac_start <= frac_end").withColumn("e_bucket", at("frac_start")).withColumn("bucket", F.explode(F.sequence(at("frac_start"), at("frac_end"))))
    v = viewports.where("v_low <= v_high").withColumn("v_bucket", at("v_low")).withColumn("bucket", F.explode(F.sequence(at("v_low"), at("v_high"))))
    pairs = e.join(v, "bucket").where("frac_start <= v_high and frac_end >= v_low and bucket = greatest(e_bucket, v_bucket)")
    return pairs.drop("bucket", "e_bucket", "v_bucket")


def range_totals(events: DataFrame, viewports: DataFrame, width: float, totals: list[Column]) -> DataFrame:
    """viewport_id and totals over the events that each viewport overlaps; viewports without one are left out.

    Viewports with the same bounds are joined and aggregated once, so work grows with the distinct bounds, not with the
    viewports times the events."""
    bounds = viewports.select("v_low", "v_high").distinct().withColumn("viewport_id", F.struct("v_low", "v_high"))
    found = range_join(events, bounds, width).groupBy("v_low", "v_high").agg(*totals)
    return viewports.select("viewport_id", "v_low", "v_high").join(found, ["v_low", "v_high"]).drop("v_low", "v_high")
