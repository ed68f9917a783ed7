"""The event tables that the registered queries run on, derived from the supplied star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe.operators.intervals import with_positions


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an order: from the order to its last shipment (no end without lines); a tenth is BC, with its years
    swapped so that it doesn't end before it starts."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("mn"), F.max("l_shipdate").alias("mx"))
    segment = read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("strategy"))
    o = read("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    o = o.join(lines, "id", "left").join(segment, "o_custkey", "left")
    o = o.withColumn("s", F.least("o_orderdate", "mn")).withColumn("e", F.when(F.col("mx").isNotNull(), F.greatest("o_orderdate", "mx"))).withColumn("bc", F.col("id") % 10 == 0)
    swap = F.col("bc") & F.col("e").isNotNull()
    return o.select(
        "id", F.concat_ws(" ", "o_orderpriority", F.col("id").cast("string")).alias("title"), F.lit("order").alias("description"), F.when(swap, F.year("e")).otherwise(F.year("s")).alias("start_year"), F.month("s").alias("start_month"), F.dayofmonth("s").alias("start_day"),
        F.when(swap, F.year("s")).otherwise(F.year("e")).alias("end_year"), F.month("e").alias("end_month"), F.dayofmonth("e").alias("end_day"), F.col("bc").alias("is_bc_start"), F.col("bc").alias("is_bc_end"),
        F.when(F.col("e").isNotNull(), F.greatest(F.lit(1), F.datediff("e", "s") + 1)).alias("weight"), F.when(F.col("id") % 7 != 0, F.col("o_orderpriority")).alias("category"), "strategy", F.concat(F.lit("https://host.example/"), (F.col("id") % 1000).cast("string")).alias("url"), "o_totalprice",
    )


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(events(spark, sf_dir))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_key (the order), category (a brand), llm_source, confidence; one row each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linestatus", "l_discount")
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    source = F.when(F.col("l_linestatus") == "O", "").otherwise("m1")
    return lines.join(brands, "l_partkey").groupBy(F.col("l_orderkey").alias("event_key"), F.col("p_brand").alias("category"), source.alias("llm_source")).agg((F.max("l_discount") * 10).alias("confidence"))


#: The same in DuckDB's SQL: ev with positions, cat.
EV = """WITH li AS (SELECT l_orderkey, min(l_shipdate) mn, max(l_shipdate) mx FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey id, o_orderpriority, o_totalprice, c_mktsegment strategy, CASE WHEN mn IS NULL THEN o_orderdate ELSE least(o_orderdate, mn) END s, CASE WHEN mx IS NULL THEN NULL ELSE greatest(o_orderdate, mx) END e, o_orderkey % 10 = 0 bc
 FROM orders LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
ev0 AS (SELECT id, o_orderpriority || ' ' || CAST(id AS VARCHAR) title, 'order' description, CAST(CASE WHEN bc AND e IS NOT NULL THEN year(e) ELSE year(s) END AS INTEGER) start_year, CAST(month(s) AS INTEGER) start_month, CAST(day(s) AS INTEGER) start_day,
 CAST(CASE WHEN bc AND e IS NOT NULL THEN year(s) ELSE year(e) END AS INTEGER) end_year, CAST(month(e) AS INTEGER) end_month, CAST(day(e) AS INTEGER) end_day, bc is_bc_start, bc is_bc_end,
 CASE WHEN e IS NULL THEN NULL ELSE CAST(greatest(1, date_diff('day', CAST(s AS DATE), CAST(e AS DATE)) + 1) AS INTEGER) END weight, CASE WHEN id % 7 <> 0 THEN o_orderpriority END category, strategy, 'https://host.example/' || CAST(id % 1000 AS VARCHAR) url, o_totalprice FROM o),
ev AS (SELECT *, CASE WHEN is_bc_start THEN -start_year ELSE start_year END signed_start, CASE WHEN is_bc_end THEN -end_year ELSE end_year END signed_end,
 CASE WHEN is_bc_start THEN -start_year ELSE start_year END + ([0,31,59,90,120,151,181,212,243,273,304,334][start_month] + start_day) / 365.0e0 frac_start,
 CASE WHEN is_bc_end THEN -end_year ELSE end_year END + ([0,31,59,90,120,151,181,212,243,273,304,334][end_month] + end_day) / 365.0e0 frac_end FROM ev0),
cat AS (SELECT l_orderkey event_key, p_brand category, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'm1' END llm_source, max(l_discount) * 10 confidence FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
"""
