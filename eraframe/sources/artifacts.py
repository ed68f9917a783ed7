"""Event artifacts as JSON files: reading, checking and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraframe.functions.text import validate_event

from .store import replace_table

EVENT = "struct<title:string,description:string,start_year:int,start_month:int,start_day:int,end_year:int,end_month:int,end_day:int,is_bc_start:boolean,is_bc_end:boolean,weight:int,precision:double,category:string,url:string,span_match_notes:string,_debug_extraction:string>"
ARTIFACT = f"strategy string, run_id string, generated_at_utc string, event_count int, metadata string, events array<{EVENT}>, _corrupt_record string"


def artifact_error(strategy: Column, run_id: Column, count: Column, events: Column) -> Column:
    """The first fault of an artifact, null if there is none."""
    return (
        F.when(strategy.isNull(), "strategy is missing").when(run_id.isNull(), "run_id is missing").when(~run_id.rlike(r"^\d{8}T\d{6}Z$"), "run_id has another form")
        .when(count.isNull(), "event_count is missing").when(count < 0, "event_count is negative").when(events.isNull(), "events is missing")
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files of a glob: strategy, run_id, file, index, the event's fields; faulty files give one row with
    file and file_error."""
    rows = spark.read.schema(ARTIFACT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    fault = F.when(F.col("_corrupt_record").isNotNull(), "not JSON of an artifact").otherwise(artifact_error(F.col("strategy"), F.col("run_id"), F.col("event_count"), F.col("events")))
    rows = rows.withColumn("file_error", fault)
    good = rows.where("file_error is null").select("strategy", "run_id", "file", F.posexplode("events").alias("index", "e")).select("strategy", "run_id", "file", "index", "e.*")
    return good.unionByName(rows.where("file_error is not null").select("strategy", "run_id", "file", "file_error"), allowMissingColumns=True)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated events from {"events": [...]} or a bare array."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    events = F.coalesce(F.from_json("value", f"struct<events:array<{EVENT}>>").events, F.from_json("value", f"array<{EVENT}>"))
    return rows.select("file", F.posexplode(events).alias("index", "e")).select("file", "index", "e.*")


def curated_events(spark: SparkSession, path: str) -> DataFrame:
    """read_curated with `error`, the first fault of an event (null for valid ones), and a debug record as JSON where the
    file states none; rows without a title are kept with their fault, for quarantine and load_report."""
    c = F.col
    rows = read_curated(spark, path).withColumn("strategy", F.lit("curated"))
    error = validate_event(c("title"), c("start_year"), c("end_year"), c("start_month"), c("start_day"), c("end_month"), c("end_day"), c("weight"))
    made = F.to_json(F.struct(F.lit("curated_events").alias("method"), F.lit("manual_curation").alias("source"), "file", "index"))
    return rows.withColumn("error", error).withColumn("_debug_extraction", F.coalesce("_debug_extraction", made))


def write_exclusions(report: DataFrame, path: str) -> None:
    """An exclusion report (reason, n, samples) as JSON lines."""
    report.write.mode("overwrite").json(path)


# Kinds of confidence that an artifact counts.
CONFIDENCES = ("explicit", "inferred", "approximate", "contentious", "fallback", "legendary")

METADATA = (
    "struct<total_events_found:bigint,total_events_parsed:bigint,sections_identified:bigint,parsing_start_utc:string,parsing_end_utc:string,elapsed_seconds:double,events_per_second:double,"
    f"confidence_distribution:struct<{','.join(f'{c}:bigint' for c in CONFIDENCES)}>,undated_events:struct<total_undated:bigint,events:array<map<string,string>>>>"
)


def metadata_error(m: Column) -> Column:
    """The first fault of an artifact's metadata (METADATA), null if there is none."""
    needed = {n: m[n] for n in ("total_events_found", "total_events_parsed", "sections_identified", "parsing_start_utc", "parsing_end_utc", "elapsed_seconds", "events_per_second", "confidence_distribution", "undated_events")}
    needed |= {c: m["confidence_distribution"][c] for c in CONFIDENCES} | {"total_undated": m["undated_events"]["total_undated"], "undated_events.events": m["undated_events"]["events"]}
    counts = [n for n in needed if n.startswith("total") or n in ("sections_identified", "elapsed_seconds", "events_per_second", *CONFIDENCES)]
    faults = [F.when(m.isNull(), "metadata is missing"), *[F.when(c.isNull(), f"metadata.{n} is missing") for n, c in needed.items()], *[F.when(needed[n] < 0, f"metadata.{n} is negative") for n in counts]]
    faults += [F.when(F.try_to_timestamp(needed[n]).isNull(), f"metadata.{n} is no time") for n in ("parsing_start_utc", "parsing_end_utc")]
    return F.coalesce(*faults)


def event_fault(e: Column) -> Column:
    """The first fault of one event of an artifact by its schema: what must be there, and what its numbers may be."""
    needed = ("title", "start_year", "end_year", "is_bc_start", "is_bc_end", "precision", "weight", "url", "span_match_notes", "description", "category")
    out = [F.when(e[n].isNull(), f"{n} is missing") for n in needed]
    limits = [("precision", 0, 100), ("weight", 0, None), *[(f"{x}_{y}", 1, top) for x in ("start", "end") for y, top in (("month", 12), ("day", 31))]]
    return F.coalesce(*out, *[F.when((e[n] < low) | (F.lit(False) if top is None else e[n] > top), f"{n} out of range") for n, low, top in limits])


def validate_artifact(strategy: Column, run_id: Column, generated: Column, count: Column, metadata: Column, events: Column) -> Column:
    """The first fault of a whole artifact, null if there is none: artifact_error's, its time, its metadata (a string of
    JSON), the number of its events, and its events, with the place of the first faulty one."""
    m = F.from_json(metadata, METADATA)
    first = F.filter(F.transform(events, lambda e, i: F.struct(i.alias("at"), event_fault(e).alias("fault"))), lambda x: x["fault"].isNotNull())
    return F.coalesce(
        artifact_error(strategy, run_id, count, events), F.when(F.try_to_timestamp(generated).isNull(), "generated_at_utc is no time"), metadata_error(m), F.when(count != F.size(events), "event_count is not the number of events"),
        F.when(F.size(first) > 0, F.concat(F.lit("event "), F.get(first, F.lit(0))["at"].cast("string"), F.lit(": "), F.get(first, F.lit(0))["fault"])),
    )


def write_artifacts(events: DataFrame, path: str, run_id: str, started: str | None = None, ended: str | None = None) -> None:
    """Event rows as JSON lines, a folder a strategy, and a summary row each with the run's metadata as METADATA has it; no
    strategy is gathered in one row. started and ended: UTC times of the parse, by default the time of the run id.

    Events without a start year are undated: they are counted, and up to 20 of them named. Sections are the different
    values of `section`, and confidences those of `confidence`, where events have these columns."""
    at = F.to_timestamp(F.lit(run_id), "yyyyMMdd'T'HHmmss'Z'")
    begin, end = (at if t is None else F.to_timestamp(F.lit(t)) for t in (started, ended))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    seconds = end.cast("double") - begin.cast("double")
    has = events.columns
    found, parsed = F.count("*"), F.count_if(F.col("start_year").isNotNull())
    by_kind = F.struct(*[(F.count_if(F.col("confidence") == c) if "confidence" in has else F.lit(0).cast("bigint")).alias(c) for c in CONFIDENCES])
    undated = F.col("start_year").isNull()
    nth = F.row_number().over(Window.partitionBy("strategy", F.when(~undated, F.xxhash64("title"))).orderBy("title"))  # dated rows, which have no use for it, are spread
    some = F.collect_list(F.when(undated & (F.col("_nth") <= 20), F.create_map(F.lit("title"), F.col("title"))))
    metadata = F.struct(
        found.alias("total_events_found"), parsed.alias("total_events_parsed"), (F.count_distinct("section") if "section" in has else F.lit(0).cast("bigint")).alias("sections_identified"), stamp(begin).alias("parsing_start_utc"), stamp(end).alias("parsing_end_utc"),
        seconds.alias("elapsed_seconds"), F.coalesce(F.try_divide(parsed, seconds), F.lit(0.0)).alias("events_per_second"), by_kind.alias("confidence_distribution"), F.struct((found - parsed).alias("total_undated"), some.alias("events")).alias("undated_events"),
    )
    events.where(~undated).withColumn("run_id", F.lit(run_id)).write.partitionBy("strategy").mode("overwrite").json(f"{path}/events")
    summary = events.withColumn("_nth", F.when(undated, nth)).groupBy("strategy").agg(F.lit(run_id).alias("run_id"), stamp(end).alias("generated_at_utc"), parsed.alias("event_count"), metadata.alias("metadata"), F.min("start_year").alias("first_year"), F.max("end_year").alias("last_year"))
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Events of write_artifacts: strategy, run_id and the event's fields."""
    return spark.read.schema(f"strategy string, run_id string, confidence string, section string, {EVENT[7:-1].replace(':', ' ')}").option("basePath", f"{path}/events").json(f"{path}/events")


def check_written(spark: SparkSession, path: str) -> DataFrame:
    """strategy, event_count, stored, error: the summary rows of write_artifacts against the schema of artifacts and the
    events that are stored."""
    summary = spark.read.schema(f"strategy string, run_id string, generated_at_utc string, event_count bigint, metadata {METADATA}").json(f"{path}/summary")
    stored = read_written(spark, path).withColumn("fault", event_fault(F.struct(*[F.col(c) for c in ("title", "start_year", "end_year", "is_bc_start", "is_bc_end", "precision", "weight", "url", "span_match_notes", "description", "category", "start_month", "start_day", "end_month", "end_day")])))
    stored = stored.groupBy("strategy").agg(F.count("*").alias("stored"), F.min("fault").alias("fault"))
    rows = summary.join(stored, "strategy", "full_outer")
    error = F.coalesce(artifact_error(F.col("strategy"), F.col("run_id"), F.col("event_count"), F.lit(True)), metadata_error(F.col("metadata")), F.when(F.col("event_count") != F.coalesce("stored", F.lit(0)), "event_count is not the number of events"), F.col("fault"))
    return rows.select("strategy", "event_count", F.coalesce("stored", F.lit(0)).alias("stored"), error.alias("error"))


def quarantine(events: DataFrame, path: str) -> None:
    """Rows with an error as JSON: strategy, file, index, title, error."""
    events.where("error is not null").select("strategy", "file", "index", "title", "error").write.mode("overwrite").json(path)


def load_replace(events: DataFrame, path: str) -> int:
    """Replace a stored table by a new version of it (see store); a load that fails leaves the old one readable."""
    return replace_table(events, path, by=("strategy",))


def load_stream(spark: SparkSession, folder: str, checkpoint: str, load) -> None:
    """Load new artifact files as they come, each batch by load(events, batch number); ends when all are read."""
    rows = spark.readStream.schema(ARTIFACT).option("multiLine", True).json(folder)
    events = rows.where("events is not null").select("strategy", F.explode("events").alias("e")).select("strategy", "e.*")
    events.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
