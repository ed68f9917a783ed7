"""Categories for new events as artifact files come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eraframe.functions.text import event_key
from eraframe.operators.events import apply_categorisation, topk, without_model_category
from eraframe.sources.artifacts import load_stream

STORED = "event_key string, category string, llm_source string, confidence double, batch long"


def stored_categories(spark: SparkSession, path: str) -> DataFrame:
    """The categories stored so far; none where nothing is stored."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def enrich_new(spark: SparkSession, folder: str, checkpoint: str, path: str, categorise: Callable[[DataFrame], DataFrame], model: str, min_confidence: float = 0.7) -> None:
    """Give each new event of a folder of artifacts its category by `categorise` and store those sure enough under `path`.

    categorise takes events (event_key, title, description) and returns (event_key, category, confidence). Events that have
    a category by a model are left out, an event that comes twice counts once, and events without a title have no key and
    go. A batch that is run again replaces its own rows, so a lost run stores nothing twice. Ends when all files are read."""

    def load(events: DataFrame, batch: int) -> None:
        c = F.col
        keyed = events.withColumn("event_key", event_key(c("title"), c("start_year"), c("end_year"), c("description"))).where("event_key is not null")
        keyed = topk(keyed.select("event_key", "title", "description"), ["event_key"], 1, [F.asc("title"), F.asc("description")]).drop("rank")
        known = stored_categories(spark, path).where(c("batch") != batch)
        asked = without_model_category(keyed, known)
        rows, _ = apply_categorisation(asked, categorise(asked), min_confidence)
        rows.withColumn("llm_source", F.lit(model)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    load_stream(spark, folder, checkpoint, load)
