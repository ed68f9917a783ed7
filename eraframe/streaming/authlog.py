"""An auth event log: rate limits, replay checks, windows and alerts, as streams and over tables.

Events have event_id, ts (timestamp), key and kind (success, failure, issued, limited).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eraframe.functions.text import client_class

KINDS = {"error": "failure", "signup": "issued", "purchase": "limited", "click": "success", "view": "success"}


def auth_log(events: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KINDS.items()])
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), kind.alias("kind"))


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def _limit(rows: pd.DataFrame, start: float | None, count: int, limit: int, seconds: float) -> tuple[pd.DataFrame, float | None, int]:
    rows = rows.sort_values(["ts", "event_id"])
    out = []
    for at in rows.ts.astype("int64") / 1e9 if str(rows.ts.dtype) == "datetime64[ns]" else [t.timestamp() for t in rows.ts]:
        if start is None or at - start >= seconds:
            start, count = at, 0
        count += count < limit + 1
        out.append(count <= limit)
    return rows.assign(allowed=out), start, count


def _in_order(log: DataFrame, column: str, limit: int, seconds: float, out: str, flag: bool) -> DataFrame:
    """Add `out`: whether a row is among the first `limit` of its window (or, with flag, is not). A window opens at a
    key's first row and anew with the first one `seconds` or more after that. Keys are dealt to partitions and each
    partition is read in order of key and time with one window at hand, so a key may have any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = start = None
        n = 0
        for b in batches:
            found = []
            at = b.schema.get_field_index
            for k, t in zip(b.column(at(column)).to_pylist(), b.column(at("ts")).cast(pa.int64()).to_pylist(), strict=True):
                if start is None or k != key or t is not None and t - start >= seconds * 1e6:
                    key, start, n = k, t, 0
                n += 1
                found.append((n <= limit) != flag)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.bool_())], names=[*b.schema.names, out])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in log.dtypes), f"{out} boolean"])
    return log.repartition(column).sortWithinPartitions(column, "ts", "event_id").mapInArrow(run, schema)


def rate_limit(log: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """event_id, key, ts, allowed: at most limit events a window that opens at a key's first event and starts anew with
    the first one `seconds` or more after that. A batch twin of rate_limit_stream."""
    return _in_order(log.select("event_id", "key", "ts"), "key", limit, seconds, "allowed", False)


class RateLimiter(StatefulProcessor):
    """State of a key: when its window opened, and how many events it has had."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "start double, n int")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        start, n = self.state.get() if self.state.exists() else (None, 0)
        out, start, n = _limit(pdf, start, n, self.limit, self.seconds)
        self.state.update((float(start), int(n)))
        self.handle.registerTimer(int((start + self.seconds) * 1000))
        yield out[["event_id", "key", "ts", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        """Forget a key whose window is over; a window that opened since has a timer of its own."""
        if self.state.exists() and int((self.state.get()[0] + self.seconds) * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(log: DataFrame, limit: int, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """As rate_limit on a stream. Needs the RocksDB state store; events of a micro-batch are taken in order of time, and
    a key's state goes when the watermark, `late` behind the newest event, passes the end of its window."""
    grouped = log.select("event_id", "key", "ts").withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(RateLimiter(limit, seconds), "event_id long, key long, ts timestamp, allowed boolean", "Append", "EventTime")


def replay_flags(log: DataFrame, column: str, ttl: int) -> DataFrame:
    """Add replayed: the id was accepted less than ttl seconds before. A replay doesn't renew the time of the id."""
    return _in_order(log, column, 1, ttl, "replayed", True)


def replay_dedupe_stream(log: DataFrame, column: str, ttl: str) -> DataFrame:
    """First sightings within ttl; later ones are dropped. Rows later than ttl behind the newest are dropped too."""
    return log.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([column])


def counts(log: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Events a window and kind; rows that come more than `late` behind are dropped on a stream."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def alerts(log: DataFrame, kind: str, over: int, window: str, keyed: bool = True, late: str = "10 minutes") -> DataFrame:
    """Windows with more than `over` events of a kind, by key or in all."""
    return counts(log.where(F.col("kind") == kind), window, late=late, by=("key",) if keyed else ()).where(F.col("n") > over)


def silences(log: DataFrame, kind: str = "success", seconds: int = 600) -> DataFrame:
    """Gaps of more than `seconds` between events of a kind. Hours are separate tasks; the first event of an hour looks back
    to the last one of the hour before it that has any, from a table of one row an hour."""
    rows = log.where(F.col("kind") == kind).select("ts", "event_id", F.date_trunc("hour", "ts").alias("hour"))
    rows = rows.withColumn("before", F.lag("ts").over(Window.partitionBy("hour").orderBy("ts", "event_id")))
    ends = rows.groupBy("hour").agg(F.max("ts").alias("last")).select("hour", F.lag("last").over(Window.orderBy("hour")).alias("hour_before"))
    rows = rows.join(ends, "hour").withColumn("before", F.coalesce("before", "hour_before"))
    return rows.where(F.col("ts").cast("double") - F.col("before").cast("double") > seconds).select(F.col("before").alias("silent_from"), F.col("ts").alias("silent_to"))


def auth_report(log: DataFrame) -> DataFrame:
    """measure, value, n: successes, failures by reason, rate-limit hits, client types and browsers of issued tokens, and
    successes by hour, all in one pass over the log. log also has reason and user_agent; a failure without a reason is
    `unknown`, as is an agent without a browser."""
    kind, client = F.col("kind"), client_class(F.col("user_agent"))
    told = {
        "successes": ("success", F.lit("all")), "successes by hour": ("success", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")), "failures by reason": ("failure", F.coalesce("reason", F.lit("unknown"))),
        "rate-limit hits": ("limited", F.lit("all")), "client types": ("issued", client.client_type), "browsers": ("issued", F.coalesce(client.browser, F.lit("unknown"))),
    }
    said = [F.when(kind == of, F.struct(F.lit(name).alias("measure"), value.alias("value"))) for name, (of, value) in told.items()]
    return log.select(F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("x")).groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))


def tokens_a_minute(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tokens issued in each minute that has any, over a table or a stream."""
    return counts(log.where("kind = 'issued'"), "1 minute", late=late, by=()).withColumnRenamed("n", "tokens")


def requests_by_endpoint(log: DataFrame) -> DataFrame:
    """Requests of each endpoint, the most frequent first."""
    return log.groupBy("endpoint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "endpoint")


def success_rate(log: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    w = F.window("ts", window, slide)
    ok, bad = F.count_if(F.col("kind") == "success"), F.count_if(F.col("kind") == "failure")
    return log.groupBy(w.alias("w")).agg(ok.alias("ok"), bad.alias("failed"), F.count_if(F.col("kind") == "issued").alias("issued"), F.try_divide(ok, ok + bad).alias("rate")).select(F.col("w.start").alias("window_start"), "ok", "failed", "issued", "rate")


def sessions(log: DataFrame, gap: str = "15 minutes") -> DataFrame:
    rows = log.withWatermark("ts", gap) if log.isStreaming else log
    s = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"), F.max("ts").alias("last"))
    return s.select("key", F.col("w.start").alias("session_start"), "last", "requests", (F.col("last").cast("double") - F.col("w.start").cast("double")).alias("seconds"))
