"""Stored tables that are replaced as a whole: each version is a folder of its own, and readers see the last one that was
written to its end.

A version's folder is complete when Spark's commit has put its _SUCCESS file there, so a load that fails, or runs twice,
leaves the version before it as it was. One writer at a time. Folders are listed through Hadoop's file system, so any
store will do that Spark can write to.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eraframe.operators.events import upsert_by_url

FOLDER = re.compile(r"version=(\d+)(?:\.(\w+))?$")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str | None, str, bool]]:
    """(number, mark, folder, whether it is complete), ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
    return sorted((int(m[1]), m[2], f"{path}/{name}", done(name)) for name in names if (m := FOLDER.match(name)))


def current(spark: SparkSession, path: str) -> tuple[int, str | None, str | None]:
    """Number, mark and folder of the version that readers see; 0 and nothing where there is none."""
    found = [v[:3] for v in _versions(spark, path) if v[3]]
    return found[-1] if found else (0, None, None)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table as it was last written to its end; with a schema an empty one where there is none yet."""
    _, _, folder = current(spark, path)
    if folder is None:
        if schema is None:
            raise ValueError(f"nothing is stored at {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(folder)


def replace_table(rows: DataFrame, path: str, mark: str | None = None, keep: int = 2, by: tuple[str, ...] = ()) -> int:
    """Write rows as the next version, of which `mark` (letters, digits, _) may say what it holds, and give its number.

    rows may be made from the version before. `keep` versions stay, for readers that have begun; remains of failed loads
    go. by: columns that part the folder."""
    spark = rows.sparkSession
    number = current(spark, path)[0] + 1
    folder = f"{path}/version={number}" + (f".{mark}" if mark else "")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, _, other, complete in _versions(spark, path):  # what a failed load left must not be taken for a version later
        if not complete and other != folder:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(other), True)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(folder)
    for n, _, other, _ in _versions(spark, path):
        if n <= number - keep:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(other), True)
    return number


def upsert_batch(path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = upsert_by_url) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch into the table at path, once: the version is marked with its
    batch, so a batch that is run again, after its version was complete, changes nothing. By default rows of a batch's urls
    take the place of stored ones."""

    def load(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        _, mark, _ = current(spark, path)
        if mark is not None and int(mark.removeprefix("b")) >= batch:
            return
        have = read_table(spark, path, schema)
        replace_table(merge(have, rows.select(have.columns)), path, f"b{batch}")

    return load
