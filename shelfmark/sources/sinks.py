"""Writers for results and stage tables; appends are idempotent by key."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_user_lines(ratings: DataFrame, path: str) -> None:
    """Text lines `user: (item, rating); ...; `, items in order."""
    user_lines(ratings).select(F.concat("user_id", F.lit(": "), "line").alias("value")).write.mode("overwrite").text(path)


def user_lines(ratings: DataFrame) -> DataFrame:
    """user_id and its ratings as one string."""
    entry = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "rating"))), lambda r: F.concat(F.lit("("), r["item_id"].cast("string"), F.lit(", "), r["rating"].cast("int").cast("string"), F.lit("); ")))
    return ratings.groupBy("user_id").agg(F.concat_ws("", entry).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, *partition_by: str) -> None:
    """A stage table, for example predictions partitioned by (normalized, metric, k)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_triples(cells: DataFrame, path: str) -> None:
    """A sparse matrix in long form (row, col, value), rows together, so that readers prune by row."""
    cells.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def write_words(words: DataFrame, path: str, column: str = "term") -> None:
    """A word list, one word a line."""
    words.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str, key: str, value: str) -> None:
    """A dictionary as JSON lines {"key": ..., "value": ...}."""
    pairs.select(F.col(key).alias("key"), F.col(value).alias("value")).write.mode("overwrite").json(path)


def consume(queue: DataFrame, done: DataFrame, key: str, path: str) -> DataFrame:
    """Rewrites a work queue without what is done, at a new path: a lost job leaves the old queue whole."""
    pending(queue, done, key).write.mode("errorifexists").parquet(path)
    return queue.sparkSession.read.schema(queue.schema).parquet(path)


def result_path(base: str, learner: str, data_type: str, selection: str, n_features: int) -> str:
    """Where results of one configuration go: partition folders in place of file names."""
    return f"{base.rstrip('/')}/learner={learner}/data={data_type}/selection={selection}/features={n_features}"


def report(df: DataFrame, rows: int = 6) -> str:
    """The first rows as a table of text, for people."""
    return df.limit(rows).toPandas().to_string(index=False)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends rows with new keys only, so that a repeated run adds nothing."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = pending(df, spark.read.schema(df.schema).parquet(path), key)
    df.write.mode("append").parquet(path)


class Throttle:
    """At least `seconds` between calls and at most `per_day` a day, for the driver of an ingestion job."""

    def __init__(self, seconds: float, per_day: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self.per_day, self.clock, self.sleep = seconds, per_day, clock, sleep
        self.last: float | None = None
        self.day, self.calls = clock(), 0

    def wait(self) -> None:
        now = self.clock()
        if self.calls >= self.per_day:
            self.sleep(max(0.0, 86_400 - (now - self.day)))
            now = self.clock()
        if now - self.day >= 86_400:
            self.day, self.calls = now, 0
        if self.last is not None and now - self.last < self.seconds:
            self.sleep(self.seconds - (now - self.last))
        self.last, self.calls = self.clock(), self.calls + 1
