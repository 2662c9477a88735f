"""Rating files as a stream: counters per user, windowed counts with late data, appends at a limited rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import Throttle
from ..sources.tables import RATING_CSV


def rating_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """user_id, item_id, rating of headerless rating files as they arrive in folder."""
    return spark.readStream.schema(RATING_CSV).option("maxFilesPerTrigger", files_per_batch).csv(folder).select("user_id", "item_id", "rating")


def user_counters(ratings: DataFrame) -> DataFrame:
    """The counters of each user so far: n, total. State is one row a user."""
    return ratings.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events (ts, event_type) by time window; rows that come later than late are dropped, and their state with them."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


def append_limited(stream: DataFrame, path: str, checkpoint: str, throttle: Throttle) -> StreamingQuery:
    """Appends each batch under its number, at the throttle's rate; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        throttle.wait()
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
