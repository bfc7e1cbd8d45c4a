"""New documents as a stream: prepared files in, extracted cells out, once for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.extract import extract


def prepared_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Prepared documents (with report_date and seen, the time of arrival) as their Parquet files appear."""
    return spark.readStream.schema(schemas.PREPARED + ", report_date date, seen timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def extract_stream(stream: DataFrame, out: str, checkpoint: str, late: str = "1 day"):
    """A query that writes each batch's cells under its number; a batch run again replaces its own files."""
    once = stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        extract(batch, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on a stream and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, which a pause of `gap` ends."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
