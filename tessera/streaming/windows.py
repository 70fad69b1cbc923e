"""Extension: event-time windows and sessions, and document ingestion as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import fresh_path


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp (watermarks need one), with a watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the same on a stream (with a watermark) and on a table."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def run_available(spark: SparkSession, folder: str, schema, transform, mode: str = "append") -> DataFrame:
    """What ``transform`` gives on all files of ``folder``, run as a stream that ends with the last of them."""
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    rows = transform(spark.readStream.schema(schema).parquet(folder))
    query = rows.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def mentions_stream(docs: DataFrame) -> DataFrame:
    """Names of streamed documents: array expressions only, so it runs without state."""
    from tessera.functions import text as T

    return docs.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", F.explode(T.names(F.col("s.sentence"))).alias("surface"))
