"""Logs as streams: new lines are classified as they arrive, and alerts come from event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lumora.operators import logs as L


def read_log_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Unbounded (file, line) rows of a folder of text files; the checkpoint keeps what was read."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def tail_logs(lines: DataFrame) -> DataFrame:
    """Classified lines; no state, so any number of tasks can share the stream."""
    return L.classify_live(L.parse_log(lines))


def _event_time(wall: Column) -> Column:
    """Wall-clock time as an instant (read as UTC): watermarks need instants, and the session zone must not move windows."""
    since = (wall - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(18,6)")
    return F.timestamp_seconds(since)


def _wall_clock(instant: Column) -> Column:
    seconds = (F.unix_micros(instant) / 1000000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def window_counts(lines: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Level and category counts per event-time window. Lines later than the watermark are dropped; state stays bounded."""
    marked = L.classify_log(L.parse_log(lines)).where(F.col("ts").isNotNull()).withColumn("_in", F.lit(True))
    marked = marked.withColumn("_event", _event_time(F.col("ts")))
    if marked.isStreaming:
        marked = marked.withWatermark("_event", delay)
    counts = marked.groupBy(F.window("_event", window).alias("_w")).agg(*L._counters())
    return counts.select(_wall_clock(F.col("_w.start")).alias("window_start"), _wall_clock(F.col("_w.end")).alias("window_end"), *[c for c in counts.columns if c != "_w"])


def stream_alerts(lines: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, alert, amount) for windows that exceed a limit."""
    return L.windowed_alerts(window_counts(lines, window, delay), ["window_start", "window_end"])


def start_sink(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to parquet with exactly-once file commits; stops after the present files when `available_now`."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there now and return the sink as a batch table."""
    query = start_sink(stream, path, checkpoint)
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
