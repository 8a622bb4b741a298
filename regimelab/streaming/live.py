"""Bars from a stream of events: tumbling windows under a watermark, with the same aggregates as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, file: str = "events.parquet", files_at_once: int = 16) -> DataFrame:
    """A stream of the rows of a Parquet file, or of a folder of that name that files are added to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{file}").schema).option("maxFilesPerTrigger", files_at_once)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)


def window_bars(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type", value: str = "value", time: str = "ts") -> DataFrame:
    """key, start, open, high, low, close, n of each window; rows of windows that the watermark has passed are left out."""
    order = F.struct(time, value)
    made = stream.where(F.col(value) > 0).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key)
    bars = made.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select(F.col(key).alias("ticker"), F.col("window.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def appended(bars: DataFrame, path: str, checkpoint: str, **trigger):
    """The running query that appends each window to a Parquet table once the watermark has passed it; state of earlier windows goes. Started again with the same folders, it goes on where it was."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(stream: DataFrame, batch: DataFrame, folder: str, late: str = "2 hours", time: str = "ts", **options) -> DataFrame:
    """All windows of what a stream holds now: those that the watermark has passed, as appended to a table in `folder`, and the open ones, made from a batch of the same source."""
    closed = window_bars(stream, late=late, time=time, **options)
    appended(closed, f"{folder}/bars", f"{folder}/checkpoint").awaitTermination()
    held = stream.sparkSession.read.schema(closed.schema).parquet(f"{folder}/bars")
    open_from = batch.agg((F.max(F.col(time).cast("timestamp")) - F.expr(f"interval {late}") - F.expr(f"interval {options.get('width', '1 hour')}")).alias("open_from"))
    rows = batch.join(F.broadcast(open_from)).where(F.col(time).cast("timestamp") >= F.col("open_from")).drop("open_from")  # one row
    now = window_bars(rows, late=late, time=time, **options).join(held.select("ticker", "start"), ["ticker", "start"], "left_anti")
    return held.unionByName(now.join(F.broadcast(open_from)).where(F.col("start") > F.col("open_from").cast("timestamp_ntz")).drop("open_from"))
