"""Structured Streaming counterparts: bars from ticks, first arrivals, activity sessions.

Each function maps a stream (or a batch) of events to a result; `run_once` drives a stream over what has arrived so
far and returns the result as a table, with its checkpoint in the shared folder, so that a restart goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.sources.files import scratch


def events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The rows of a table as a stream, whether the table is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream can't be read from the path of a file


def timed(ticks: DataFrame) -> DataFrame:
    """ts as an event time: watermarks need a time zone's timestamp."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(ticks: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Bars of tumbling windows by event type; ticks later than the watermark are dropped by a stream."""
    at = F.struct("ts", "event_id")
    made = timed(ticks).withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type")
    out = made.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def sliding(ticks: DataFrame, width: str = "6 hours", slide: str = "3 hours") -> DataFrame:
    out = timed(ticks).withWatermark("ts", "1 hour").groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def activity(ticks: DataFrame, gap: str = "4 hours") -> DataFrame:
    """Sessions of each user: runs of events no further apart than the gap."""
    out = timed(ticks).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def arrivals(ticks: DataFrame) -> DataFrame:
    """The first event of each (user, type); a stream keeps the pairs it has seen."""
    return ticks.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Processes all available input and returns what the sink holds. complete: the last result; append: all rows."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def sink(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/*")
