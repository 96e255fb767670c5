"""Joins of two streams on a key within an interval of event time.

State is kept on both sides: a row of the first stream until the second's watermark has passed the end of its interval, and a row of
the second until the first's has passed its start. The watermark is `lateness` behind the newest row of the stream that is behind; it
moves when a batch ends, and rows are judged by where it stood before the batch before. A row behind it is late: it is dropped and joins nothing.
The same function over batches gives the join with all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(first: DataFrame, second: DataFrame, key: str, span: str = "2 hours", lateness: str = "1 hour", how: str = "inner") -> DataFrame:
    """key, first_id, first_ts, second_id, second_ts: pairs of equal key with first.ts <= second.ts <= first.ts + span.

    Both have key, event_id and ts. how: inner, or leftOuter, which gives a row of the first stream without a partner once
    no partner can come any more.
    """
    a = first.select(key, F.col("event_id").alias("first_id"), F.col("ts").cast("timestamp").alias("first_ts")).withWatermark("first_ts", lateness)
    b = second.select(F.col(key).alias("_key"), F.col("event_id").alias("second_id"), F.col("ts").cast("timestamp").alias("second_ts")).withWatermark("second_ts", lateness)
    near = (F.col(key) == F.col("_key")) & (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {span}"))
    return a.join(b, near, how).select(key, "first_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "second_id", F.col("second_ts").cast("timestamp_ntz").alias("second_ts"))


def funnel(events: DataFrame, first: str = "view", second: str = "purchase", **options) -> DataFrame:
    """Pairs of a user's events of two types within the interval, out of one stream read twice."""
    one = events.select("user_id", "event_id", "ts", "event_type")
    return within(one.filter(F.col("event_type") == first), one.filter(F.col("event_type") == second), "user_id", **options)
