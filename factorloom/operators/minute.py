"""Daily factors from ticks within the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily(ticks: DataFrame) -> DataFrame:
    """symbol, date, realised volatility, same-day open gap, afternoon volume share, late return and volume peak.

    ticks: symbol, date, time 'HH:mm', ts, event_id, price, volume.
    """
    by = W.partitionBy("symbol", "date").orderBy("ts", "event_id")
    rows = ticks.withColumn("r", F.try_divide(F.col("price"), F.lag("price").over(by)) - 1)
    at = F.struct("ts", "event_id")
    first, last = F.min_by("price", at), F.max_by("price", at)
    return rows.groupBy("symbol", "date").agg(
        (F.stddev_samp("r") * F.sqrt(F.lit(240.0))).alias("intraday_vol"),
        F.when((first > 0) & (last > 0), F.ln(F.try_divide(first, last))).alias("open_gap"),
        F.try_divide(F.sum(F.when(F.col("time") >= "13:00", F.col("volume")).otherwise(0.0)), F.sum("volume")).alias("afternoon_share"),
        F.coalesce(F.sum(F.when(F.col("time") >= "14:30", F.col("r"))), F.lit(0.0)).alias("late_return"),
        F.try_divide(F.max("volume"), F.avg("volume")).alias("volume_peak"),
        F.count(F.lit(1)).alias("n"),
    )


def latest_days(ticks: DataFrame, days: int) -> DataFrame:
    """Ticks of each symbol's last `days` dates."""
    at = F.dense_rank().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    return ticks.withColumn("_day", at).filter(F.col("_day") <= days).drop("_day")


def overnight(days: DataFrame) -> DataFrame:
    """symbol, date, gap: log of a day's first price over the last of the day before."""
    by = W.partitionBy("symbol").orderBy("date")
    before = F.lag("close").over(by)
    return days.select("symbol", "date", F.when((F.col("open") > 0) & (before > 0), F.ln(F.col("open") / before)).alias("gap"))


def profile(ticks: DataFrame) -> DataFrame:
    """Moments, quantiles, autocorrelation and tails of each symbol's prices: what a series encoder starts from."""
    from factorloom.functions.cross import safe_corr

    by = W.partitionBy("symbol").orderBy("ts", "event_id")
    rows = ticks.select("symbol", "price", *[F.lag("price", k).over(by).alias(f"l{k}") for k in (1, 3, 5, 10)])
    q = lambda p: F.percentile("price", p)
    return rows.groupBy("symbol").agg(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"), q(0.05).alias("q05"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), q(0.95).alias("q95"),
        *[safe_corr(F.col("price"), F.col(f"l{k}")).alias(f"acf{k}") for k in (1, 3, 5, 10)],
    )
