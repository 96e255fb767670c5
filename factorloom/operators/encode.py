"""Features of value series and side data as factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions.cross import safe_corr, zscore

#: Lags of autocorrelation, quantiles, sizes of the chunks of the rescaled range, and the least length of a series.
LAGS, QUANTILES, CHUNKS, LEAST = (1, 3, 5, 10), (0.05, 0.25, 0.5, 0.75, 0.95), (5, 10, 20), 10
NAMES = (
    *("mean", "sd", "median", "low", "high", "spread", "skew", "kurt", "slope", "change", "max_drawdown"),
    *[f"q{int(q * 100):02d}" for q in QUANTILES],
    *[f"acf{k}" for k in LAGS],
    *("above_p90", "below_p10", "nonzero", "top_mean", "bottom_mean", "arch", "rescaled_range", "pad"),
)


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def rescaled_range(rows: DataFrame, key: str) -> DataFrame:
    """rows of key, v, i (place from 0), n -> key, rescaled_range: mean over chunk sizes of the mean over full chunks of range over deviation.

    Of a series of n values, chunks of size c start before n - c, and count if their deviation isn't 0; a size counts if 2 c <= n.
    """
    sized = rows.withColumn("size", F.explode(F.array(*[F.lit(c) for c in CHUNKS]))).filter("2 * size <= n")
    chunks = sized.withColumn("chunk", F.floor(F.col("i") / F.col("size"))).filter("chunk * size < n - size")
    one = chunks.groupBy(key, "size", "chunk").agg((F.max("v") - F.min("v")).alias("r"), F.stddev_pop("v").alias("sd")).filter("sd > 1e-8")
    return one.groupBy(key, "size").agg(F.avg(F.col("r") / F.col("sd")).alias("rs")).groupBy(key).agg(F.avg("rs").alias("rescaled_range"))


def series_features(series: DataFrame, key: str, value: str) -> DataFrame:
    """key and 28 features (NAMES) of each key's values in order of date, nulls left out; all 0 for under LEAST values.

    One exchange by key serves all windows and aggregates but those of the rescaled range.
    """
    by, whole = W.partitionBy(key).orderBy("date"), W.partitionBy(key)
    rows = series.select(key, "date", F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumns({"i": F.row_number().over(by) - 1, "n": F.count(F.lit(1)).over(whole), "m": F.avg("v").over(whole), "s": F.stddev_pop("v").over(whole), "top": F.max("v").over(by.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.withColumns({"z": (F.col("v") - F.col("m")) / (F.col("s") + 1e-8), "p": F.percentile("v", F.array(*[F.lit(q) for q in (0.1, 0.25, 0.75, 0.9)])).over(whole), "d2": F.pow(F.col("v") - F.lag("v").over(by), 2)})
    rows = rows.withColumns({**{f"l{k}": F.lag("v", k).over(by) for k in LAGS}, "e2": F.lag("d2").over(by)})
    z, v, p = F.col("z"), F.col("v"), F.col("p")
    share = lambda c: F.avg(c.cast("double"))
    first, last = F.min_by("v", "date"), F.max_by("v", "date")
    made = rows.groupBy(key).agg(
        F.max("n").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.median("v").alias("median"), F.min("v").alias("low"), F.max("v").alias("high"), (F.max("v") - F.min("v")).alias("spread"),
        F.avg(z * z * z).alias("skew"), F.avg(z * z * z * z).alias("kurt"), F.regr_slope("v", "i").alias("slope"), (F.try_divide(last, first + 1e-8) - 1).alias("change"),
        F.max(1 - F.try_divide(v, F.col("top"))).alias("max_drawdown"),
        *[F.percentile("v", F.lit(q)).alias(f"q{int(q * 100):02d}") for q in QUANTILES],
        *[safe_corr(F.col(f"l{k}"), v).alias(f"acf{k}") for k in LAGS],
        share(v > F.get(p, 3)).alias("above_p90"), share(v < F.get(p, 0)).alias("below_p10"), share(F.abs(v) > 1e-8).alias("nonzero"),
        F.avg(F.when(v >= F.get(p, 2), v)).alias("top_mean"), F.avg(F.when(v <= F.get(p, 1), v)).alias("bottom_mean"), safe_corr(F.col("e2"), F.col("d2")).alias("arch"), F.lit(0.0).alias("pad"),
    )
    made = made.join(rescaled_range(rows.select(key, "v", "i", "n"), key), key, "left").withColumn("rescaled_range", F.coalesce("rescaled_range", F.lit(0.5)))
    return made.select(key, *[F.when(F.col("n") >= LEAST, _or_zero(F.col(c))).otherwise(0.0).alias(c) for c in NAMES])


def modal(panel: DataFrame, side: DataFrame, value: str, log: bool = False) -> DataFrame:
    """symbol, date, factor: a side table's value on the panel's keys as z-score within the date; logarithm of one more than its positive part first if log.

    Keys without a value, and dates with one value only, have no row.
    """
    v = F.col(value).cast("double")
    rows = panel.select("symbol", "date").join(side.select("symbol", "date", (F.log1p(F.greatest(v, F.lit(0.0))) if log else v).alias("v")), ["symbol", "date"])
    return rows.select("symbol", "date", zscore(F.col("v"), eps=1e-12).alias("factor")).filter("factor IS NOT NULL")
