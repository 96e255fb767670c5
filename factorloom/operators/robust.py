"""Robustness of a factor: walk-forward, horizons, deflated Sharpe ratio, exposures, comparison with the zoo."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions.cross import rank_pct, safe_corr

from . import combine
from . import evaluate as ev


def walk_forward(bars: DataFrame, factor: DataFrame, blocks: int = 5) -> DataFrame:
    """IC summary of each of `blocks` equal runs of dates, each evaluated alone: returns don't reach over its end."""
    dates = bars.select("date").distinct()
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))  # one row a date
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1
    dates = dates.select("date", n.alias("n"), at.alias("at"))
    # the block k with floor(n * k / blocks) <= at < floor(n * (k + 1) / blocks)
    block = F.aggregate(F.array(*[F.lit(k) for k in range(1, blocks)]), F.lit(0), lambda a, k: F.when(F.floor(F.col("n") * k / blocks) <= F.col("at"), k).otherwise(a))
    dates = dates.select("date", block.alias("block"))
    by = W.partitionBy("block", "symbol").orderBy("date")
    rows = bars.select("symbol", "date", "close").join(F.broadcast(dates), "date")
    rows = rows.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by)) - 1).withColumn("fwd_ret", F.lead("ret").over(by))
    panel = rows.join(factor, ["symbol", "date"]).na.drop(subset=["factor", "fwd_ret"])
    return ev.ic_summary(ev.ic_series(panel, ("block",)), ("block",))


def parameter_stability(bars: DataFrame, factor: DataFrame, horizons=(1, 2, 3, 5, 10)) -> DataFrame:
    """std (of the population), min and mean of ICIR over horizons; stable if all are positive."""
    by = ev.ic_decay(bars, factor, horizons)
    return by.agg(F.stddev_pop("icir").alias("icir_std"), F.min("icir").alias("icir_min"), F.avg("icir").alias("icir_mean"), (F.min("icir") > 0).alias("stable"))


def deflated_sharpe(sharpe: float, n: int, trials: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    """Probability that a Sharpe ratio found as the best of `trials` is above what chance gives."""
    if n < 2:
        return 0.0
    best = NormalDist().inv_cdf(1 - 1 / trials) if trials > 1 else 0.0
    spread = math.sqrt(max(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2))
    return NormalDist().cdf((sharpe - best / math.sqrt(n - 1)) * math.sqrt(n - 1) / spread)


def verdict(walk_mean: float, dsr: float, stable: bool) -> str:
    return "PASS" if walk_mean > 0 and dsr > 0.95 and stable else "FAIL"


def train_test(bars: DataFrame, factor: DataFrame, test_share: float = 0.2) -> DataFrame:
    """IC summary on the dates before and from the cut that leaves test_share of dates to the test."""
    dates = bars.select("date").distinct().select("date", F.percent_rank().over(W.partitionBy(F.lit(0)).orderBy("date")).alias("p"))
    split = dates.select("date", F.when(F.col("p") < 1 - test_share, "train").otherwise("test").alias("split"))
    panel = ev.prepare(bars, factor).join(F.broadcast(split), "date")
    return ev.ic_summary(ev.ic_series(panel, ("split",)), ("split",))


def style_exposure(bars: DataFrame, factor: DataFrame, caps: DataFrame, window: int = 20, least: int = 10) -> DataFrame:
    """style, exposure: mean over dates of the correlation of size, momentum and volatility with the factor's rank."""
    by = W.partitionBy("symbol").orderBy("date")
    frame = by.rowsBetween(-(window - 1), 0)
    rows = bars.select("symbol", "date", "ret").join(factor, ["symbol", "date"]).join(caps.select("symbol", "mkt_cap"), "symbol", "left")
    full = F.count("ret").over(frame) == window
    grown = F.aggregate(F.collect_list("ret").over(frame), F.lit(1.0), lambda a, r: a * (1 + r)) - 1
    rows = rows.withColumns({"momentum": F.when(full, grown), "volatility": F.when(full, F.stddev_samp("ret").over(frame)), "size": rank_pct(F.col("mkt_cap"), "date"), "f": rank_pct(F.col("factor"), "date")})
    styles = ("size", "momentum", "volatility")
    long = rows.select("date", "f", F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).alias("v")) for s in styles])).alias("s")).select("date", "f", "s.*").na.drop()
    daily = long.groupBy("style", "date").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("v"), F.col("f")).alias("c")).filter(F.col("n") >= least)
    return daily.groupBy("style").agg(F.avg("c").alias("exposure"))


def industry_exposure(factor: DataFrame, dims: DataFrame) -> DataFrame:
    """industry, mean_rank, and over all industries max_bias and neutral."""
    rows = factor.withColumn("r", rank_pct(F.col("factor"), "date")).join(dims.select("symbol", "industry"), "symbol")
    by = rows.groupBy("industry").agg(F.avg("r").alias("mean_rank"))
    bias = F.max("mean_rank").over(W.partitionBy(F.lit(0))) - F.min("mean_rank").over(W.partitionBy(F.lit(0)))  # one row an industry
    return by.withColumn("max_bias", bias).withColumn("neutral", F.col("max_bias") <= 0.1)


def residual_of_zoo(wide: DataFrame, factor: str, zoo: list[str]) -> DataFrame:
    """symbol, date, factor: what is left of a factor after a pooled regression on the zoo, all centred."""
    rows = wide.select("symbol", "date", F.coalesce(factor, F.lit(0.0)).alias("y"), *[F.coalesce(z, F.lit(0.0)).alias(z) for z in zoo])
    g, s, n = combine.gram(rows, ["y", *zoo])
    c = g - np.outer(s, s) / max(1, n)
    beta = np.linalg.pinv(c[1:, 1:]) @ c[1:, 0]
    mean = s / max(1, n)
    level = float(mean[0] - mean[1:] @ beta)
    return rows.select("symbol", "date", (F.col("y") - level - combine.linear(zoo, beta)).alias("factor"))


def compare_to_zoo(bars: DataFrame, wide: DataFrame, factor: str, zoo: list[str]) -> DataFrame:
    """ICIR of the zoo's best, of the factor, and of its residual; whether the residual adds information."""
    by = ev.batch(bars, wide, [factor, *zoo]).select("factor_name", "icir")
    rest = ev.ic_summary(ev.ic_series(ev.prepare(bars, residual_of_zoo(wide.na.drop(subset=[factor, *zoo]), factor, zoo)))).select(F.col("icir").alias("incremental_icir"))
    top = by.agg(F.max(F.when(F.col("factor_name") != factor, F.col("icir"))).alias("max_zoo_icir"), F.max(F.when(F.col("factor_name") == factor, F.col("icir"))).alias("composite_icir"))
    out = top.crossJoin(rest)
    return out.withColumn("adds", (F.col("incremental_icir") > 0) & (F.col("incremental_icir") > 0.5 * F.col("composite_icir")))
