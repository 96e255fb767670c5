"""Factors whose recipe goes over dates and the whole panel: the demonstration's five, and the mix of reversal and illiquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions import cross
from factorloom.functions import expr as x

from factorloom.sources.files import written

from . import factors
from .factors import C, R, V

#: The demonstration's tails, and the mix's floor of illiquidity, unit of amount, windows and least size of a date.
TAIL = 0.01
FLOOR, UNIT, SHORT, LONG, LEAST = 1e-10, 1e8, 5, 21, 30

DEMO = {
    "momentum": factors.change(C, 20),
    "divergence": -factors.change(C, 5) * (V / x.mean(V, 20)),
    "low_volatility": -x.std(R, 20),
    "reversal": -factors.change(C, 5),
    "trend": factors.change(C, 60),
}


def demo(panel: DataFrame) -> DataFrame:
    """symbol, date, momentum, divergence, low_volatility, mixed: clipped to the panel's TAIL and 1 - TAIL quantiles, then ranked within the date.

    mixed is half the panel-wide rank of the reversal and half that of the trend. Windows are full ones of each symbol. Ranks and quantiles of
    all columns come from two tables of counts, of a row a distinct value; what goes to all tasks is a row a column. The five columns, their
    ranks and the mix are each written once.
    """
    own = ["momentum", "divergence", "low_volatility"]
    rows = written(x.columns(panel, DEMO), "demo")
    ranks = written(cross.panel_ranks_of(rows, [*own, "reversal", "trend"]), "demo")
    share = ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias("rank")
    for name in ("reversal", "trend"):
        at = ranks.filter(F.col("name") == name).select(F.col("value").alias(name), share.alias(f"{name}_rank"))
        rows = rows.join(at, name, "left")
    rows = rows.withColumn("mixed", 0.5 * F.col("reversal_rank") + 0.5 * F.col("trend_rank")).select("symbol", "date", *own, "mixed")
    rows = written(rows, "demo")
    bounds = cross.panel_bounds(ranks.filter(F.col("name").isin(own)), TAIL, 1 - TAIL).unionByName(cross.panel_bounds(cross.panel_ranks_of(rows, ["mixed"]), TAIL, 1 - TAIL))
    # one row: a map of a column's name to its bounds
    held = bounds.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("low", "high").alias("b")))).alias("_bounds"))
    rows = rows.crossJoin(F.broadcast(held))
    clip = lambda n: F.when(F.col(n).isNotNull(), F.greatest(F.col("_bounds")[n]["low"], F.least(F.col("_bounds")[n]["high"], F.col(n))))
    rows = rows.select("symbol", "date", *[clip(n).alias(n) for n in (*own, "mixed")])
    return rows.withColumns({n: cross.rank_pct(F.col(n), "date") for n in (*own, "mixed")})


def market_return(panel: DataFrame) -> DataFrame:
    """panel with market: the date's mean return weighted by close times volume; returns that are missing add nothing to the sum."""
    day = W.partitionBy("date")
    cap = F.col("close") * F.col("volume")
    return panel.withColumn("market", F.try_divide(F.coalesce(F.sum(F.col("ret") * cap).over(day), F.lit(0.0)), F.sum(cap).over(day)))


def standardised(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with out: the rank of value within the date (missing values as 0) less its mean, over its standard deviation, or 0 where that is 0."""
    day = W.partitionBy("date")
    df = df.withColumn("_rank", cross.average_rank(F.coalesce(F.col(value), F.lit(0.0)), "date"))
    spread = F.stddev_samp("_rank").over(day)
    centred = F.col("_rank") - F.avg("_rank").over(day)
    return df.withColumn(out, F.when(spread > 0, centred / spread).otherwise(0.0)).drop("_rank")


def mixed(panel: DataFrame) -> DataFrame:
    """symbol, date, reversal, illiquidity, factor.

    reversal: lagged sum of SHORT returns in excess of the market; illiquidity: lagged mean over LONG bars of the logarithm of |return| per UNIT of amount;
    both as standardised ranks, the second less its fit on the first within the date (0 on a date of under LEAST symbols); factor: the
    standardised rank of that residual less the reversal.
    """
    rows = market_return(panel).withColumn("excess", F.col("ret") - F.col("market")).withColumn("costly", F.ln(F.try_divide(F.abs("ret"), F.col("amount") / UNIT) + FLOOR))
    trees = {"reversal": x.lag(x.total(x.col("excess"), SHORT)), "illiquidity": x.lag(x.mean(x.col("costly"), LONG))}
    rows = x.columns(rows, trees)
    for name in trees:
        rows = standardised(rows, name, name)
    day = W.partitionBy("date")
    n, spread = F.count(F.lit(1)).over(day), F.stddev_pop("reversal").over(day)
    slope = F.covar_pop("illiquidity", "reversal").over(day) / F.nullif(spread * spread, F.lit(0.0))
    rest = (F.col("illiquidity") - F.avg("illiquidity").over(day)) - slope * (F.col("reversal") - F.avg("reversal").over(day))
    rows = rows.withColumn("raw", F.when((n >= LEAST) & (spread >= 1e-9), rest).otherwise(0.0) - F.col("reversal"))
    return standardised(rows, "raw", "factor").select("symbol", "date", "reversal", "illiquidity", "factor")
