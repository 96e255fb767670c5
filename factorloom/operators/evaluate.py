"""Scoring a factor against later returns.

`prepare` lines factor and forward return up; all else aggregates its result. Dates with fewer than two rows, or
on which factor or return is constant, have no information coefficient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions.cross import qcut, rank_pct, safe_corr

YEAR = 252.0


def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def prepare(bars: DataFrame, factor: DataFrame, horizon: int = 1, cumulative: bool = False) -> DataFrame:
    """symbol, date, factor, fwd_ret; rows without either are dropped.

    fwd_ret is the one-bar return that ends `horizon` bars later, or with cumulative the return over all of them.
    """
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    rows = bars.select("symbol", "date", "close", ret.alias("ret"))
    ahead = F.try_divide(F.lead("close", horizon).over(by_symbol()), F.col("close")) - 1 if cumulative else F.lead("ret", horizon).over(by_symbol())
    rows = rows.select("symbol", "date", ahead.alias("fwd_ret"))
    return rows.join(factor.select("symbol", "date", "factor"), ["symbol", "date"]).na.drop(subset=["factor", "fwd_ret"])


def ic_series(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """date (and by), n, ic, rank_ic; dates without a coefficient are dropped."""
    keys = [*by, "date"]
    ranked = panel.withColumns({"rf": rank_pct(F.col("factor"), *keys), "rr": rank_pct(F.col("fwd_ret"), *keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("factor"), F.col("fwd_ret")).alias("ic"), safe_corr(F.col("rf"), F.col("rr")).alias("rank_ic"))
    return out.filter("n >= 2 AND ic IS NOT NULL")


def ic_summary(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    spread = F.stddev_samp("ic")
    return series.groupBy(*by).agg(
        F.avg("ic").alias("ic"),
        F.avg("rank_ic").alias("rank_ic"),
        F.try_divide(F.avg("ic"), spread).alias("icir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive_ratio"),
        F.count(F.lit(1)).alias("n_dates"),
    )


def ic_by_year(series: DataFrame) -> DataFrame:
    return ic_summary(series.withColumn("year", F.year("date")), ("year",))


def ic_decay(bars: DataFrame, factor: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """Summary by horizon; all horizons in one pass over the panel."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    rows = bars.select("symbol", "date", ret.alias("ret"))
    rows = rows.withColumns({f"r{h}": F.lead("ret", h).over(by_symbol()) for h in horizons})
    rows = rows.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("fwd_ret")) for h in horizons])).alias("a"))
    panel = rows.select("symbol", "date", "a.*").join(factor, ["symbol", "date"]).na.drop(subset=["factor", "fwd_ret"])
    return ic_summary(ic_series(panel, ("horizon",)), ("horizon",))


def grouped(panel: DataFrame, q: int = 5) -> DataFrame:
    """date, grp, ret: mean forward return of each quantile group."""
    return panel.withColumn("grp", qcut(F.col("factor"), q)).filter("grp IS NOT NULL").groupBy("date", "grp").agg(F.avg("fwd_ret").alias("ret"))


def quantile_returns(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.avg("ret").alias("mean_ret"))


def product(rets):
    """Product of 1 + r; exact for any sign."""
    return F.aggregate(F.collect_list(rets), F.lit(1.0), lambda a, r: a * (1 + r))


def quantile_stats(groups: DataFrame) -> DataFrame:
    mean, spread = F.avg("ret"), F.stddev_samp("ret")
    return groups.groupBy("grp").agg(
        mean.alias("mean_ret"),
        (mean * YEAR).alias("ann_ret"),
        (product(F.col("ret")) - 1).alias("cum_ret"),
        F.coalesce(F.try_divide(mean * YEAR, spread * F.sqrt(F.lit(YEAR))), F.lit(0.0)).alias("sharpe"),
        F.count(F.lit(1)).alias("n"),
    )


def long_short(groups: DataFrame, mode: str = "extremes", q: int = 5) -> DataFrame:
    """date, ls: best less worst group of the date ("extremes"), or the top less the bottom group ("top_minus_bottom")."""
    if mode == "extremes":
        return groups.groupBy("date").agg((F.max("ret") - F.min("ret")).alias("ls"))
    top, bottom = F.max(F.when(F.col("grp") == q - 1, F.col("ret"))), F.max(F.when(F.col("grp") == 0, F.col("ret")))
    return groups.groupBy("date").agg((top - bottom).alias("ls")).filter("ls IS NOT NULL")


def equity(series: DataFrame, value: str) -> DataFrame:
    """date, equity, drawdown of a return series with one row a date.

    The running product is the exponential of a running sum of logarithms, with its sign from the number of factors below 0, and 0 from the first factor 0 on.
    """
    path = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    g = 1 + F.col(value)
    size = F.exp(F.sum(F.when(g != 0, F.ln(F.abs(g))).otherwise(0.0)).over(path))
    sign = 1 - 2 * (F.sum((g < 0).cast("int")).over(path) % 2)
    rows = series.select("date", F.when(F.max(g == 0).over(path), 0.0).otherwise(size * sign).alias("equity"))
    return rows.select("date", "equity", (F.try_divide(F.col("equity"), F.max("equity").over(path)) - 1).alias("drawdown"))


def long_short_stats(ls: DataFrame) -> DataFrame:
    mean, spread = F.avg("ls"), F.stddev_samp("ls")
    sums = ls.agg(mean.alias("mean_ret"), F.try_divide(mean * F.sqrt(F.lit(YEAR)), spread).alias("sharpe"), (F.stddev_pop("ls") * F.sqrt(F.lit(YEAR))).alias("ann_vol"))
    path = equity(ls, "ls").agg((F.max_by("equity", "date") - 1).alias("cum_ret"), F.min("drawdown").alias("max_drawdown"))
    return sums.crossJoin(path)


def turnover(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """Mean over dates of the summed weight changes of the equal-weight top `share` by factor; weights count as 0 before a symbol's first row."""
    return turnovers(rows, {"turnover": share})


def turnovers(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """`turnover` of each share, a column a name; one ranking within dates and one pass by symbol serve all."""
    at = F.row_number().over(W.partitionBy("date").orderBy(F.col("factor").desc_nulls_last(), "symbol"))
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    k = {name: F.floor(F.greatest(F.lit(1.0), F.col("_n") * share)) for name, share in shares.items()}
    placed = rows.select("symbol", "date", at.alias("_at"), n.alias("_n"))
    held = placed.select("symbol", "date", *[F.when(F.col("_at") <= v, 1 / v).otherwise(0.0).alias(name) for name, v in k.items()])
    moved = held.select("date", *[F.abs(F.col(c) - F.coalesce(F.lag(c).over(by_symbol()), F.lit(0.0))).alias(c) for c in shares])
    return moved.groupBy("date").agg(*[F.sum(c).alias(c) for c in shares]).agg(*[F.avg(c).alias(c) for c in shares])


def turnover_by_rank(rows: DataFrame) -> DataFrame:
    """Mean absolute change of the factor's rank among the symbol's own values."""
    r = rows.withColumn("r", rank_pct(F.col("factor"), "symbol"))
    return r.withColumn("d", F.abs(F.col("r") - F.lag("r").over(by_symbol()))).agg(F.avg("d").alias("turnover"))


def coverage(factor: DataFrame, panel: DataFrame) -> DataFrame:
    have = factor.agg(F.avg(F.col("factor").isNotNull().cast("double")).alias("coverage"))
    return have.crossJoin(panel.agg(F.countDistinct("symbol").alias("n_stocks"), F.countDistinct("date").alias("n_dates")))


def benchmark(bars: DataFrame) -> DataFrame:
    """date, ret: mean return of all symbols."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    return bars.select("date", "symbol", ret.alias("r")).filter("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("ret"))


def benchmark_stats(series: DataFrame, bench: DataFrame) -> DataFrame:
    """series (date, r) against bench (date, ret): information ratio, beta, alpha a year."""
    both = series.join(bench, "date", "left").select("r", F.coalesce("ret", F.lit(0.0)).alias("b"))
    excess = F.col("r") - F.col("b")
    beta = F.try_divide(F.covar_samp("r", "b"), F.var_samp("b"))
    return both.agg(
        F.try_divide(F.avg(excess) * F.sqrt(F.lit(YEAR)), F.stddev_samp(excess)).alias("info_ratio"), beta.alias("beta"), ((F.avg("r") - beta * F.avg("b")) * YEAR).alias("alpha_ann")
    )


def icir_proxy(bars: DataFrame, factor: DataFrame) -> DataFrame:
    """ICIR of the factor with the return that ends on its own date."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    rows = bars.select("symbol", "date", ret.alias("fwd_ret")).join(factor, ["symbol", "date"]).na.drop(subset=["factor", "fwd_ret"])
    return ic_summary(ic_series(rows)).select("ic", "icir")


def batch(bars: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Summary of many factors (columns of one wide table) in one pass: factor_name, ic, rank_ic, icir, ...

    Ranks cost two sorts of all rows of all factors; a caller that selects columns other than rank_ic is spared them.
    """
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    rows = bars.select("symbol", "date", ret.alias("ret")).select("symbol", "date", F.lead("ret").over(by_symbol()).alias("fwd_ret"))
    return ic_summary(ic_series(unfolded(factors.join(rows, ["symbol", "date"]), names), ("factor_name",)), ("factor_name",))


def unfolded(wide: DataFrame, names: list[str]) -> DataFrame:
    """Rows (symbol, date, fwd_ret and factors) -> symbol, date, fwd_ret, factor_name, factor, without nulls: joins come before this, as it multiplies rows."""
    each = F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("factor")) for n in names])
    long = wide.na.drop(subset=["fwd_ret"]).select("symbol", "date", "fwd_ret", F.explode(each).alias("f"))
    return long.select("symbol", "date", "fwd_ret", "f.*").na.drop(subset=["factor"])
