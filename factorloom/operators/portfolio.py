"""Portfolios under trading limits, their costs, and custom indices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluate import YEAR, by_symbol, equity

LIMIT = 0.095


def tradable_panel(bars: DataFrame, factor: DataFrame, horizon: int = 1, share: float = 0.1, least_amount: float = 0.0) -> DataFrame:
    """date, symbol, fwd_ret, tradable, chosen: rows that a long portfolio can ever touch.

    chosen marks the top `share` of the date's tradable symbols by factor, ties by symbol. Symbols never chosen on any
    date are never held, so they are dropped before the walk.
    """
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    rows = bars.select("symbol", "date", ret.alias("ret"), F.coalesce("volume", F.lit(1.0)).alias("volume"), F.coalesce("amount", F.col("close") * F.coalesce("volume", F.lit(1.0))).alias("amount"))
    ahead = lambda c: F.lead(c, horizon).over(by_symbol())
    rows = rows.select("symbol", "date", ahead("ret").alias("fwd_ret"), ((ahead("volume") > 0) & (ahead("amount") >= least_amount)).alias("tradable"))
    panel = rows.join(factor.select("symbol", "date", "factor"), ["symbol", "date"]).na.drop(subset=["factor", "fwd_ret"])
    panel = panel.withColumn("tradable", F.coalesce("tradable", F.lit(False)))
    place = F.row_number().over(W.partitionBy("date", "tradable").orderBy(F.desc("factor"), "symbol"))
    n = F.count(F.lit(1)).over(W.partitionBy("date", "tradable"))
    panel = panel.withColumn("chosen", F.col("tradable") & (place <= F.greatest(F.lit(1), F.ceil(n * share))))
    held = panel.filter("chosen").select("symbol").distinct()
    # every date keeps a row, so that the walk sees it even without held symbols
    return panel.join(held, "symbol", "left_semi").select("date", "symbol", "fwd_ret", "tradable", "chosen")


def touched(panel: DataFrame, limit: float = LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a walk can change or read: a symbol's from a date that chooses it to the first that lets it go, and a row of every date.

    Whether a symbol is held follows from its own rows but for dates on which nothing is bought, when all may stay; on these nothing is let
    go here, so the rows are a few more than those held, never fewer. There are at most (chosen a date) x (dates a stay lasts) a date.
    """
    day, own = W.partitionBy(*by, "date"), W.partitionBy(*by, "symbol").orderBy("date")
    buys = F.col("chosen") & (F.col("fwd_ret") < limit - 1e-6)
    sells = F.col("tradable") & ~buys & (F.col("chosen") | (F.col("fwd_ret") > -limit + 1e-6))
    rows = panel.withColumns({"_any": F.max(buys.cast("int")).over(day) == 1, "_first": F.row_number().over(day.orderBy("symbol")) == 1})
    action = F.when(buys, 1).when(sells & F.col("_any"), 0)
    rows = rows.withColumn("_held", F.last(action, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_before", F.lag("_held").over(own))
    return rows.filter("_held = 1 OR _before = 1 OR chosen OR _first").select(panel.columns)


def walk(panel: DataFrame, limit: float = LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """by, date (of the trade), gross, turnover, sells, holdings: the path of equal-weight holdings, one step a date.

    What can't be traded keeps its weight; a symbol up by the limit isn't bought, one down by it isn't sold. Each step needs the one before, so
    a portfolio is one fold over its dates, of the rows that `touched` leaves; portfolios (by) are walked beside each other.
    """
    kinds = dict(panel.dtypes)

    def fold(pdf):
        import pandas as pd

        held: dict[str, float] = {}
        out = []
        days = [(d, g) for d, g in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True)]
        for (_, g), (trade, _) in zip(days, days[1:], strict=False):
            rets = dict(zip(g.symbol, g.fwd_ret, strict=True))
            gross = math.fsum(w * rets[s] for s, w in held.items() if s in rets)
            fresh: dict[str, float] = {}
            for s, r, can, chosen in zip(g.symbol, g.fwd_ret, g.tradable, g.chosen, strict=True):
                had = held.get(s, 0.0)
                if not can:
                    if had > 0:
                        fresh[s] = had
                elif chosen:
                    if r < limit - 1e-6:
                        fresh[s] = 1.0
                elif had > 0 and r <= -limit + 1e-6:
                    fresh[s] = had
            if not fresh:
                fresh = {s: held[s] for s in g.symbol if held.get(s, 0.0) > 0}
            whole = math.fsum(fresh.values())
            fresh = {s: w / whole for s, w in fresh.items()} if whole > 0 else dict(held)
            both = {*held, *fresh}
            out.append(
                (
                    trade,
                    gross,
                    0.5 * math.fsum(abs(fresh.get(s, 0.0) - held.get(s, 0.0)) for s in both),
                    math.fsum(max(0.0, held.get(s, 0.0) - fresh.get(s, 0.0)) for s in both),
                    sum(w > 0 for w in fresh.values()),
                )
            )
            held = fresh
        made = pd.DataFrame(out, columns=["date", "gross", "turnover", "sells", "holdings"])
        for i, k in enumerate(by):
            made.insert(i, k, pdf[k].iloc[0])
        return made

    keys = "".join(f"{k} {kinds[k]}, " for k in by)
    return touched(panel, limit, by).groupBy(*by or [F.lit("all")]).applyInPandas(fold, f"{keys}date date, gross double, turnover double, sells double, holdings long")


def costed(steps: DataFrame, commission: float = 0.0003, stamp_tax: float = 0.0005, two_sided: bool = True) -> DataFrame:
    cost = F.col("turnover") * commission * (2 if two_sided else 1) + F.col("sells") * stamp_tax
    return steps.withColumn("net", F.col("gross") - cost)


def portfolio_stats(steps: DataFrame, risk_free: float = 0.03) -> DataFrame:
    """steps with net -> ann_return, ann_volatility, sharpe, max_drawdown, cum_return, n_rebalances, avg_turnover."""
    ann, vol = F.avg("net") * YEAR, F.stddev_samp("net") * F.sqrt(F.lit(YEAR))
    sums = steps.agg(ann.alias("ann_return"), vol.alias("ann_volatility"), F.try_divide(ann - risk_free, vol).alias("sharpe"), F.count(F.lit(1)).alias("n_rebalances"), F.avg("turnover").alias("avg_turnover"))
    path = equity(steps, "net")
    # the first step counts as a drawdown's start, not as part of the cumulated return
    return sums.crossJoin(path.agg(F.min("drawdown").alias("max_drawdown"), (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("cum_return")))


def cost_grid(steps: DataFrame, commissions=(0.0001, 0.0003, 0.0005), stamp_tax: float = 0.0005, risk_free: float = 0.03) -> DataFrame:
    """Annual return and Sharpe by cost mode and commission. Costs don't change the path, so it is walked once."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("cost_mode"), F.lit(c).alias("commission"), F.lit(k).alias("sides")) for m, k in (("one_side", 1), ("two_side", 2)) for c in commissions]))
    rows = steps.select("date", "gross", "turnover", "sells", grid.alias("g"))
    net = F.col("gross") - F.col("turnover") * F.col("g.commission") * F.col("g.sides") - F.col("sells") * stamp_tax
    rows = rows.select("date", F.col("g.cost_mode").alias("cost_mode"), F.col("g.commission").alias("commission"), "turnover", net.alias("net"))
    ann, vol = F.avg("net") * YEAR, F.stddev_samp("net") * F.sqrt(F.lit(YEAR))
    return rows.groupBy("cost_mode", "commission").agg(ann.alias("ann_return"), F.try_divide(ann - risk_free, vol).alias("sharpe"), F.avg("turnover").alias("avg_turnover"))


def with_before(bars: DataFrame) -> DataFrame:
    """symbol, date, close, before (the symbol's last close before the date).

    A symbol without a bar on a date keeps its last close, so its return there is 0 and its price unchanged: only bars that exist count,
    and no grid of symbols and dates is made.
    """
    past = by_symbol().rowsBetween(W.unboundedPreceding, -1)
    return bars.select("symbol", "date", "close", F.last("close", ignorenulls=True).over(past).alias("before"))


def index_returns(bars: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """date, ret: the weighted sum of constituents' returns (weights: symbol, weight, made to sum to 1; equal if None)."""
    rows = with_before(bars).withColumn("r", F.coalesce(F.try_divide(F.col("close"), F.col("before")) - 1, F.lit(0.0)))
    if weights is None:
        n = bars.agg(F.countDistinct("symbol").alias("n"))
        return rows.groupBy("date").agg(F.sum("r").alias("s")).crossJoin(F.broadcast(n)).select("date", (F.col("s") / F.col("n")).alias("ret"))
    whole = weights.agg(F.sum("weight").alias("whole"))  # a single row
    scaled = weights.crossJoin(F.broadcast(whole)).select("symbol", (F.col("weight") / F.col("whole")).alias("weight"))
    return rows.join(scaled, "symbol", "left").groupBy("date").agg(F.sum(F.col("r") * F.coalesce("weight", F.lit(0.0))).alias("ret"))


def index_levels(returns: DataFrame, base: float = 1000.0) -> DataFrame:
    """date, index_value: compounded returns, `base` on the first date."""
    path = equity(returns, "ret")
    first = path.agg(F.min_by("equity", "date").alias("first"))
    return path.crossJoin(F.broadcast(first)).select("date", (F.col("equity") / F.col("first") * base).alias("index_value"))


def price_index(bars: DataFrame, base: float = 1000.0) -> DataFrame:
    """date, index_value: the sum of all symbols' last closes over that of the first date, from the sums of their changes."""
    change = F.coalesce("close", "before", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    by = with_before(bars).groupBy("date").agg(F.sum(change).alias("c"))
    path = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a date
    sums = by.select("date", F.sum("c").over(path).alias("s"))
    first = sums.agg(F.min_by("s", "date").alias("first"))
    return sums.crossJoin(F.broadcast(first)).select("date", (F.col("s") / F.col("first") * base).alias("index_value"))


def index_stats(levels: DataFrame) -> DataFrame:
    """total_return, annualized_return, volatility, max_drawdown (percent, 2 places) and sharpe."""
    by = W.partitionBy(F.lit(0)).orderBy("date")  # one row a date
    rows = levels.withColumn("r", F.try_divide(F.col("index_value"), F.lag("index_value").over(by)) - 1)
    rows = rows.withColumn("dd", F.col("index_value") / F.max("index_value").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1)
    whole = F.try_divide(F.max_by("index_value", "date"), F.min_by("index_value", "date")) - 1
    out = rows.agg(whole.alias("whole"), F.count("r").alias("n"), F.stddev_pop("r").alias("sd"), F.min("dd").alias("dd"))
    ann = F.when(1 + F.col("whole") > 0, F.pow(1 + F.col("whole"), F.lit(YEAR) / F.col("n")) - 1).otherwise(0.0)
    vol = F.col("sd") * F.sqrt(F.lit(YEAR))
    pct = lambda c: F.round(c * 100, 2)
    return out.select(pct(F.col("whole")).alias("total_return"), pct(ann).alias("annualized_return"), pct(vol).alias("volatility"), pct(F.col("dd")).alias("max_drawdown"), F.round(F.coalesce(F.try_divide(ann, vol), F.lit(0.0)), 2).alias("sharpe"))


def rebased(levels: DataFrame, name: str) -> DataFrame:
    """date, change in percent since the first date of each named series."""
    first = F.first("index_value").over(W.partitionBy(name).orderBy("date"))
    return levels.select(name, "date", ((F.try_divide(F.col("index_value"), first) - 1) * 100).alias("change"))
