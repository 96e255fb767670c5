"""Queries of the factor library and the expression operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.expr import col, e
from factorloom.operators import factors, recipes
from factorloom.sources import bars as source

from .base import bars_sql, rounded

PLACES = 6


def tree_query(trees, unit="month", places=PLACES):
    def run(spark, sf_dir):
        return rounded(x.columns(source.saved(spark, sf_dir, unit), trees), places)

    return run, f"WITH {bars_sql(unit)}, {x.sql('bars', trees, places=places)}"


C, V, R = col("close"), col("volume"), factors.R
TS = {
    "lag_3": x.lag(C, 3),
    "lead_2": x.lead(C, 2),
    "diff": C - x.lag(C),
    "change_5": factors.change(C, 5),
    "sum_5": x.total(V, 5),
    "mean_10": x.mean(C, 10),
    "std_10": x.std(R, 10),
    "min_10": x.low(C, 10),
    "max_10": x.high(C, 10),
    "mean_20_least_5": x.mean(C, 20, 5),
    "running_sum": x.cumsum(V),
}
MOMENTS = {"skew_20": x.skew(R, 20), "kurt_20": x.kurt(R, 20), "corr_20": x.corr(R, factors.change(V), 20), "zscore_20": (C - x.mean(C, 20, 10)) / (x.std(C, 20, 10) + 1e-8)}
RANKS = {"rank_20": x.rank(R, 20, 10), "slope_20": x.slope(x.ln(C), 20, 5), "maxdd_20": x.maxdd(C, 20), "up_run": x.streak(factors.UP)}
EMAS = {"ema_12": x.ema(C, 12), "ema_26": x.ema(C, 26), "ema_13_force": x.ema(factors.DIFF * V, 13)}

#: Trees as the evolutionary search makes them.
GENOMES = {
    "g1": x.ln(x.absolute(C / (x.lag(C, 5) + 1e-12)) + 1e-12),
    "g2": (V - x.mean(V, 20, 10)) / (x.std(V, 20, 10) + 1e-8),
    "g3": x.corr(C, V, 20, 10) * x.sign(C - x.lag(C)),
    "g4": x.high(col("high"), 20, 5) / (x.low(col("low"), 20, 5) + 1e-12),
    "g5": x.sqrt(x.absolute(col("amount")) + 1e-12) - x.mean(V, 5, 1),
    "g6": x.rank(C, 20, 10) + e(0.5),
}

def clip_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN greatest((SELECT quantile_cont({v}, 0.01) FROM m), least((SELECT quantile_cont({v}, 0.99) FROM m), {v})) END AS {v}"


def rank_sql(v: str, by: str = "") -> str:
    p = f"PARTITION BY {by}" if by else ""
    also = f"{by}, {v}" if by else v
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER ({p} ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {also}) - 1) / 2.0) / count({v}) OVER ({p}) END"


DEMO_SQL = f"""WITH {bars_sql()},
k AS (SELECT symbol, date, close / lag(close, 20) OVER s - 1 AS momentum, close / lag(close, 5) OVER s - 1 AS five, close / lag(close, 60) OVER s - 1 AS trend,
  CASE WHEN count(volume) OVER r >= 20 THEN volume / avg(volume) OVER r END AS busy, CASE WHEN count(ret) OVER r >= 20 THEN -stddev_samp(ret) OVER r END AS low_volatility
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date), r AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
h AS (SELECT *, -five * busy AS divergence, -five AS reversal FROM k),
m AS (SELECT symbol, date, momentum, divergence, low_volatility, 0.5 * {rank_sql('reversal')} + 0.5 * {rank_sql('trend')} AS mixed FROM h),
c AS (SELECT symbol, date, {', '.join(clip_sql(v) for v in ('momentum', 'divergence', 'low_volatility', 'mixed'))} FROM m)
SELECT symbol, date, {', '.join(f"round({rank_sql(v, 'date')}, 6) AS {v}" for v in ('momentum', 'divergence', 'low_volatility', 'mixed'))} FROM c"""


def standard_sql(v: str, out: str, source: str) -> str:
    """Two CTEs that end in `out`: its source with v as a standardised rank."""
    return f"""{out}_r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY coalesce({v}, 0)) + (count(*) OVER (PARTITION BY date, coalesce({v}, 0)) - 1) / 2.0 AS rk FROM {source}),
{out} AS (SELECT * EXCLUDE (rk) REPLACE (CASE WHEN stddev_samp(rk) OVER d > 0 THEN (rk - avg(rk) OVER d) / stddev_samp(rk) OVER d ELSE 0 END AS {v}) FROM {out}_r WINDOW d AS (PARTITION BY date))"""


MIXED_SQL = f"""WITH {bars_sql()},
k AS (SELECT *, ret - coalesce(sum(ret * close * volume) OVER d, 0) / sum(close * volume) OVER d AS excess, ln(abs(ret) / (amount / 1e8) + 1e-10) AS costly FROM bars WINDOW d AS (PARTITION BY date)),
t AS (SELECT symbol, date, CASE WHEN count(excess) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) >= 5 THEN sum(excess) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) END AS e,
  CASE WHEN count(costly) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) >= 21 THEN avg(costly) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) END AS i FROM k),
l AS (SELECT symbol, date, lag(e) OVER s AS reversal, lag(i) OVER s AS illiquidity FROM t WINDOW s AS (PARTITION BY symbol ORDER BY date)),
{standard_sql('reversal', 'a', 'l')}, {standard_sql('illiquidity', 'b', 'a')},
o AS (SELECT symbol, date, reversal, illiquidity, CASE WHEN count(*) OVER d >= 30 AND stddev_pop(reversal) OVER d >= 1e-9
  THEN illiquidity - regr_slope(illiquidity, reversal) OVER d * reversal - regr_intercept(illiquidity, reversal) OVER d ELSE 0 END - reversal AS factor FROM b WINDOW d AS (PARTITION BY date)),
{standard_sql('factor', 'z', 'o')}
SELECT symbol, date, round(reversal, 6) + 0 AS reversal, round(illiquidity, 6) + 0 AS illiquidity, round(factor, 6) + 0 AS factor FROM z"""

_ALL = {
    "ts_basic": tree_query(TS, places=9),
    "ts_moments": tree_query(MOMENTS),
    "ts_rank_slope_drawdown": tree_query(RANKS),
    "ts_ewm": tree_query(EMAS, places=4),
    "factors_trend": tree_query(factors.by_category(factors.TREND)),
    "factors_volatility": tree_query(factors.by_category(factors.VOLATILITY)),
    "factors_trading": tree_query(factors.by_category(factors.TRADING)),
    "factors_price_volume": tree_query(factors.by_category(factors.DIVERGENCE)),
    "factors_formula": tree_query(factors.by_category(factors.FORMULA)),
    "factor_templates": tree_query(factors.TEMPLATES),
    "factor_zoo": tree_query(factors.ZOO),
    "factor_pool": tree_query(factors.POOL),
    "factor_demo": (lambda s, d: rounded(recipes.demo(source.saved(s, d)), PLACES), DEMO_SQL),
    "factor_mixed": (lambda s, d: rounded(recipes.mixed(source.saved(s, d)), PLACES), MIXED_SQL),
    "market_return": (
        lambda s, d: rounded(recipes.market_return(source.saved(s, d)).groupBy("date").agg(F.max("market").alias("market")), PLACES),
        f"WITH {bars_sql()} SELECT date, round(coalesce(sum(ret * close * volume), 0) / sum(close * volume), 6) + 0 AS market FROM bars GROUP BY date",
    ),
    "factor_parameter_grid": tree_query({f"reversal_{n}_of_{m}": x.lag(-x.total(factors.P, n) / (x.std(factors.R, m) + factors.EPS)) for n in (1, 3, 5) for m in (10, 20)}),
    "features_28": tree_query(factors.FEATURES),
    "gp_expressions": tree_query({k: x.fill(x.lag(t), 0) for k, t in GENOMES.items()}),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items()}
