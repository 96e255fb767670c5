"""Queries of cross-section operators and of factor evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import cross
from factorloom.functions import expr as x
from factorloom.operators import evaluate as ev
from factorloom.operators import factors
from factorloom.sources import bars as source

from .base import DIMS_SQL, bars_sql, rounded

TREE = x.lag(-x.total(factors.P, 5))
OTHER = x.lag(x.mean(factors.V, 5))


def inputs(spark, sf_dir):
    b = source.saved(spark, sf_dir)
    return b, x.columns(b, {"factor": TREE})


def panel(spark, sf_dir):
    return ev.prepare(*inputs(spark, sf_dir))


def factor_sql(**trees):
    return x.sql("bars", trees or {"factor": TREE})


BARS = bars_sql()
FACTOR = f"f AS (WITH {factor_sql()})"
PANEL = f"""{BARS}, {FACTOR},
fw AS (SELECT symbol, date, lead(ret, 1) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),
panel AS (SELECT symbol, date, factor, fwd_ret FROM fw JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL)"""


def ic_sql(relation: str = "panel", keys: str = "date") -> str:
    return f"""(SELECT {keys}, count(*) AS n, CASE WHEN min(factor) < max(factor) AND min(fwd_ret) < max(fwd_ret) THEN corr(factor, fwd_ret) END AS ic,
  CASE WHEN min(factor) < max(factor) AND min(fwd_ret) < max(fwd_ret) THEN corr(rf, rr) END AS rank_ic
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY factor) + (count(*) OVER (PARTITION BY {keys}, factor) - 1) / 2.0 AS rf,
          rank() OVER (PARTITION BY {keys} ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY {keys}, fwd_ret) - 1) / 2.0 AS rr FROM {relation})
  GROUP BY {keys} HAVING count(*) >= 2 AND min(factor) < max(factor) AND min(fwd_ret) < max(fwd_ret))"""


def summary_sql(series: str, key: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    return f"""SELECT {key + ',' if key else ''} round(avg(ic), 8) + 0 AS ic, round(avg(rank_ic), 8) + 0 AS rank_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 8) + 0 AS icir,
  round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 8) AS ic_positive_ratio, count(*) AS n_dates FROM {series} {group}"""


EDGES = "(SELECT date, " + ", ".join(f"quantile_cont(factor, {k / 5}) AS q{k}" for k in range(6)) + " FROM panel GROUP BY date)"
GROUPS = f"""{PANEL},
edges AS (SELECT date, list_sort(list_distinct([q0, q1, q2, q3, q4, q5])) AS e FROM {EDGES}),
lab AS (SELECT p.*, greatest(0, len(list_filter(e, lambda v: v < factor)) - 1) AS grp FROM panel p JOIN edges USING (date) WHERE len(e) >= 2),
groups AS (SELECT date, grp, avg(fwd_ret) AS ret FROM lab GROUP BY date, grp)"""
LS = f"{GROUPS}, ls AS (SELECT date, max(ret) - min(ret) AS ls FROM groups GROUP BY date)"
LS_TOP = f"{GROUPS}, ls AS (SELECT * FROM (SELECT date, max(CASE WHEN grp = 4 THEN ret END) - max(CASE WHEN grp = 0 THEN ret END) AS ls FROM groups GROUP BY date) WHERE ls IS NOT NULL)"
LS_STATS = """, eq AS (SELECT date, ls, list_product(list(1 + ls) OVER w) AS equity FROM ls WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT *, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)
SELECT round(avg(ls), 6) + 0 AS mean_ret, round(avg(ls) * sqrt(252) / nullif(stddev_samp(ls), 0), 6) + 0 AS sharpe, round(stddev_pop(ls) * sqrt(252), 6) + 0 AS ann_vol,
  round(arg_max(equity, date) - 1, 6) + 0 AS cum_ret, round(min(drawdown), 6) + 0 AS max_drawdown FROM dd"""


def long_short_query(mode):
    return lambda s, d: rounded(ev.long_short_stats(ev.long_short(ev.grouped(panel(s, d)), mode)))


def cross_section(s, d):
    b = source.saved(s, d)
    f = x.columns(b, {"factor": TREE, "other": OTHER})
    return f.join(source.dimensions(s, d), "symbol")


CROSS = f"{BARS}, {DIMS_SQL}, f0 AS (WITH {factor_sql(factor=TREE, other=OTHER)}), f AS (SELECT f0.*, industry, mkt_cap FROM f0 JOIN dims USING (symbol))"


def xs_basic(s, d):
    v = F.col("factor")
    out = cross_section(s, d).select(
        "symbol",
        "date",
        cross.rank_pct(v, "date").alias("rank_pct"),
        cross.zscore(v).alias("z"),
        cross.zscore(v, eps=1e-12).alias("z_eps"),
        cross.zscore(v, eps=1e-8, clip=1.5).alias("z_clip"),
        cross.winsorize(v, 0.1).alias("winsorized"),
        cross.qcut(v, 5).cast("int").alias("grp"),
    )
    return rounded(out)


XS_BASIC = f"""WITH {CROSS}, q AS (SELECT date, quantile_cont(factor, 0.1) AS lo, quantile_cont(factor, 0.9) AS hi,
  list_sort(list_distinct([quantile_cont(factor, 0.0), quantile_cont(factor, 0.2), quantile_cont(factor, 0.4), quantile_cont(factor, 0.6), quantile_cont(factor, 0.8), quantile_cont(factor, 1.0)])) AS e FROM f GROUP BY date),
z AS (SELECT f.*, factor - avg(factor) OVER (PARTITION BY date) AS c, stddev_samp(factor) OVER (PARTITION BY date) AS s,
  CASE WHEN factor IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY factor NULLS LAST) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0) / count(factor) OVER (PARTITION BY date) END AS r FROM f)
SELECT symbol, date, round(r, 6) AS rank_pct, round(c / nullif(s, 0), 6) + 0 AS z, round(c / (s + 1e-12), 6) + 0 AS z_eps, round(CASE WHEN c IS NOT NULL AND s IS NOT NULL THEN greatest(-1.5, least(1.5, c / (s + 1e-8))) END, 6) + 0 AS z_clip,
  round(CASE WHEN factor IS NOT NULL THEN greatest(lo, least(hi, factor)) END, 6) + 0 AS winsorized,
  CASE WHEN factor IS NOT NULL AND len(e) >= 2 THEN greatest(0, len(list_filter(e, lambda v: v < factor)) - 1) END::INT AS grp FROM z JOIN q USING (date)"""


def xs_neutral(s, d):
    df = cross.neutralize(cross_section(s, d), "factor", out="by_industry")
    df = cross.neutralize(df, "factor", cap="mkt_cap", out="by_industry_cap")
    df = cross.orthogonalize(df, "factor", "other", out="orthogonal")
    return rounded(df.select("symbol", "date", "by_industry", "by_industry_cap", "orthogonal"))


XS_NEUTRAL = f"""WITH {CROSS},
a AS (SELECT *, count(factor) OVER (PARTITION BY date) AS n, factor - avg(factor) OVER (PARTITION BY date, industry) AS y, CASE WHEN factor IS NOT NULL AND mkt_cap > 0 THEN ln(mkt_cap) END AS s0 FROM f),
m AS (SELECT date, median(s0) AS med FROM a GROUP BY date),
b AS (SELECT a.*, CASE WHEN factor IS NOT NULL THEN coalesce(s0, med) END AS s1 FROM a JOIN m USING (date)),
c AS (SELECT *, s1 - avg(s1) OVER (PARTITION BY date, industry) AS x FROM b),
k AS (SELECT *, sum(x * y) OVER (PARTITION BY date) AS sxy, sum(x * x) OVER (PARTITION BY date) AS sxx,
  CASE WHEN factor IS NOT NULL AND other IS NOT NULL THEN factor END AS py, CASE WHEN factor IS NOT NULL AND other IS NOT NULL THEN other END AS px FROM c),
g AS (SELECT *, count(py) OVER (PARTITION BY date) AS pn, avg(py) OVER (PARTITION BY date) AS my, avg(px) OVER (PARTITION BY date) AS mx,
  regr_slope(py, px) OVER (PARTITION BY date) AS slope FROM k)
SELECT symbol, date, round(CASE WHEN n < 10 THEN factor ELSE y END, 6) + 0 AS by_industry,
  round(CASE WHEN n < 10 THEN factor ELSE y - CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * x END, 6) + 0 AS by_industry_cap,
  round(CASE WHEN py IS NULL THEN NULL WHEN pn < 5 THEN py ELSE py - (coalesce(slope, 0) * px + (my - coalesce(slope, 0) * mx)) END, 6) + 0 AS orthogonal FROM g"""


def market(s, d):
    df = source.saved(s, d).join(source.dimensions(s, d), "symbol").filter("ret IS NOT NULL")
    w = cross.on("date")
    cap = F.greatest(F.col("mkt_cap"), F.lit(0.0))
    vw = F.try_divide(F.sum(F.col("ret") * cap).over(w), F.sum(cap).over(w))
    return rounded(df.select("symbol", "date", (F.col("ret") - F.avg("ret").over(w)).alias("residual"), (F.col("ret") - vw).alias("excess_of_weighted")))


MARKET = f"""WITH {BARS}, {DIMS_SQL}, j AS (SELECT bars.*, greatest(mkt_cap, 0) AS cap FROM bars JOIN dims USING (symbol) WHERE ret IS NOT NULL)
SELECT symbol, date, round(ret - avg(ret) OVER (PARTITION BY date), 6) + 0 AS residual,
  round(ret - sum(ret * cap) OVER (PARTITION BY date) / nullif(sum(cap) OVER (PARTITION BY date), 0), 6) + 0 AS excess_of_weighted FROM j"""

NAMES = sorted(factors.by_category(factors.VOLATILITY))


def batch(s, d):
    b = source.saved(s, d)
    return rounded(ev.batch(b, factors.compute(b, NAMES), NAMES), 8)


BATCH = f"""WITH {BARS}, w AS (WITH {x.sql('bars', {n: factors.LIBRARY[n].tree for n in NAMES})}),
fw AS (SELECT symbol, date, lead(ret, 1) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),
long AS ({' UNION ALL '.join(f"SELECT symbol, date, '{n}' AS factor_name, {n} AS factor FROM w" for n in NAMES)}),
panel AS (SELECT * FROM long JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL)
{summary_sql(ic_sql(keys='factor_name, date'), 'factor_name')}"""

HORIZONS = (1, 2, 3, 5, 10, 20)
DECAY = f"""WITH {BARS}, {FACTOR}, fw AS ({' UNION ALL '.join(f"SELECT symbol, date, {h} AS horizon, lead(ret, {h}) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars" for h in HORIZONS)}),
panel AS (SELECT * FROM fw JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL)
{summary_sql(ic_sql(keys='horizon, date'), 'horizon')}"""

TURNOVER = f"""WITH {BARS}, {FACTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC NULLS LAST, symbol) AS pos, floor(greatest(1.0, count(*) OVER (PARTITION BY date) * 0.1)) AS k FROM f),
w AS (SELECT *, CASE WHEN pos <= k THEN 1 / k ELSE 0 END AS w FROM r),
m AS (SELECT date, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY date), 0)) AS d FROM w)
SELECT round(avg(t), 6) AS turnover FROM (SELECT sum(d) AS t FROM m GROUP BY date)"""

TURNOVER_RANK = f"""WITH {BARS}, {FACTOR}, r AS (SELECT *, CASE WHEN factor IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY factor NULLS LAST) + (count(*) OVER (PARTITION BY symbol, factor) - 1) / 2.0) / count(factor) OVER (PARTITION BY symbol) END AS r FROM f)
SELECT round(avg(d), 6) AS turnover FROM (SELECT abs(r - lag(r) OVER (PARTITION BY symbol ORDER BY date)) AS d FROM r)"""

BENCH = "bench AS (SELECT date, avg(ret) AS ret FROM bars WHERE ret IS NOT NULL GROUP BY date)"
BENCH_STATS = f"""WITH {LS}, {BENCH}, j AS (SELECT ls AS r, coalesce(ret, 0) AS b FROM ls LEFT JOIN bench USING (date))
SELECT round(avg(r - b) * sqrt(252) / nullif(stddev_samp(r - b), 0), 6) + 0 AS info_ratio, round(covar_samp(r, b) / nullif(var_samp(b), 0), 6) + 0 AS beta,
  round((avg(r) - covar_samp(r, b) / nullif(var_samp(b), 0) * avg(b)) * 252, 6) + 0 AS alpha_ann FROM j"""


def bench_stats(s, d):
    b, f = inputs(s, d)
    ls = ev.long_short(ev.grouped(ev.prepare(b, f)))
    return rounded(ev.benchmark_stats(ls.withColumnRenamed("ls", "r"), ev.benchmark(b)))


_ALL = {
    "ic_series": (lambda s, d: rounded(ev.ic_series(panel(s, d)), 8), f"WITH {PANEL} SELECT date, n, round(ic, 8) + 0 AS ic, round(rank_ic, 8) + 0 AS rank_ic FROM {ic_sql()}"),
    "ic_summary": (lambda s, d: rounded(ev.ic_summary(ev.ic_series(panel(s, d))), 8), f"WITH {PANEL} {summary_sql(ic_sql())}"),
    "ic_by_year": (lambda s, d: rounded(ev.ic_by_year(ev.ic_series(panel(s, d))), 8), f"WITH {PANEL} {summary_sql(f'(SELECT *, year(date)::INT AS year FROM {ic_sql()})', 'year')}"),
    "ic_decay": (lambda s, d: rounded(ev.ic_decay(*inputs(s, d)), 8), DECAY),
    "ic_batch": (batch, BATCH),
    "icir_proxy": (
        lambda s, d: rounded(ev.icir_proxy(*inputs(s, d)), 8),
        f"WITH {BARS}, {FACTOR}, panel AS (SELECT symbol, date, factor, ret AS fwd_ret FROM bars JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND ret IS NOT NULL) SELECT ic, icir FROM ({summary_sql(ic_sql())})",
    ),
    "quantile_returns": (lambda s, d: rounded(ev.quantile_returns(ev.grouped(panel(s, d)))), f"WITH {GROUPS} SELECT grp::INT AS grp, round(avg(ret), 6) + 0 AS mean_ret FROM groups GROUP BY grp"),
    "quantile_stats": (
        lambda s, d: rounded(ev.quantile_stats(ev.grouped(panel(s, d)))),
        f"WITH {GROUPS} SELECT grp::INT AS grp, round(avg(ret), 6) + 0 AS mean_ret, round(avg(ret) * 252, 6) + 0 AS ann_ret, round(product(1 + ret) - 1, 6) + 0 AS cum_ret, round(coalesce(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0), 0), 6) + 0 AS sharpe, count(*) AS n FROM groups GROUP BY grp",
    ),
    "long_short_series": (lambda s, d: rounded(ev.long_short(ev.grouped(panel(s, d)))), f"WITH {LS} SELECT date, round(ls, 6) + 0 AS ls FROM ls"),
    "long_short_extremes": (long_short_query("extremes"), f"WITH {LS}{LS_STATS}"),
    "long_short_top_bottom": (long_short_query("top_minus_bottom"), f"WITH {LS_TOP}{LS_STATS}"),
    "turnover_top": (lambda s, d: rounded(ev.turnover(inputs(s, d)[1])), TURNOVER),
    "turnover_rank": (lambda s, d: rounded(ev.turnover_by_rank(inputs(s, d)[1])), TURNOVER_RANK),
    "coverage": (
        lambda s, d: rounded(ev.coverage(inputs(s, d)[1], panel(s, d))),
        f"WITH {PANEL} SELECT (SELECT round(avg(CASE WHEN factor IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM f) AS coverage, count(DISTINCT symbol) AS n_stocks, count(DISTINCT date) AS n_dates FROM panel",
    ),
    "benchmark_equal_weight": (lambda s, d: rounded(ev.benchmark(source.saved(s, d)), 8), f"WITH {BARS}, {BENCH} SELECT date, round(ret, 8) + 0 AS ret FROM bench"),
    "benchmark_stats": (bench_stats, BENCH_STATS),
    "xs_basic": (xs_basic, XS_BASIC),
    "xs_neutralize": (xs_neutral, XS_NEUTRAL),
    "xs_market_residual": (market, MARKET),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items()}
