"""Queries of portfolios, combination and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import combine, factors, portfolio, robust
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source

from .base import DIMS_SQL, bars_sql, rounded
from .eval_queries import BARS, FACTOR, TREE, ic_sql, inputs, summary_sql

#: Three factors with short windows, as the monthly panel is short.
THREE = {"rev": TREE, "liq": x.lag(x.log1p(x.mean(factors.A, 5))), "vol": x.lag(-x.std(factors.R, 5))}
NAMES = list(THREE)
WIDE = f"{BARS}, w AS (WITH {x.sql('bars', THREE)})"
Z = {n: f"(({n} - avg({n}) OVER (PARTITION BY date)) / (stddev_samp({n}) OVER (PARTITION BY date) + 1e-12))" for n in NAMES}


def wide(s, d):
    b = source.saved(s, d)
    return b, x.columns(b, THREE)


def members(s, d):
    """A factor system: name, dimension, quality, ic, icir, weight."""
    cat = factors.catalog(s)
    n = F.length("name")
    return cat.select("name", F.col("category").alias("dimension"), "quality", ((n % 7 - 3) / 100).alias("ic"), ((n % 5 - 2) / 10).alias("icir"), (n % 3 - 1).cast("double").alias("weight"))


CATALOG_SQL = "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', '{f.category}', '{f.direction}', {f.quality}::DOUBLE, '{x.key(f.tree)[2:]}')" for f in factors.LIBRARY.values()) + ") AS c(name, category, direction, quality, hash))"
SYNTH = {"rev": 0.5, "liq": -0.2, "vol": 0.3}


def steps(s, d):
    b, f = inputs(s, d)
    return portfolio.walk(portfolio.tradable_panel(b, f))


#: The walk as a recursion over dates; held is a map of weights, g a date's rows, f the weights before they are made to sum to 1.
HELD = f"""WITH RECURSIVE {BARS}, {FACTOR},
r0 AS (SELECT symbol, date, lead(ret) OVER s AS fwd_ret, coalesce(lead(volume) OVER s > 0 AND lead(amount) OVER s >= 0, FALSE) AS can FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
p0 AS (SELECT * FROM r0 JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
p1 AS (SELECT *, can AND row_number() OVER (PARTITION BY date, can ORDER BY factor DESC, symbol) <= greatest(1, ceil(count(*) OVER (PARTITION BY date, can) * 0.1::DOUBLE)) AS chosen FROM p0),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS k, lead(date) OVER (ORDER BY date) AS trade, list({{'s': symbol, 'r': fwd_ret, 'can': can, 'chosen': chosen}} ORDER BY symbol) AS g
  FROM p1 WHERE symbol IN (SELECT symbol FROM p1 WHERE chosen) GROUP BY date),
walk AS (
  SELECT 0::BIGINT AS k, NULL::DATE AS date, MAP([]::VARCHAR[], []::DOUBLE[]) AS held, 0::DOUBLE AS gross, 0::DOUBLE AS turnover, 0::DOUBLE AS sells, 0::BIGINT AS holdings
  UNION ALL
  SELECT k, trade, fresh, coalesce(list_sum(list_transform(g, lambda x: coalesce(held[x.s], 0) * x.r)), 0),
    0.5 * coalesce(list_sum(list_transform(list_distinct(list_concat(map_keys(held), map_keys(fresh))), lambda s: abs(coalesce(fresh[s], 0) - coalesce(held[s], 0)))), 0),
    coalesce(list_sum(list_transform(map_keys(held), lambda s: greatest(0, held[s] - coalesce(fresh[s], 0)))), 0), len(list_filter(map_values(fresh), lambda w: w > 0))
  FROM (SELECT *, CASE WHEN whole > 0 THEN map_from_entries(list_transform(f1, lambda y: {{'k': y.s, 'v': y.w / whole}})) ELSE held END AS fresh
    FROM (SELECT *, coalesce(list_sum(list_transform(f1, lambda y: y.w)), 0) AS whole
      FROM (SELECT *, CASE WHEN len(f0) > 0 THEN f0 ELSE list_filter(list_transform(g, lambda x: {{'s': x.s, 'w': held[x.s]}}), lambda y: y.w > 0) END AS f1
        FROM (SELECT days.k, trade, g, held, list_filter(list_transform(g, lambda x: {{'s': x.s, 'w': CASE WHEN NOT x.can THEN CASE WHEN held[x.s] > 0 THEN held[x.s] END
            WHEN x.chosen THEN CASE WHEN x.r < 0.095 - 1e-6 THEN 1.0::DOUBLE END WHEN held[x.s] > 0 AND x.r <= -0.095 + 1e-6 THEN held[x.s] END}}), lambda y: y.w IS NOT NULL) AS f0
          FROM walk JOIN days ON days.k = walk.k + 1 WHERE trade IS NOT NULL))))),
steps AS (SELECT date, gross, turnover, sells, holdings FROM walk WHERE k > 0)"""
HELD_STATS = f"""{HELD}, n AS (SELECT *, gross - (turnover * 0.0003 * 2 + sells * 0.0005) AS net FROM steps),
e AS (SELECT *, list_product(list(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM n), d AS (SELECT *, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT round(avg(net) * 252, 6) + 0 AS ann_return, round(stddev_samp(net) * sqrt(252), 6) AS ann_volatility, round((avg(net) * 252 - 0.03) / (stddev_samp(net) * sqrt(252)), 6) + 0 AS sharpe, count(*) AS n_rebalances,
  round(avg(turnover), 6) AS avg_turnover, round(min(dd), 6) + 0 AS max_drawdown, round(arg_max(equity, date) / arg_min(equity, date) - 1, 6) + 0 AS cum_return FROM d"""
COSTS = f"""{HELD}, c AS (SELECT mode AS cost_mode, commission::DOUBLE AS commission, turnover, gross - turnover * commission::DOUBLE * sides - sells * 0.0005 AS net
  FROM steps, (VALUES ('one_side', 1), ('two_side', 2)) AS m(mode, sides), (VALUES (0.0001), (0.0003), (0.0005)) AS k(commission))
SELECT cost_mode, commission, round(avg(net) * 252, 6) + 0 AS ann_return, round((avg(net) * 252 - 0.03) / (stddev_samp(net) * sqrt(252)), 6) + 0 AS sharpe, round(avg(turnover), 6) AS avg_turnover FROM c GROUP BY cost_mode, commission"""


IDX = f"""{BARS}, grid AS (SELECT date, symbol FROM (SELECT DISTINCT date FROM bars), (SELECT DISTINCT symbol FROM bars)),
filled AS (SELECT date, symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM grid LEFT JOIN bars USING (date, symbol)),
r AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS r FROM filled)"""


def index_sql(returns: str) -> str:
    return f"""{IDX}, p AS ({returns}), e AS (SELECT date, list_product(list(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM p),
idx AS (SELECT date, equity / first_value(equity) OVER (ORDER BY date) * 1000 AS index_value FROM e)"""


EQUAL_INDEX = index_sql("SELECT date, sum(r) / (SELECT count(DISTINCT symbol) FROM bars) AS ret FROM r GROUP BY date")
CUSTOM_INDEX = index_sql("SELECT date, sum(r * (symbol::INT % 3) / (SELECT sum(s_suppkey % 3) FROM supplier)) AS ret FROM r GROUP BY date")


def custom_weights(s, d):
    return source.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), (F.col("s_suppkey") % 3).cast("double").alias("weight"))


STATS = """, q AS (SELECT date, index_value, index_value / lag(index_value) OVER (ORDER BY date) - 1 AS r, index_value / max(index_value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM idx),
z AS (SELECT arg_max(index_value, date) / arg_min(index_value, date) - 1 AS whole, count(r) AS n, stddev_pop(r) * sqrt(252) AS vol, min(dd) AS dd FROM q)
SELECT round(whole * 100, 2) AS total_return, round((pow(1 + whole, 252.0 / n) - 1) * 100, 2) AS annualized_return, round(vol * 100, 2) AS volatility, round(dd * 100, 2) AS max_drawdown, round((pow(1 + whole, 252.0 / n) - 1) / vol, 2) AS sharpe FROM z"""

FUSE = f"""{WIDE}, a AS (SELECT symbol, date, rev AS factor FROM w WHERE rev IS NOT NULL), b AS (SELECT symbol, date, vol AS factor FROM w WHERE vol IS NOT NULL),
m AS (SELECT symbol, date, coalesce(a.factor, 0) AS a, coalesce(b.factor, 0) AS b FROM a FULL JOIN b USING (symbol, date))"""


def fuse(method, **more):
    def run(s, d):
        _, w = wide(s, d)
        frames = {n: w.select("symbol", "date", F.col(n).alias("factor")).na.drop(subset=["factor"]) for n in ("rev", "vol")}
        return rounded(combine.fuse(frames, method, **more), 8)

    return run


CORR = f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, round(corr({a}, {b}), 6) + 0 AS rho FROM w" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]
)

WALK = f"""WITH {BARS}, {FACTOR}, ds AS (SELECT date, count(*) OVER () AS n, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)),
bl AS (SELECT date, CASE WHEN pos >= floor(n * 4 / 5) THEN 4 WHEN pos >= floor(n * 3 / 5) THEN 3 WHEN pos >= floor(n * 2 / 5) THEN 2 WHEN pos >= floor(n / 5) THEN 1 ELSE 0 END::INT AS block FROM ds),
r0 AS (SELECT symbol, date, block, close / lag(close) OVER (PARTITION BY block, symbol ORDER BY date) - 1 AS ret FROM bars JOIN bl USING (date)),
r1 AS (SELECT symbol, date, block, lead(ret) OVER (PARTITION BY block, symbol ORDER BY date) AS fwd_ret FROM r0),
panel AS (SELECT * FROM r1 JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL) {summary_sql(ic_sql(keys='block, date'), 'block')}"""

STABLE = f"""WITH {BARS}, {FACTOR}, fw AS ({' UNION ALL '.join(f"SELECT symbol, date, {h} AS horizon, lead(ret, {h}) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars" for h in (1, 2, 3, 5, 10))}),
panel AS (SELECT * FROM fw JOIN f USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
h AS (SELECT horizon, avg(ic) / stddev_samp(ic) AS icir FROM {ic_sql(keys='horizon, date')} GROUP BY horizon)
SELECT round(stddev_pop(icir), 6) AS icir_std, round(min(icir), 6) + 0 AS icir_min, round(avg(icir), 6) + 0 AS icir_mean, min(icir) > 0 AS stable FROM h"""

SPLIT = f"""WITH {BARS}, {FACTOR}, ds AS (SELECT date, CASE WHEN percent_rank() OVER (ORDER BY date) < 1 - 0.2 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT date FROM bars)),
fw AS (SELECT symbol, date, lead(ret, 1) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),
panel AS (SELECT * FROM fw JOIN f USING (symbol, date) JOIN ds USING (date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL) {summary_sql(ic_sql(keys='split, date'), 'split')}"""

RANK = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date) END"
STYLE = f"""WITH {BARS}, {DIMS_SQL}, {FACTOR}, j AS (SELECT bars.symbol, bars.date, ret, factor, mkt_cap FROM bars JOIN f USING (symbol, date) LEFT JOIN dims USING (symbol)),
k AS (SELECT *, CASE WHEN count(ret) OVER x = 20 THEN list_product(list(1 + ret) OVER x) - 1 END AS momentum, CASE WHEN count(ret) OVER x = 20 THEN stddev_samp(ret) OVER x END AS volatility,
  {RANK.format('mkt_cap')} AS size, {RANK.format('factor')} AS fr FROM j WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
l AS (SELECT date, fr, 'size' AS style, size AS v FROM k UNION ALL SELECT date, fr, 'momentum', momentum FROM k UNION ALL SELECT date, fr, 'volatility', volatility FROM k),
c AS (SELECT style, date, CASE WHEN min(v) < max(v) AND min(fr) < max(fr) THEN corr(v, fr) END AS c FROM l WHERE v IS NOT NULL AND fr IS NOT NULL GROUP BY style, date HAVING count(*) >= 10)
SELECT style, round(avg(c), 6) + 0 AS exposure FROM c GROUP BY style"""


def style(s, d):
    b, f = inputs(s, d)
    return rounded(robust.style_exposure(b, f, source.dimensions(s, d)))


INDUSTRY = f"""WITH {BARS}, {DIMS_SQL}, {FACTOR}, r AS (SELECT symbol, {RANK.format('factor')} AS r FROM f), g AS (SELECT industry, avg(r) AS m FROM r JOIN dims USING (symbol) GROUP BY industry)
SELECT industry, round(m, 6) AS mean_rank, round(max(m) OVER () - min(m) OVER (), 6) AS max_bias, max(m) OVER () - min(m) OVER () <= 0.1 AS neutral FROM g"""


def zoo(s, d):
    b = source.saved(s, d)
    w = x.columns(b, {"factor0": TREE, **factors.ZOO})
    return rounded(robust.compare_to_zoo(b, w, "factor0", list(factors.ZOO)), 6)


def zoo_sql() -> str:
    """The residual on the zoo by taking out one factor after another, each from all that are left, as the regression on all would."""
    names = list(factors.ZOO)
    every = ["factor0", *names]
    text = f"WITH {BARS}, w AS (WITH {x.sql('bars', {'factor0': TREE, **factors.ZOO})}), fw AS (SELECT symbol, date, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),\n"
    text += f"s0 AS (SELECT symbol, date, {', '.join(f'{n} - avg({n}) OVER () AS {n}' for n in every)} FROM w WHERE {' AND '.join(f'{n} IS NOT NULL' for n in every)})"
    for i, z in enumerate(names):
        left = ["factor0", *names[i + 1 :]]
        cells = ", ".join(f"{v} - coalesce(sum({v} * {z}) OVER () / nullif(sum({z} * {z}) OVER (), 0), 0) * {z} AS {v}" for v in left)
        text += f",\ns{i + 1} AS (SELECT symbol, date, {cells} FROM s{i})"
    rows = " UNION ALL ".join([*[f"SELECT symbol, date, '{n}' AS factor_name, {n} AS factor FROM w" for n in every], f"SELECT symbol, date, 'rest', factor0 FROM s{len(names)}"])
    text += f""",
panel AS (SELECT * FROM ({rows}) JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
g AS (SELECT factor_name, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM {ic_sql('panel', 'factor_name, date')} GROUP BY factor_name),
t AS (SELECT max(icir) FILTER (factor_name NOT IN ('factor0', 'rest')) AS z, max(icir) FILTER (factor_name = 'factor0') AS f, max(icir) FILTER (factor_name = 'rest') AS r FROM g)
SELECT round(z, 6) + 0 AS max_zoo_icir, round(f, 6) + 0 AS composite_icir, round(r, 6) + 0 AS incremental_icir, r > 0 AND r > 0.5 * f AS adds FROM t"""
    return text


def blended(s, d):
    import numpy as np

    _, w = wide(s, d)
    return rounded(combine.blend(w, NAMES, np.array([0.5, 0.2, 0.3])), 6)


BLEND = f"""WITH {WIDE}, r AS (SELECT symbol, date, coalesce(rev, 0) AS rev, coalesce(liq, 0) AS liq, coalesce(vol, 0) AS vol FROM w),
a AS (SELECT *, rev / (SELECT sqrt(sum(rev * rev)) + 1e-12 FROM r) AS q1 FROM r),
b AS (SELECT *, liq - (SELECT sum(q1 * liq) / (sum(q1 * q1) + 1e-12) FROM a) * q1 AS v2 FROM a),
c AS (SELECT *, v2 / (SELECT sqrt(sum(v2 * v2)) + 1e-12 FROM b) AS q2 FROM b),
e AS (SELECT *, vol - (SELECT sum(q1 * vol) / (sum(q1 * q1) + 1e-12) FROM c) * q1 - (SELECT sum(q2 * vol) / (sum(q2 * q2) + 1e-12) FROM c) * q2 AS v3 FROM c),
k AS (SELECT symbol, date, 0.5 * q1 + 0.2 * q2 + 0.3 * v3 / (SELECT sqrt(sum(v3 * v3)) + 1e-12 FROM e) AS v FROM e)
SELECT symbol, date, round({RANK.format('v')}, 6) AS factor FROM k"""


def screened(s, d):
    b, w = wide(s, d)
    return rounded(combine.screen_by_return(w.join(b.select("symbol", "date", "ret"), ["symbol", "date"]), NAMES, "ret"))


SCREEN = f"""WITH {WIDE}, j AS (SELECT w.*, ret FROM w JOIN bars USING (symbol, date)), s AS ({' UNION ALL '.join(f"SELECT '{n}' AS name, abs(corr({n}, ret)) AS score FROM j" for n in NAMES)})
SELECT name, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, name) <= 3 AS keep FROM s"""

_ALL = {
    "portfolio_walk": (lambda s, d: rounded(steps(s, d)), f"{HELD} SELECT date, round(gross, 6) + 0 AS gross, round(turnover, 6) AS turnover, round(sells, 6) AS sells, holdings FROM steps"),
    "portfolio_stats": (lambda s, d: rounded(portfolio.portfolio_stats(portfolio.costed(steps(s, d)))), HELD_STATS),
    "cost_sensitivity": (lambda s, d: rounded(portfolio.cost_grid(steps(s, d)), but=("commission",)), COSTS),
    "custom_index_equal": (lambda s, d: rounded(portfolio.index_levels(portfolio.index_returns(source.saved(s, d))), 4), f"WITH {EQUAL_INDEX} SELECT date, round(index_value, 4) AS index_value FROM idx"),
    "custom_index_custom": (lambda s, d: rounded(portfolio.index_levels(portfolio.index_returns(source.saved(s, d), custom_weights(s, d))), 4), f"WITH {CUSTOM_INDEX} SELECT date, round(index_value, 4) AS index_value FROM idx"),
    "custom_index_price": (
        lambda s, d: rounded(portfolio.price_index(source.saved(s, d)), 4),
        f"WITH {IDX}, p AS (SELECT date, sum(close) AS s FROM filled GROUP BY date) SELECT date, round(s / first_value(s) OVER (ORDER BY date) * 1000, 4) AS index_value FROM p",
    ),
    "index_stats": (lambda s, d: portfolio.index_stats(portfolio.index_levels(portfolio.index_returns(source.saved(s, d)))), f"WITH {EQUAL_INDEX}{STATS}"),
    "rebased_series": (
        lambda s, d: rounded(portfolio.rebased(source.saved(s, d).select("symbol", "date", F.col("close").alias("index_value")), "symbol")),
        f"WITH {BARS} SELECT symbol, date, round((close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100, 6) + 0 AS change FROM bars",
    ),
    "ic_weighted_combine": (
        lambda s, d: rounded(combine.ic_weighted(wide(s, d)[1], {"rev": 0.04, "liq": -0.02, "vol": 0.001})),
        f"WITH {WIDE} SELECT symbol, date, round(coalesce({Z['rev']}, 0) * (0.04 / 0.06) + coalesce({Z['liq']}, 0) * (0.02 / 0.06), 6) + 0 AS factor FROM w",
    ),
    "synthesize_renormalised": (
        lambda s, d: rounded(combine.synthesize(wide(s, d)[1], SYNTH)),
        f"""WITH {WIDE}, h AS (SELECT *, CASE WHEN rev IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN liq IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN vol IS NOT NULL THEN 0.3 ELSE 0 END AS have FROM w)
SELECT symbol, date, round(CASE WHEN have >= 0.3 THEN (coalesce(rev, 0) * 0.5 - coalesce(liq, 0) * 0.2 + coalesce(vol, 0) * 0.3) / have END, 6) + 0 AS factor FROM h""",
    ),
    "blend_orthogonal": (blended, BLEND),
    "factor_correlation": (lambda s, d: rounded(combine.correlation_pairs(wide(s, d)[1], NAMES)), CORR),
    "redundant_pairs": (
        lambda s, d: rounded(combine.redundant(combine.correlation_pairs(wide(s, d)[1], NAMES), 0.01)),
        f"SELECT * FROM ({CORR}) WHERE abs(rho) >= 0.01 ORDER BY abs(rho) DESC, a, b LIMIT 12",
    ),
    "screen_by_return": (screened, SCREEN),
    "fuse_mean": (fuse("mean"), f"WITH {FUSE} SELECT symbol, date, round((a + b) / 2, 8) + 0 AS factor FROM m"),
    "fuse_weighted": (fuse("weighted", weights={"rev": 3.0, "vol": 1.0}), f"WITH {FUSE} SELECT symbol, date, round((a * 3 + b) / 4, 8) + 0 AS factor FROM m"),
    "fuse_ranked": (
        fuse("ranked"),
        f"WITH {FUSE}, r AS (SELECT symbol, date, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS rb FROM m) SELECT symbol, date, round((ra + rb) / 2, 8) + 0 AS factor FROM r",
    ),
    "fuse_orthogonalized": (
        fuse("orthogonalized"),
        f"WITH {FUSE}, g AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i FROM m) SELECT symbol, date, round((a + (b - s * a - i)) / 2, 8) + 0 AS factor FROM m, g",
    ),
    "walk_forward": (lambda s, d: rounded(robust.walk_forward(*inputs(s, d)), 8), WALK),
    "parameter_stability": (lambda s, d: rounded(robust.parameter_stability(*inputs(s, d))), STABLE),
    "train_test_split": (lambda s, d: rounded(robust.train_test(*inputs(s, d)), 8), SPLIT),
    "style_exposure": (style, STYLE),
    "industry_exposure": (lambda s, d: rounded(robust.industry_exposure(inputs(s, d)[1], source.dimensions(s, d))), INDUSTRY),
    "zoo_comparison": (zoo, zoo_sql()),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
