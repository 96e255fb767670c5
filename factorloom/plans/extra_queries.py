"""Queries of screening, user factors, monitors and parsers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import combine, encode, factors, robust, store, text, udf
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source
from factorloom.sources.bars import table

from .base import DIMS_SQL, bars_sql, rounded
from .combine_queries import NAMES, THREE, wide
from .eval_queries import LS, PANEL, ic_sql, panel
from .misc_queries import NEGATIVE, POSITIVE, sql_occ

BARS = bars_sql()


def lasso(s, d):
    b, w = wide(s, d)
    rows = combine.lasso_screen(w.join(b.select("symbol", "date", "ret"), ["symbol", "date"]), NAMES, "ret")
    return rounded(s.createDataFrame(rows, "name string, coefficient double, keep boolean"), 6)


def in_turn(s, d):
    return rounded(combine.orthogonalize_in_turn(wide(s, d)[1], NAMES), 6)


TURN = f"""WITH {BARS}, w AS (WITH {x.sql('bars', THREE)}),
a AS (SELECT *, CASE WHEN rev IS NOT NULL AND liq IS NOT NULL THEN liq END AS y, CASE WHEN rev IS NOT NULL AND liq IS NOT NULL THEN rev END AS x FROM w)
SELECT symbol, date, round(CASE WHEN count(y) OVER d >= 5 THEN y - regr_slope(y, x) OVER d * x - regr_intercept(y, x) OVER d END, 6) + 0 AS liq_orth FROM a WINDOW d AS (PARTITION BY date)"""


IN_TURN = f"""WITH {BARS}, w AS (WITH {x.sql('bars', THREE)}),
a AS (SELECT *, CASE WHEN rev IS NOT NULL AND liq IS NOT NULL THEN liq END AS y2, CASE WHEN rev IS NOT NULL AND liq IS NOT NULL THEN rev END AS x2, rev IS NOT NULL AND liq IS NOT NULL AND vol IS NOT NULL AS ok FROM w),
b AS (SELECT *, CASE WHEN ok THEN rev END AS x, CASE WHEN ok THEN liq END AS y, CASE WHEN ok THEN vol END AS z FROM a),
c AS (SELECT *, y - regr_slope(y, x) OVER d * x - regr_intercept(y, x) OVER d AS ry, z - regr_slope(z, x) OVER d * x - regr_intercept(z, x) OVER d AS rz FROM b WINDOW d AS (PARTITION BY date))
SELECT symbol, date, round(rev, 6) + 0 AS rev_orth, round(CASE WHEN count(y2) OVER d >= 5 THEN y2 - regr_slope(y2, x2) OVER d * x2 - regr_intercept(y2, x2) OVER d END, 6) + 0 AS liq_orth,
  round(CASE WHEN count(z) OVER d >= 5 THEN rz - coalesce(sum(ry * rz) OVER d / nullif(sum(ry * ry) OVER d, 0), 0) * ry END, 6) + 0 AS vol_orth FROM c WINDOW d AS (PARTITION BY date)"""


def spread(pdf):
    """A user factor: the last bar's range over its close."""
    return ((pdf.high - pdf.low) / pdf.close).shift(1)


def centred(pdf):
    """A user factor: the close less the mean of the date's, summed without rounding so that the order of rows doesn't matter."""
    import math

    return pdf.close - math.fsum(pdf.close) / len(pdf)


def linted(s, d):
    """Findings of the lint in factors made of the parts: shifts from -24 to 25, every seventh also with a later return, every fifth with a bare price."""
    p = source.dealt(s, d, "part", "p_partkey")
    body = F.concat(
        F.lit("def f(df):\n    return df.close.shift("), (F.col("p_size") - 25).cast("string"), F.lit(")"), F.when(F.col("p_partkey") % 7 == 0, " + df.fwd_ret").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, " * df.high").otherwise("")
    )
    return p.select("p_partkey", F.size(udf.findings(body)).alias("n"))


SERIES = f"""WITH {BARS}, a AS (SELECT symbol, date, ret AS v, row_number() OVER o - 1 AS i, max(ret) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS top, pow(ret - lag(ret) OVER o, 2) AS d2,
  {', '.join(f'lag(ret, {k}) OVER o AS l{k}' for k in encode.LAGS)} FROM bars WHERE ret IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY date)),
g AS (SELECT symbol, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, {', '.join(f'quantile_cont(v, {q / 100}) AS p{q}' for q in (5, 10, 25, 50, 75, 90, 95))} FROM a GROUP BY symbol),
b AS (SELECT a.*, n, m, s, p10, p25, p75, p90, (v - m) / (s + 1e-8) AS z, lag(d2) OVER (PARTITION BY a.symbol ORDER BY date) AS e2 FROM a JOIN g ON a.symbol = g.symbol),
f AS (SELECT symbol, max(n) AS n, avg(v) AS mean, stddev_pop(v) AS sd, median(v) AS median, min(v) AS low, max(v) AS high, max(v) - min(v) AS spread, avg(z * z * z) AS skew, avg(z * z * z * z) AS kurt, regr_slope(v, i) AS slope,
  arg_max(v, date) / nullif(arg_min(v, date) + 1e-8, 0) - 1 AS change, max(1 - v / nullif(top, 0)) AS max_drawdown, {', '.join(f'quantile_cont(v, {q}) AS q{int(q * 100):02d}' for q in encode.QUANTILES)},
  {', '.join(f'corr(l{k}, v) AS acf{k}' for k in encode.LAGS)}, avg((v > p90)::INT) AS above_p90, avg((v < p10)::INT) AS below_p10, avg((abs(v) > 1e-8)::INT) AS nonzero,
  avg(v) FILTER (v >= p75) AS top_mean, avg(v) FILTER (v <= p25) AS bottom_mean, corr(e2, d2) AS arch, 0.0 AS pad FROM b GROUP BY symbol),
c AS (SELECT symbol, k.size, i // k.size AS chunk, max(v) - min(v) AS r, stddev_pop(v) AS sd FROM b, (VALUES (5), (10), (20)) AS k(size) WHERE 2 * k.size <= n AND (i // k.size) * k.size < n - k.size GROUP BY ALL),
h AS (SELECT symbol, avg(rs) AS rescaled_range FROM (SELECT symbol, size, avg(r / sd) AS rs FROM c WHERE sd > 1e-8 GROUP BY ALL) GROUP BY symbol)
SELECT symbol, {', '.join(f"round(CASE WHEN n >= 10 THEN coalesce({c}, {'0.5' if c == 'rescaled_range' else '0'}) ELSE 0 END, 6) + 0 AS {c}" for c in encode.NAMES)} FROM f LEFT JOIN h USING (symbol)"""


def modes(s, d):
    """Side data of suppliers by month as factors: net flow of lines, balance, mean discount."""
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"), "l_quantity", "l_returnflag", "l_discount")
    side = lines.groupBy("symbol", "date").agg(
        F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(0.0)).alias("flow"), F.avg("l_discount").alias("yield")
    )
    side = side.join(source.dimensions(s, d).select("symbol", "mkt_cap"), "symbol", "left")
    b = source.saved(s, d)
    out = None
    for name, value, log in (("flow", "flow", False), ("valuation", "mkt_cap", True), ("yield", "yield", False)):
        one = encode.modal(b, side, value, log).select(F.lit(name).alias("mode"), "symbol", "date", "factor")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


MODES = f"""WITH {BARS}, {DIMS_SQL}, s AS (SELECT l_suppkey::VARCHAR AS symbol, date_trunc('month', l_shipdate)::DATE AS date, sum(CASE l_returnflag WHEN 'N' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS flow, avg(l_discount) AS yld FROM lineitem GROUP BY ALL),
j AS (SELECT symbol, date, flow, yld, ln(1 + greatest(mkt_cap, 0)) AS cap FROM bars JOIN s USING (symbol, date) LEFT JOIN dims USING (symbol)),
u AS (SELECT 'flow' AS mode, symbol, date, flow AS v FROM j UNION ALL SELECT 'valuation', symbol, date, cap FROM j UNION ALL SELECT 'yield', symbol, date, yld FROM j),
z AS (SELECT mode, symbol, date, (v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-12) AS factor FROM u WINDOW w AS (PARTITION BY mode, date))
SELECT mode, symbol, date, round(factor, 6) + 0 AS factor FROM z WHERE factor IS NOT NULL"""


def deflated(s, d):
    row = ev.long_short_stats(ev.long_short(ev.grouped(panel(s, d)))).first()
    n = panel(s, d).select("date").distinct().count()
    walk = robust.walk_forward(source.saved(s, d), panel(s, d).select("symbol", "date", "factor")).agg(F.avg("icir")).first()[0]
    dsr = robust.deflated_sharpe(row["sharpe"] or 0.0, n, 10)
    return rounded(s.createDataFrame([(float(row["sharpe"] or 0.0), n, float(dsr), robust.verdict(walk or 0.0, dsr, False))], "sharpe double, n int, dsr double, verdict string"))


#: The normal distribution by its series around 0; the quantile is that of 0.9, for ten trials. Nothing passes that isn't stable.
DEFLATED = f"""WITH RECURSIVE {LS}, s AS (SELECT coalesce(avg(ls) * sqrt(252) / nullif(stddev_samp(ls), 0), 0) AS sharpe FROM ls), n AS (SELECT count(DISTINCT date)::INT AS n FROM panel),
z AS (SELECT sharpe, n, (sharpe - {NormalDist().inv_cdf(0.9)!r}::DOUBLE / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 + sharpe * sharpe / 2)) AS z FROM s, n),
t AS (SELECT 0 AS k, z AS term, z AS total FROM z UNION ALL SELECT k + 1, term * z * z / (2 * k + 3), total + term * z * z / (2 * k + 3) FROM t, z WHERE k < 600)
SELECT round(sharpe, 6) + 0 AS sharpe, n, round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * total, 6) + 0 AS dsr, 'FAIL' AS verdict FROM z, t WHERE k = 600"""


def monitored(s, d):
    p = table(s, d, "part")
    return rounded(store.learned_monitor(p.select(F.col("p_brand").alias("category"), ((F.col("p_size") - 25) / 500).alias("ic"))))


def news(s, d):
    c = table(s, d, "conversations").select(F.col("role").alias("symbol"), F.col("turn").alias("date"), "text")
    return rounded(text.daily_sentiment(c, POSITIVE, NEGATIVE))


def sft(s, d):
    c = table(s, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("code"))
    return text.instructions(c)


_ALL = {
    "lasso_screen": (lasso, None),
    "orthogonalize_in_turn": (in_turn, IN_TURN),
    "orthogonalize_second": (lambda s, d: in_turn(s, d).select("symbol", "date", "liq_orth"), TURN),
    "user_factor_over_time": (
        lambda s, d: rounded(udf.over_time(source.saved(s, d), spread)),
        f"WITH {BARS} SELECT symbol, date, round(lag((high - low) / close) OVER (PARTITION BY symbol ORDER BY date), 6) + 0 AS factor FROM bars",
    ),
    "user_factor_across": (lambda s, d: rounded(udf.across(source.saved(s, d), centred), 4), f"WITH {BARS} SELECT symbol, date, round(close - fsum(close) OVER (PARTITION BY date) / count(*) OVER (PARTITION BY date), 4) + 0 AS factor FROM bars"),
    "metric_registry": (
        lambda s, d: rounded(udf.measured(ev.ic_series(panel(s, d)))),
        f"WITH {PANEL}, i AS (SELECT * FROM {ic_sql()}) SELECT round(avg(ic) / stddev_samp(ic) * avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) + 0 AS stability, round(min(ic), 6) + 0 AS worst FROM i",
    ),
    "deflated_sharpe": (deflated, DEFLATED),
    "series_features": (lambda s, d: rounded(encode.series_features(source.saved(s, d), "symbol", "ret")), SERIES),
    "modal_factors": (modes, MODES),
    "lint_findings": (
        linted,
        "SELECT p_partkey, (p_size <= 25)::INT + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM part",
    ),
    "learned_monitor": (
        monitored,
        "SELECT p_brand AS category, count(*) AS n, round(avg(abs((p_size - 25) / 500.0)), 6) AS mean_abs_ic, sum((abs((p_size - 25) / 500.0) < 0.02)::INT)::BIGINT AS weak FROM part GROUP BY p_brand",
    ),
    "daily_sentiment": (
        news,
        f"WITH c AS (SELECT role AS symbol, turn AS date, lower(coalesce(text, '')) AS t FROM conversations), h AS (SELECT symbol, date, {sql_occ(POSITIVE)} AS p, {sql_occ(NEGATIVE)} AS n FROM c) SELECT symbol, date, round(avg(coalesce((p - n) / nullif(p + n, 0), 0)), 6) + 0 AS sentiment, count(*) AS n FROM h GROUP BY symbol, date",
    ),
    "instruction_records": (sft, "SELECT 'Write the factor ' || p_name AS instruction, p_type AS input, p_brand AS output FROM part WHERE p_size > 10"),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
