"""Queries of event-focused fitness, production of trees and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import factors, production, tuning
from factorloom.sources import bars as source

from .base import bars_sql, rounded
from .eval_queries import ic_sql, inputs

BARS = bars_sql()
TREES = {"momentum": x.total(factors.P, 5), "volume": x.mean(factors.V, 5), "spread": (x.col("high") - x.col("low")) / x.col("close")}
SPANS = [("first", "1996-01-01", "1997-06-30", 2.0), ("second", "1997-01-01", "1998-12-31", 0.5), ("third", "2000-01-01", "2000-12-31", 1.5)]


def windows(s):
    return s.createDataFrame(SPANS, "window string, start string, end string, weight double").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def focused(s, d):
    return rounded(production.focused(source.saved(s, d), TREES, windows(s)), 8)


FOCUSED = f"""WITH {BARS}, w AS (WITH {x.sql('bars', {k: x.lag(t) for k, t in TREES.items()})}),
fw AS (SELECT symbol, date, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),
u AS ({' UNION ALL '.join(f"SELECT symbol, date, '{n}' AS factor_name, {n} AS factor FROM w" for n in TREES)}),
panel AS (SELECT * FROM u JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
i AS (SELECT * FROM {ic_sql('panel', 'factor_name, date')}),
e AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{a}', DATE '{b}', {w}::DOUBLE)" for _, a, b, w in SPANS)}) AS v(a, b, weight)),
k AS (SELECT date, product(weight) AS weight FROM (SELECT DISTINCT date FROM bars), e WHERE date BETWEEN a AND b GROUP BY date)
SELECT factor_name, round(sum(ic * weight) / sum(weight), 8) + 0 AS ic, count(*) AS n_dates FROM i JOIN k USING (date) GROUP BY factor_name"""


def produced(s, d):
    """Trees grown from the library's first factors of three categories, within the windows."""
    clusters = {c: list(factors.by_category(c).values())[:3] for c in ("trend", "volatility", "trading")}
    return rounded(production.produced(source.saved(s, d), clusters, windows(s), population=5, generations=1, per_cluster=2))


def tuned(s, d):
    """Trials of ways to test a factor, best first."""
    b, f = inputs(s, d)
    found = tuning.search(tuning.BACKTEST, lambda some: tuning.backtest_scores(b, f, some), trials=16, batch=8, startup=8)
    rows = [(i + 1, int(p["groups"]), int(p["ahead"]), float(p["cut"]), float(v)) for i, (p, v) in enumerate(found)]
    return rounded(s.createDataFrame(rows, "place int, groups int, ahead int, cut double, score double"))


QUERIES = {"event_fitness": focused, "tree_production": produced, "tuned_backtest": tuned}
ORACLE_SQL = {"event_fitness": FOCUSED}
