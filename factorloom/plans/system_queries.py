"""Queries of factor systems, searches and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.cross import rank_pct
from factorloom.operators import combine, factors, search, system
from factorloom.operators import evaluate as ev
from factorloom.operators.combine import correlation_pairs, principal
from factorloom.sources import bars as source
from factorloom.streaming import bars as stream

from .base import bars_sql, rounded
from .eval_queries import FACTOR, ic_sql, inputs, summary_sql

BARS = bars_sql()
NAMES = ["amihud_illiquidity_20d", "bollinger_pct_20d", "momentum_5d", "realized_vol_5d", "turnover_5d"]
SIGN = {n: "-1" if factors.LIBRARY[n].direction == "negative" else "1" for n in NAMES}


def z_sql(n: str) -> str:
    v = f"({SIGN[n]} * {n})"
    return f"CASE WHEN {n} IS NOT NULL AND stddev_samp({v}) OVER (PARTITION BY date) > 0 THEN greatest(-3.0, least(3.0, ({v} - avg({v}) OVER (PARTITION BY date)) / stddev_samp({v}) OVER (PARTITION BY date))) END"


WIDE = f"{BARS}, w AS (WITH {x.sql('bars', {n: factors.LIBRARY[n].tree for n in NAMES})}), z AS (SELECT symbol, date, {', '.join(f'{z_sql(n)} AS {n}' for n in NAMES)} FROM w)"


FORWARD = "fw AS (SELECT symbol, date, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars)"
LONG = f"long AS ({' UNION ALL '.join(f"SELECT '{n}' AS factor_name, symbol, date, {n} AS factor FROM z" for n in NAMES)})"


def panel_of(relation: str) -> str:
    return f"panel AS (SELECT * FROM {relation} JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL)"


SINGLE = f"WITH {WIDE}, {FORWARD}, {LONG}, {panel_of('long')} {summary_sql(ic_sql(keys='factor_name, date'), 'factor_name')}"
COMPOSITE = f"""WITH {WIDE}, {FORWARD}, h AS (SELECT symbol, date, {' + '.join(f'0.2 * ({n} IS NOT NULL)::INT' for n in NAMES)} AS have, {' + '.join(f'0.2 * coalesce({n}, 0)' for n in NAMES)} AS v FROM z),
comp AS (SELECT symbol, date, CASE WHEN have >= 0.3 THEN v / have END AS factor FROM h), {panel_of('comp')} {summary_sql(ic_sql())}"""
DIMENSIONS = f"""SELECT dimension, count(*) AS n, round(sum(0.2::DOUBLE), 6) AS weight, round(avg(quality), 6) AS mean_quality, string_agg(name, '|' ORDER BY name) AS names
FROM (VALUES {', '.join(f"('{n}', '{factors.LIBRARY[n].category}', {factors.LIBRARY[n].quality}::DOUBLE)" for n in NAMES)}) AS c(name, dimension, quality) GROUP BY dimension"""
DIVERSIFIED = f"""WITH {WIDE}, {FORWARD}, {LONG}, one AS (SELECT * FROM long JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
i AS (SELECT factor_name, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM {ic_sql('one', 'factor_name, date')} GROUP BY factor_name),
o AS (SELECT factor_name, row_number() OVER (ORDER BY abs(coalesce(icir, 0)) DESC, factor_name) AS place FROM i),
c AS (SELECT k.n, symbol, date, sum(CASE WHEN place <= k.n THEN coalesce(factor, 0) ELSE 0 END) / k.n AS factor FROM long JOIN o USING (factor_name), (VALUES (1), (2), (3), (4), (5)) AS k(n) GROUP BY k.n, symbol, date),
{panel_of('c')} SELECT n, ic, icir FROM ({summary_sql(ic_sql(keys='n, date'), 'n')})"""
GRID = f"""WITH {BARS}, {FORWARD}, t AS ({' UNION ALL '.join(f"SELECT {n} AS n, symbol, date, CASE WHEN count(pct_chg) OVER w >= {n} THEN -sum(pct_chg) OVER w END AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (1, 2, 3, 5, 10))}),
g AS (SELECT n, symbol, date, lag(v) OVER (PARTITION BY n, symbol ORDER BY date) AS factor FROM t), {panel_of('g')}
SELECT n, round(abs(avg(ic) / stddev_samp(ic)), 8) AS icir FROM {ic_sql(keys='n, date')} GROUP BY n"""
PLANTED = f"""WITH {BARS}, u AS (SELECT symbol, date, ('0x' || substr(md5(symbol), 1, 8))::BIGINT / 4294967296.0 - 0.5 AS beta, ('0x' || substr(md5(symbol || '|' || date::VARCHAR), 1, 8))::BIGINT / 4294967296.0 - 0.5 AS noise FROM bars),
pr AS (SELECT symbol, date, beta::DOUBLE AS factor, exp(sum(ln(1 + (beta * 0.5 + noise) * 0.05)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM u),
q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM pr),
panel AS (SELECT * FROM (SELECT symbol, date, factor, lead(r) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM q) WHERE fwd_ret IS NOT NULL)
SELECT round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, round(icir, 6) AS icir, round(ic_positive_ratio, 6) AS ic_positive_ratio, n_dates FROM ({summary_sql(ic_sql())})"""
ICIR_WEIGHTS = f"""WITH {WIDE}, {FORWARD}, {LONG}, {panel_of('long')},
i AS (SELECT factor_name AS name, greatest(0, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)) AS v FROM {ic_sql(keys='factor_name, date')} GROUP BY factor_name)
SELECT name, round(CASE WHEN sum(v) OVER () > 0 THEN v / sum(v) OVER () ELSE 1.0 / count(*) OVER () END, 8) AS weight FROM i"""


def icirs(b, w):
    return {r["factor_name"]: r["icir"] or 0.0 for r in ev.batch(b, w, NAMES).select("factor_name", "icir").collect()}


def icir_weights(s, d):
    b = source.saved(s, d)
    found = combine.positive_weights(icirs(b, system.matrix(b, NAMES)))
    return rounded(s.createDataFrame(sorted(found.items()), "name string, weight double"), 8)


def left_out(s, d):
    b = source.saved(s, d)
    w = system.matrix(b, NAMES).persist()

    def score_all(frame, blends):
        got = {r["factor_name"]: r["icir"] or 0.0 for r in ev.batch(b, frame, blends).select("factor_name", "icir").collect()}
        return [got.get(n, 0.0) for n in blends]

    found = combine.leave_one_out(w, NAMES, icirs(b, w), score_all=score_all)
    w.unpersist()
    return rounded(s.createDataFrame(found, "name string, without double, change double"), 6)


def left_out_sql() -> str:
    """All factors, and all but one: each blend by its own chain of projections, columns made orthonormal one after another."""
    keeps = {"": NAMES, **{n: [k for k in NAMES if k != n] for n in NAMES}}
    text = f"""WITH {WIDE}, {FORWARD}, {LONG}, one AS (SELECT * FROM long JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
g AS MATERIALIZED (SELECT factor_name AS name, greatest(0, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)) AS v FROM {ic_sql('one', 'factor_name, date')} GROUP BY factor_name),
r AS MATERIALIZED (SELECT symbol, date, {', '.join(f'coalesce({n}, 0) AS {n}' for n in NAMES)} FROM z)"""
    parts = []
    for c, (gone, keep) in enumerate(keeps.items()):
        weight = lambda n: f"(SELECT CASE WHEN sum(v) > 0 THEN max(v) FILTER (name = '{n}') / sum(v) ELSE {1 / len(keep)!r} END FROM g WHERE name IN ({', '.join(repr(k) for k in keep)}))"  # noqa: B023, E731
        text += f",\na{c}_0 AS MATERIALIZED (SELECT * FROM r)"
        for t, n in enumerate(keep):
            taken = "".join(f" - (SELECT sum(q{j} * {n}) / (sum(q{j} * q{j}) + 1e-12) FROM a{c}_{t}) * q{j}" for j in range(t))
            text += f",\nb{c}_{t} AS MATERIALIZED (SELECT *, {n}{taken} AS v{t} FROM a{c}_{t})"
            text += f",\na{c}_{t + 1} AS MATERIALIZED (SELECT *, v{t} / (SELECT sqrt(sum(v{t} * v{t})) + 1e-12 FROM b{c}_{t}) AS q{t} FROM b{c}_{t})"
        parts.append(f"SELECT '{gone}' AS gone, symbol, date, {' + '.join(f'{weight(n)} * q{t}' for t, n in enumerate(keep))} AS v FROM a{c}_{len(keep)}")
    return text + f""",
u AS ({' UNION ALL '.join(parts)}),
k AS (SELECT gone, symbol, date, (rank() OVER (PARTITION BY gone, date ORDER BY v) + (count(*) OVER (PARTITION BY gone, date, v) - 1) / 2.0) / count(*) OVER (PARTITION BY gone, date) AS factor FROM u),
{panel_of('k')},
o AS (SELECT gone, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS icir FROM {ic_sql(keys='gone, date')} GROUP BY gone)
SELECT a.gone AS name, round(a.icir, 6) + 0 AS without, round(a.icir - b.icir, 6) + 0 AS change FROM o AS a, o AS b WHERE a.gone <> '' AND b.gone = ''"""


def ascended(s, d):
    """Weights after coordinate ascent from equal ones on the ICIR of the ranked blend."""
    b = source.saved(s, d)
    w = system.matrix(b, NAMES).persist()

    def score_all(weightings):
        names = [f"c{i:03d}" for i in range(len(weightings))]
        sums = w.select("symbol", "date", *[combine.linear_filled(NAMES, v).alias(n) for n, v in zip(names, weightings, strict=True)])
        got = {r["factor_name"]: r["icir"] or 0.0 for r in ev.batch(b, sums.select("symbol", "date", *[rank_pct(F.col(n), "date").alias(n) for n in names]), names).select("factor_name", "icir").collect()}
        return [got.get(n, 0.0) for n in names]

    found = combine.ascend(w, NAMES, np.full(len(NAMES), 1 / len(NAMES)), score_all, rounds=5)
    return rounded(s.createDataFrame([(n, float(v)) for n, v in zip(NAMES, found, strict=True)], "name string, weight double"), 6)


def analysed(part, places=8):
    return lambda s, d: rounded(system.analyse(source.saved(s, d), NAMES, only=part)[part], places)


def components(s, d):
    share, load, effective = principal(correlation_pairs(system.matrix(source.saved(s, d), NAMES), NAMES), NAMES)
    return rounded(s.createDataFrame([(n, i + 1, share[i], abs(load[i]), effective) for i, n in enumerate(NAMES)], "name string, component int, share double, loading double, effective_n double"), 5)


def components_sql(squarings: int = 14) -> str:
    """The correlation matrix squared again and again, made to a trace of 1, is the first component's projection, which is then taken out; and so on."""
    k = range(len(NAMES))
    at = lambda i, j: f"coalesce(CASE WHEN count({NAMES[i]} + {NAMES[j]}) >= 30 THEN corr({NAMES[i]}, {NAMES[j]}) END, 0)"
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {at(min(i, j), max(i, j))} AS v FROM z" for i in k for j in k if i != j)
    ones = ", ".join(f"({i}, {i}, 1.0::DOUBLE)" for i in k)
    text = f"WITH {WIDE}, m0 AS MATERIALIZED ({cells} UNION ALL SELECT * FROM (VALUES {ones}))"
    for c in k:
        text += f",\np{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM m{c} WHERE i = j) AS v FROM m{c})"
        for q in range(squarings):
            text += f",\nq{c}_{q} AS MATERIALIZED (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM p{c}_{q} AS a JOIN p{c}_{q} AS b ON a.j = b.i GROUP BY a.i, b.j)"
            text += f",\np{c}_{q + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{c}_{q} WHERE i = j) AS v FROM q{c}_{q})"
        text += f",\ne{c} AS MATERIALIZED (SELECT {c} AS c, sum(m.v * p.v) AS value FROM m{c} AS m JOIN p{c}_{squarings} AS p ON m.i = p.j AND m.j = p.i)"
        text += f",\nm{c + 1} AS MATERIALIZED (SELECT m.i, m.j, m.v - value * p.v AS v FROM m{c} AS m JOIN p{c}_{squarings} AS p USING (i, j), e{c})"
    return text + f""",
e AS ({' UNION ALL '.join(f'SELECT greatest(value, 0) AS value FROM e{c}' for c in k)}),
r AS (SELECT row_number() OVER (ORDER BY value DESC) - 1 AS c, value / sum(value) OVER () AS share FROM e), f AS (SELECT 1 / sum(share * share) AS effective FROM r)
SELECT n.name, (c + 1)::INT AS component, round(share, 5) + 0 AS share, round(sqrt(greatest(p.v, 0)), 5) + 0 AS loading, round(effective, 5) + 0 AS effective_n
FROM r JOIN (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(NAMES))}) AS n(i, name) ON n.i = c JOIN p0_{squarings} AS p ON p.i = n.i AND p.j = n.i, f"""


def evolved(s, d):
    found = search.evolve(source.saved(s, d))
    return s.createDataFrame([(str(t), float(f)) for t, f in found[:5]], "tree string, fitness double")


def islands(s, d):
    rows = [(r["tree"], r["island"], float(r["train_ic"]), float(r["test_ic"]), float(r["overfit_gap"])) for r in search.evolve_islands(source.saved(s, d))]
    return rounded(s.createDataFrame(rows, "tree string, island int, train_ic double, test_ic double, overfit_gap double"))


def levels(s, d):
    """The audit of a three-level screen of the system's factors, with all but one named by the review."""
    b = source.saved(s, d)
    w = system.matrix(b, NAMES).persist()
    kept, audit = combine.screen(w.join(b.select("symbol", "date", "ret"), ["symbol", "date"]), NAMES, "ret", icirs(b, w), NAMES[1:], least=2)
    return s.createDataFrame([(*a, "|".join(sorted(kept))) for a in audit], "level string, into int, out int, how string, kept string")


def beamed(s, d):
    b = source.saved(s, d)
    found = search.beam(b, system.matrix(b, NAMES).persist(), NAMES)
    return s.createDataFrame([("+".join(t), float(f)) for t, f in found[:5]], "combination string, icir double")


def tuned(s, d):
    found = search.grid(source.saved(s, d), lambda n: x.lag(-x.total(factors.P, n)), [{"n": n} for n in (1, 2, 3, 5, 10)])
    return rounded(s.createDataFrame([(p["n"], float(v)) for p, v in found], "n int, icir double"), 8)


def recovery(s, d):
    rows = search.planted(source.saved(s, d))
    return rounded(ev.ic_summary(ev.ic_series(ev.prepare(rows, rows.select("symbol", "date", F.col("beta").alias("factor"))))), 6)


def fit_grades(s, d):
    c = source.table(s, d, "customer")
    fit, grade = system.graded(F.col("c_acctbal") / 1000, F.col("c_acctbal") / 5000, F.col("c_nationkey") / 20)
    return rounded(c.select("c_custkey", fit.alias("fitness"), grade.alias("grade")))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS "end", count(*) AS n FROM k GROUP BY user_id, sid"""

FIT = "(c_acctbal / 1000 * sqrt(abs(c_acctbal / 5000) / greatest(c_nationkey / 20.0, 0.125)))"

_ALL = {
    "system_matrix": (lambda s, d: rounded(system.matrix(source.saved(s, d), NAMES)), f"WITH {WIDE} SELECT symbol, date, {', '.join(f'round({n}, 6) + 0 AS {n}' for n in NAMES)} FROM z"),
    "system_single": (analysed("single"), SINGLE),
    "system_composite": (analysed("composite"), COMPOSITE),
    "system_correlation": (
        analysed("correlation", 6),
        f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, round(corr({a}, {b}), 6) + 0 AS rho FROM z" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]),
    ),
    "system_dimensions": (analysed("dimensions", 6), DIMENSIONS),
    "system_diversification": (analysed("diversification"), DIVERSIFIED),
    "principal_components": (components, components_sql()),
    "gp_evolution": (evolved, None),
    "gp_islands": (islands, None),
    "screen_levels": (levels, None),
    "beam_search": (beamed, None),
    "parameter_grid": (tuned, GRID),
    "planted_recovery": (recovery, PLANTED),
    "icir_weights": (icir_weights, ICIR_WEIGHTS),
    "leave_one_out": (left_out, left_out_sql()),
    "ascended_weights": (ascended, None),
    "fitness_grades": (
        fit_grades,
        f"SELECT c_custkey, round({FIT}, 6) + 0 AS fitness, CASE WHEN {FIT} > 2.5 THEN 'spectacular' WHEN {FIT} >= 2 THEN 'excellent' WHEN {FIT} >= 1.5 THEN 'good' WHEN {FIT} >= 1 THEN 'average' ELSE 'needs improvement' END AS grade FROM customer",
    ),
    "dictionary_portfolio": (
        lambda s, d: rounded(system.dictionary_portfolio(*inputs(s, d)), 8),
        f"""WITH {BARS}, {FACTOR}, r AS (SELECT symbol, date, pct_chg, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS fwd FROM bars),
j AS (SELECT *, greatest(0, factor - avg(factor) OVER (PARTITION BY date)) AS raw FROM r JOIN f USING (symbol, date) WHERE factor IS NOT NULL),
w AS (SELECT *, CASE WHEN abs(pct_chg) >= 9.5 THEN 0 ELSE coalesce(raw / nullif(sum(raw) OVER (PARTITION BY date), 0), 0) END AS w FROM j),
m AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY date), 0)) AS d FROM w)
SELECT date, round(sum(w * coalesce(fwd, 0)), 8) + 0 AS ret, round(sum(d) / 2, 8) AS turnover FROM m GROUP BY date""",
    ),
    "statistical_quality": (
        lambda s, d: rounded(system.statistical_quality(source.saved(s, d), "symbol", "ret")),
        f"""WITH {BARS}, v AS (SELECT symbol, date, ret AS v, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS before FROM bars WHERE ret IS NOT NULL),
z AS (SELECT *, (v - avg(v) OVER (PARTITION BY symbol)) / (stddev_pop(v) OVER (PARTITION BY symbol) + 1e-8) AS z FROM v),
g AS (SELECT symbol, count(*) AS n, stddev_pop(v) AS sd, abs(avg(z * z * z)) AS sk, abs(coalesce(corr(before, v), 0)) AS au FROM z GROUP BY symbol)
SELECT symbol, round(CASE WHEN n < 10 THEN 0.3 ELSE greatest(0, least(1, 0.4 / (sd + 1) + 0.3 * (1 - least(sk, 5) / 5) + 0.3 * au)) END, 6) AS quality FROM g""",
    ),
    "forecast_stub": (
        lambda s, d: rounded(system.forecasts(source.saved(s, d))),
        f"""WITH {BARS} SELECT symbol, date, round(close / coalesce(lag(close, 20) OVER w, first_value(close) OVER w) - 1, 6) + 0 AS predicted,
  round(coalesce(lead(close, 5) OVER w, last_value(close) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1, 6) + 0 AS realised FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ),
    "stream_bars": (
        lambda s, d: rounded(stream.run_once(stream.bars(stream.events(s, d)))),
        "SELECT event_type, date_trunc('day', ts) AS start, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "stream_sliding": (
        lambda s, d: rounded(stream.run_once(stream.sliding(stream.events(s, d))), 4),
        "SELECT event_type, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 HOURS AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) AS o(k) GROUP BY 1, 2",
    ),
    "stream_arrivals": (lambda s, d: stream.run_once(stream.arrivals(stream.events(s, d)), "append"), "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_sessions": (lambda s, d: stream.run_once(stream.activity(stream.events(s, d))), SESSIONS),
    "session_activity": (
        lambda s, d: stream.activity(source.table(s, d, "events")),
        SESSIONS,
    ),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
