"""Queries of encodings, attention, sequences and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import attention
from factorloom.sources import bars as source
from factorloom.sources.bars import table

from .base import bars_sql, rounded
from .combine_queries import NAMES, THREE, wide

BARS = bars_sql()
FEATURES = ["ret", "pct_chg", "close", "volume"]


def fusion(s, d):
    """The fused encoding of each symbol's factors, and what attention each factor receives."""
    out = attention.fused(attention.series_encodings(wide(s, d)[1], NAMES), "symbol")
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("string")), "|")
    return out.select("symbol", F.array_join("names", "|").alias("names"), text("fused").alias("fused"), text("received").alias("received"))


def scored(s, d):
    return rounded(attention.scores(wide(s, d)[1], NAMES))


SCORED = f"""WITH {BARS}, w AS (WITH {x.sql('bars', THREE)}),
u AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS name, date, {n} AS v FROM w" for n in NAMES)}),
k AS (SELECT symbol, name, date, v, lag(v) OVER (PARTITION BY symbol, name ORDER BY date) AS before, count(*) OVER g AS n, avg(v) OVER g AS m, stddev_pop(v) OVER g AS sd FROM u WHERE v IS NOT NULL WINDOW g AS (PARTITION BY symbol, name)),
q AS (SELECT symbol, name, max(n) AS n, 0.4 / (max(sd) + 1) + 0.3 * (1 - least(abs(avg(pow((v - m) / (sd + 1e-8), 3))), 5) / 5) + 0.3 * abs(coalesce(corr(before, v), 0)) AS quality FROM k GROUP BY symbol, name),
a AS (SELECT symbol, name, coalesce(CASE WHEN n < 10 THEN 0.3 ELSE greatest(0, least(1, quality)) END, 0.3) AS quality FROM (SELECT DISTINCT symbol, name FROM u WHERE v IS NOT NULL) LEFT JOIN q USING (symbol, name))
SELECT symbol, name, round(1.0::DOUBLE / count(*) OVER (PARTITION BY symbol), 6) AS attention, round(quality, 6) + 0 AS quality, 1.0::DOUBLE AS diversity,
  round(0.40 * (1.0::DOUBLE / count(*) OVER (PARTITION BY symbol)) + 0.35 * quality + 0.25, 6) + 0 AS score FROM a"""


def sequence(s, d):
    out = attention.sequence_encodings(source.saved(s, d), FEATURES)
    return rounded(out.select("symbol", F.posexplode("encoding").alias("i", "value")), 4)


def _numbers(values):
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


MEANS = ", ".join(f"avg(coalesce({c}, 0))" for c in FEATURES)
SEQUENCE = f"""WITH {BARS}, m AS (SELECT symbol, [{MEANS}] AS m FROM bars GROUP BY symbol), w AS (SELECT unnest(range(0, {attention.SEQUENCE}))::INT AS i, unnest([{', '.join(_numbers(c) for c in attention.sequence_weights(len(FEATURES))[0].T)}]) AS w)
SELECT symbol, i, round(list_inner_product(m, w), 4) + 0 AS value FROM m, w"""

SCORE = " + ".join(f"coalesce({c}, 0) * {float(w)!r}::DOUBLE" for c, w in zip(FEATURES, attention.sequence_weights(len(FEATURES))[1], strict=True))
ORDERED = f"""WITH {BARS}, s AS (SELECT symbol, date, {SCORE} AS v FROM bars)
SELECT symbol, date, round(least(greatest((rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date), 1e-6), 1 - 1e-6), 6) AS factor FROM s"""


def results(s, d):
    """Vectors as tried patterns: the first component stands for the ic, the id for the time."""
    v = table(s, d, "embeddings")
    return v.select(F.col("vec_id").alias("name"), F.transform("embedding", lambda e: e.cast("double")).alias("encoding"), F.get("embedding", 0).cast("double").alias("ic"), F.col("vec_id").alias("ts"))


def advice(s, d):
    r = results(s, d)
    return attention.advised(attention.recalled(attention.remembered(None, r), r))


MEMORY = """v AS (SELECT vec_id AS name, [x::DOUBLE FOR x IN embedding] AS e, embedding[1]::DOUBLE AS ic FROM embeddings),
t AS (SELECT name, e, CASE WHEN ic > 0.02 THEN 'winner' WHEN ic < -0.02 THEN 'loser' END AS quality FROM v),
m AS (SELECT * FROM t WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY name DESC) <= 1000)"""
ADVICE = f"""WITH {MEMORY}, s AS (SELECT v.name, m.name AS other, quality, round(list_inner_product(v.e, m.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(m.e, m.e)) + 1e-8), 6) + 0 AS s FROM v, m WHERE v.name <> m.name),
b AS (SELECT name, quality, max(s) AS s, arg_max(other, (s, -other)) AS other FROM s GROUP BY name, quality),
j AS (SELECT v.name, w.other AS winner, w.s AS to_winner, l.other AS loser, l.s AS to_loser FROM v LEFT JOIN b AS w ON w.name = v.name AND w.quality = 'winner' LEFT JOIN b AS l ON l.name = v.name AND l.quality = 'loser')
SELECT name, winner, to_winner, loser, to_loser,
  CASE WHEN coalesce(to_loser, -1) >= 0.3 AND coalesce(to_loser, -1) > coalesce(to_winner, -1) THEN 'avoid' WHEN coalesce(to_winner, -1) >= 0.3 THEN 'known' ELSE 'explore' END AS advice FROM j"""
DISPERSION = f"""WITH {MEMORY}, f AS (SELECT unnest(range(0, len(e)))::INT AS dimension, unnest(e) AS x FROM m WHERE quality = 'winner'), g AS (SELECT dimension, avg(x) AS mean, stddev_pop(x) AS sd FROM f GROUP BY dimension)
SELECT dimension, round(mean, 6) + 0 AS mean, round(sd, 6) + 0 AS sd, CASE WHEN row_number() OVER (ORDER BY sd DESC, dimension) = 1 THEN 'explored' WHEN row_number() OVER (ORDER BY sd, dimension) <= 3 THEN 'open' END AS region FROM g"""

_ALL = {
    "attention_fusion": (fusion, None),
    "factor_scores": (scored, SCORED),
    "sequence_encoding": (sequence, SEQUENCE),
    "sequence_factor": (lambda s, d: rounded(attention.sequence_factor(source.saved(s, d), FEATURES)), ORDERED),
    "memory_advice": (advice, ADVICE),
    "memory_dispersion": (lambda s, d: rounded(attention.dispersion(attention.remembered(None, results(s, d)))), DISPERSION),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
