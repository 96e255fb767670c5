"""Queries of files, lookups and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import align
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source
from factorloom.sources import files
from factorloom.sources.bars import table

from .base import bars_sql, rounded
from .eval_queries import PANEL, ic_sql, panel

BARS = bars_sql()
EVENTS = [("crisis", "1996-01-01", "1996-12-31", 2.0), ("boom", "1996-06-01", "1999-06-30", 0.5)]
EVENTS_SQL = "ev(win, start, stop, weight) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', {w}::DOUBLE)" for n, a, b, w in EVENTS) + ")"
ROUTES = {"PROMO": "momentum", "BRASS": "reversal", "STEEL": "volatility", "TIN": "size"}


def windows(s):
    rows = s.createDataFrame(EVENTS, "window string, start string, end string, weight double")
    return rows.select("window", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "weight")


def uploaded(kind):
    def run(s, d):
        path = files.scratch(s, "upload")
        rows = source.saved(s, d).select("symbol", F.col("date").cast("string").alias("Trade_Date"), "close")
        files.deliver(rows, path, kind)
        back = files.read_upload(s, path, kind, "symbol string, Trade_Date date, close double")
        return files.describe(back)

    return run


def appended(s, d):
    path = files.scratch(s, "lines")
    seg = table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    files.append_lines(seg, path)
    files.append_lines(seg.withColumn("n", F.col("n") * 10), path)
    return s.read.schema("c_mktsegment string, n long").json(path).groupBy("c_mktsegment").agg(F.sum("n").alias("n"))


def as_of(s, d):
    o = table(s, d, "orders")
    left = table(s, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cust"), F.col("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("qty"))
    right = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return align.as_of(left, right, "cust", "ts", ["price"])


AS_OF = """WITH l AS (SELECT o_custkey AS cust, l_shipdate AS ts, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT o_custkey AS cust, o_orderdate AS ts, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT l.cust, l.ts, qty, price FROM l ASOF LEFT JOIN r ON l.cust = r.cust AND l.ts >= r.ts"""


_ALL = {
    "upload_csv": (uploaded("csv"), f"WITH {BARS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date FROM bars"),
    "upload_json": (uploaded("json"), f"WITH {BARS} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date FROM bars"),
    "append_lines": (appended, "SELECT c_mktsegment, (count(*) * 11)::BIGINT AS n FROM customer GROUP BY c_mktsegment"),
    "usable_symbols": (lambda s, d: files.usable(source.saved(s, d), 166), f"WITH {BARS} SELECT symbol, count(*) AS n, count(*) >= 83 AS usable FROM bars GROUP BY symbol"),
    "index_search": (lambda s, d: align.search(table(s, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "1"), "SELECT n_name AS name, n_nationkey FROM nation WHERE contains(lower(n_name), '1')"),
    "index_history": (
        lambda s, d: rounded(align.history(source.saved(s, d), "1996-01-01", "1996-06-30").select("symbol", "date", "close")),
        f"WITH {BARS} SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'",
    ),
    "index_spot": (
        lambda s, d: rounded(align.spot(source.saved(s, d))),
        f"WITH {BARS} SELECT symbol, date, round(close, 6) AS close, round(ret, 6) + 0 AS change FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
    ),
    "as_of_join": (as_of, AS_OF),
    "event_windows": (
        lambda s, d: rounded(align.weighted_ic(ev.ic_series(panel(s, d)), windows(s)), 8),
        f"WITH {PANEL}, {EVENTS_SQL}, i AS (SELECT * FROM {ic_sql()}) SELECT round(sum(ic * weight) / sum(weight), 8) + 0 AS ic, count(*) AS n FROM i JOIN ev ON date BETWEEN start AND stop",
    ),
    "keyword_routes": (
        lambda s, d: table(s, d, "part").select("p_partkey", align.first_contained(F.upper("p_type"), ROUTES).alias("route"), align.any_keyword(F.col("p_name"), ["a", "z"]).alias("hit")),
        "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(upper(p_type), '{k}') THEN '{v}'" for k, v in ROUTES.items()) + " ELSE 'momentum' END AS route, contains(lower(p_name), 'a') OR contains(lower(p_name), 'z') AS hit FROM part",
    ),
    "review_filter": (
        lambda s, d: align.reviewed(table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), table(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("name"))),
        "SELECT n_name AS name, n_regionkey, n_regionkey = 2 AS kept FROM nation",
    ),
    "tag_exposure": (
        lambda s, d: rounded(align.exposure(table(s, d, "part"), "p_brand")),
        "SELECT p_brand, count(*) AS n, round(count(*) / max(count(*)) OVER (), 6) AS exposure FROM part GROUP BY p_brand",
    ),
    "reindexed_factor": (
        lambda s, d: rounded(align.onto_panel(source.saved(s, d), source.saved(s, d).filter("ret > 0").select("symbol", "date", F.col("ret").alias("factor")))),
        f"WITH {BARS} SELECT symbol, date, round(CASE WHEN ret > 0 THEN ret END, 6) AS factor FROM bars",
    ),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items()}
