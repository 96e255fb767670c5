"""Statements of symbols, the quotes of several sources, and rows out of a gateway's JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.operators.align import as_of

from .bars import table

#: Days from the end of a quarter until its statement is known.
LAG = 45


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, period (end of the quarter), known (when it is published), earnings, assets, shares, of suppliers.

    Earnings are the quarter's net sales less tax and a fixed cost share, assets all net sales so far, shares the quantity so far.
    """
    lines = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = lines.select(F.col("l_suppkey").cast("string").alias("symbol"), F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2)).alias("period"), net.alias("net"), "l_tax", "l_quantity")
    made = rows.groupBy("symbol", "period").agg(F.sum(F.col("net") * (0.3 - F.col("l_tax"))).alias("earnings"), F.sum("net").alias("sales"), F.sum("l_quantity").alias("sold"))
    so_far = W.partitionBy("symbol").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return made.select("symbol", "period", F.date_add("period", LAG).alias("known"), "earnings", F.sum("sales").over(so_far).alias("assets"), F.sum("sold").over(so_far).alias("shares"))


def valued(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """symbol, date, ep, bp, roa: earnings and assets a share over the close, and earnings over assets, by the last statement known at each bar's date."""
    left = bars.select("symbol", F.col("date").alias("known"), "close")
    rows = as_of(left, reports.select("symbol", "known", "earnings", "assets", "shares"), "symbol", "known", ["earnings", "assets", "shares"])
    a_share = lambda c: F.try_divide(F.try_divide(F.col(c), F.col("shares")), F.col("close"))
    return rows.select("symbol", F.col("known").alias("date"), a_share("earnings").alias("ep"), a_share("assets").alias("bp"), F.try_divide(F.col("earnings"), F.col("assets")).alias("roa"))


def quoted(wanted: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """symbol, price, ts, source of each symbol wanted: the newest quote of the first source that has one; null if none has.

    Sources are (name, table of symbol, price, ts). All are looked up in one pass: what isn't wanted goes before the shuffle's aggregation where
    the wanted ones are few enough to be sent round.
    """
    rows = None
    for i, (name, quotes) in enumerate(sources):
        one = quotes.filter("price IS NOT NULL").select("symbol", "price", "ts", F.lit(name).alias("source"), F.lit(-i).alias("turn"))
        rows = one if rows is None else rows.unionByName(one)
    symbols = wanted.select("symbol").distinct()
    best = rows.join(symbols, "symbol", "left_semi").groupBy("symbol").agg(F.max_by(F.struct("price", "ts", "source"), F.struct("turn", "ts", "price")).alias("q"))
    return symbols.join(best, "symbol", "left").select("symbol", "q.price", "q.ts", "q.source")


def gateway_rows(replies: DataFrame, reply: str, fields: str, keys: list[str]) -> DataFrame:
    """keys and one row for each element of the reply's `data.rows`, as fields (a DDL text) say; replies that don't parse, or have none, have no row."""
    parsed = F.from_json(F.col(reply), f"data struct<rows:array<struct<{fields}>>>")
    return replies.select(*keys, F.inline(parsed["data"]["rows"]))


def reply(rows: Column, code: str = "ok") -> Column:
    """The gateway's JSON for an array of structs."""
    return F.to_json(F.struct(F.lit(code).alias("code"), F.struct(rows.alias("rows")).alias("data")))
