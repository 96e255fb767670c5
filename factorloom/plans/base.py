"""SQL texts of the derived relations that queries read, and rounding that both sides share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_sql(unit: str = "month") -> str:
    """CTEs that end in `bars`."""
    return f"""
px AS (SELECT l_suppkey::VARCHAR AS symbol, date_trunc('{unit}', l_shipdate)::DATE AS date, p_retailprice * (1 - l_discount) * (1 + l_tax) AS price, l_quantity,
  row_number() OVER up AS first, row_number() OVER down AS last
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WINDOW up AS (PARTITION BY l_suppkey, date_trunc('{unit}', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity),
         down AS (PARTITION BY l_suppkey, date_trunc('{unit}', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC)),
raw AS (SELECT symbol, date, max(CASE WHEN first = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN last = 1 THEN price END) AS close,
  sum(l_quantity) AS volume, sum(price * l_quantity) AS amount FROM px GROUP BY symbol, date),
rr AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM raw),
bars AS (SELECT *, ret * 100 AS pct_chg FROM rr)"""


DIMS_SQL = """
dims AS (SELECT s_suppkey::VARCHAR AS symbol, r_name AS industry, s_acctbal AS mkt_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TICKS_SQL = """
ticks AS (SELECT event_type AS symbol, ts::DATE AS date, strftime(ts, '%H:%M') AS time, ts, event_id, value AS price, 1.0::DOUBLE AS volume FROM events WHERE value > 0.01)"""


def rounded(df: DataFrame, places: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select([(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def rounded_sql(text: str, doubles: tuple[str, ...], others: tuple[str, ...], places: int = 6) -> str:
    """SELECT over a query text with doubles rounded."""
    cells = [*others, *[f"round({c}, {places}) + 0 AS {c}" for c in doubles]]
    return f"SELECT {', '.join(cells)} FROM ({text})"
