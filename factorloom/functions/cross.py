"""Cross-section operators: every function works within a date (or other grouping) by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .expr import average_rank, rank_pct, safe_corr  # noqa: F401


def on(*by: str):
    return W.partitionBy(*by)


def zscore(x: Column, by: str = "date", eps: float = 0.0, clip: float | None = None) -> Column:
    """(x - mean) / (std + eps); null where the divisor is 0; clipped to +-clip if given."""
    w = on(by)
    z = F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w) + eps)
    return z if clip is None else F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def winsorize(x: Column, p: float = 0.025, by: str = "date") -> Column:
    """x clipped to its p and 1 - p quantiles, linearly interpolated; null stays null."""
    q = lambda k: F.percentile(x, F.lit(k)).over(on(by))
    return F.when(x.isNotNull(), F.greatest(q(p), F.least(q(1 - p), x)))


def qcut(x: Column, q: int = 5, by: str = "date") -> Column:
    """Group 0 to q - 1 by quantile edges, right-closed, the lowest included; equal edges are one; null on a constant date."""
    edges = F.array_distinct(F.percentile(x, F.array(*[F.lit(k / q) for k in range(q + 1)])).over(on(by)))
    below = F.size(F.filter(edges, lambda v: v < x))
    return F.when(x.isNotNull() & (F.size(edges) >= 2), F.greatest(F.lit(0), below - 1))


def demean(x: Column, *by: str) -> Column:
    return x - F.avg(x).over(on(*by))


def neutralize(df: DataFrame, value: str, industry: str = "industry", cap: str | None = None, least: int = 10, out: str = "neutral") -> DataFrame:
    """Residual of value on industry dummies and, if cap is given, ln cap, within each date.

    Dates with fewer than `least` values pass through. A cap that is missing, 0 or negative takes the date's median of ln cap.
    Removing industry means from both sides and then the slope equals the regression with dummies.
    """
    v = F.col(value)
    n = F.count(v).over(on("date"))
    y = demean(v, "date", industry)
    if cap is None:
        return df.withColumn(out, F.when(v.isNull(), None).when(n < least, v).otherwise(y))
    size = F.when(F.col(cap) > 0, F.ln(F.col(cap)))
    df = df.withColumn("_size", F.when(v.isNotNull(), size))
    df = df.withColumn("_size", F.when(v.isNotNull(), F.coalesce("_size", F.median("_size").over(on("date")))))
    df = df.withColumn("_y", y).withColumn("_x", demean(F.col("_size"), "date", industry)).withColumn("_n", n)
    sxy, sxx = F.sum(F.col("_x") * F.col("_y")).over(on("date")), F.sum(F.col("_x") * F.col("_x")).over(on("date"))
    beta = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return df.withColumn(out, F.when(v.isNull(), None).when(F.col("_n") < least, v).otherwise(F.col("_y") - beta * F.col("_x"))).drop("_size", "_y", "_x", "_n")


def orthogonalize(df: DataFrame, value: str, against: str, least: int = 5, out: str = "orthogonal") -> DataFrame:
    """Residual of value on another factor with intercept within each date; passes through with fewer than `least` pairs."""
    pair = F.col(value).isNotNull() & F.col(against).isNotNull()
    y, x = F.when(pair, F.col(value)), F.when(pair, F.col(against))
    w = on("date")
    slope, level = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    fitted = F.coalesce(slope, F.lit(0.0)) * x + F.coalesce(level, F.avg(y).over(w))
    return df.withColumn(out, F.when(~pair, None).when(F.count(y).over(w) < least, F.col(value)).otherwise(F.col(value) - fitted))


def panel_ranks_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values of columns -> name, value, n (rows that have it), below (rows with lesser values), total (rows with any); nulls are left out.

    Values are dealt to ranges by approximate quantiles, a row a column, so that each is counted in its own range and ranges are joined by a table
    of a row each: no task sees all rows, and equal values are one row before anything is sorted. Edges decide where a value is
    counted, never the result. Nothing runs before the result is asked for.
    """
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    counts = df.select(F.explode(each).alias("v")).select("v.*").filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = counts.groupBy("name").agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 4 * parts).alias("_edges"))
    rows = counts.join(F.broadcast(edges), "name").withColumn("_range", F.size(F.filter("_edges", lambda v: v <= F.col("value")))).drop("_edges")
    ranges = rows.groupBy("name", "_range").agg(F.sum("n").alias("_held"))
    before = W.partitionBy("name").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    ranges = ranges.select("name", "_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"), F.sum("_held").over(W.partitionBy("name")).alias("total"))
    inside = W.partitionBy("name", "_range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ranges), ["name", "_range"])
    return rows.select("name", "value", "n", (F.col("_before") + F.col("_inside")).alias("below"), "total")


def panel_bounds(ranks: DataFrame, low: float, high: float) -> DataFrame:
    """name, low, high: quantiles, linearly interpolated, of the rows that `panel_ranks_of` counted."""
    found = {}
    for name, p in (("low", low), ("high", high)):
        place = F.lit(p) * (F.col("total") - 1)
        at = F.floor(place)
        has = lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("n"))
        a = F.max(F.when(has(at), F.col("value")))
        b = F.max(F.when(has(F.least(F.col("total") - 1, at + 1)), F.col("value")))
        found[name] = a + (b - a) * F.max(place - at)
    return ranks.groupBy("name").agg(*[v.alias(k) for k, v in found.items()])
