"""Distinct counts that merge, counts over sets of groupings, and frames by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Logarithm of a sketch's number of registers: the standard error is 1.04 over the root of that number, 1.6 %.
REGISTERS = 12
ERROR = 1.04 / 2 ** (REGISTERS / 2)


def daily(events: DataFrame, by: str, what: str, at: str = "ts") -> DataFrame:
    """by, day, sketch of the distinct values of `what` on each day; made before the shuffle, so that a day of any size is a few kilobytes a task."""
    return events.groupBy(by, F.to_date(at).alias("day")).agg(F.hll_sketch_agg(what, F.lit(REGISTERS)).alias("sketch"))


def over_days(sketches: DataFrame, by: str, days: int) -> DataFrame:
    """by, day, estimate: distinct values over the `days` days that end at each day that has any, from sketches alone."""
    reach = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k)))
    merged = sketches.select(by, reach.alias("until"), "sketch").groupBy(by, F.col("until").alias("day")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return merged.join(sketches.select(by, "day"), [by, "day"], "left_semi")


def exact_over_days(events: DataFrame, by: str, what: str, days: int, at: str = "ts") -> DataFrame:
    """by, day, n: what `over_days` estimates, counted: each distinct value reaches the days after it once."""
    seen = events.select(by, what, F.to_date(at).alias("day")).distinct()
    reach = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k)))
    spread = seen.select(by, what, reach.alias("until")).groupBy(by, F.col("until").alias("day")).agg(F.count_distinct(what).alias("n"))
    return spread.join(seen.select(by, "day").distinct(), [by, "day"], "left_semi")


def within_error(estimate: Column, n: Column, errors: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard errors of n; a whole one either way is allowed for rounding."""
    return F.abs(estimate - n) <= F.greatest(F.lit(1.0), errors * ERROR * n)


def grouping_sets(rows: DataFrame, sets: list[list[str]], **aggregates: Column) -> DataFrame:
    """Aggregates by each set of columns: all columns (null where a set lacks them), level (bit i from the left for the i-th column missing)."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cols = [F.col(c) for c in names]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().cast("int").alias("level"), *[v.alias(k) for k, v in aggregates.items()])


def days_frame(days: int, by: str = "symbol", at: str = "date"):
    """A window over the rows of the last `days` calendar days, however many there are."""
    return W.partitionBy(by).orderBy(F.unix_date(at)).rangeBetween(-days, 0)


def frames(panel: DataFrame, value: str, days: int) -> DataFrame:
    """symbol, date; mean, count and first value of the last `days` days, the second value of the symbol, and the share of the date's values up to this one."""
    near, whole = days_frame(days), W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = F.col(value)
    share = F.cume_dist().over(W.partitionBy("date").orderBy(v))
    return panel.filter(v.isNotNull()).select(
        "symbol", "date", F.avg(v).over(near).alias("mean"), F.count(v).over(near).alias("n"), F.first(v).over(near).alias("first"), F.nth_value(v, 2).over(whole).alias("second"), share.alias("share")
    )
