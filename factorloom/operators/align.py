"""Aligning relations in time: index lookups, as-of and range joins, calendars, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def search(names: DataFrame, text: str) -> DataFrame:
    return names.filter(F.contains(F.lower("name"), F.lit(text.lower())))


def history(bars: DataFrame, first: str, last: str) -> DataFrame:
    """Bars between two dates, both included."""
    return bars.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def spot(bars: DataFrame) -> DataFrame:
    """Each symbol's last bar with its change."""
    by = W.partitionBy("symbol").orderBy("date")
    rows = bars.select("symbol", "date", "close", (F.try_divide(F.col("close"), F.lag("close").over(by)) - 1).alias("change"))
    return rows.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "change"), "date").alias("v")).select("symbol", "v.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """left rows with the values of the last right row of equal key at or before them; one union and one window, no range join.

    Of right rows at one time the greatest values count.
    """
    names = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    b = right.groupBy(key, at).agg(F.max(F.struct(*values)).alias("_right")).select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_right")
    by = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(by)).filter("_side = 1")
    return rows.select(key, at, *[F.col(f"_left.{n}").alias(n) for n in names], *[F.col(f"_last.{v}").alias(v) for v in values])


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows with the weight of each event window (start, end, weight) that their date lies in.

    Windows are unfolded to their days, so that this is an equal join, whatever the number of windows; one that ends before it starts has no day.
    """
    w = windows.filter(F.col("start") <= F.col("end")).select("window", "start", "end", "weight", F.explode(F.sequence("start", "end")).alias("date"))
    return rows.join(w, "date")


def weighted_ic(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean IC over event windows, each date weighted by its windows; dates outside count nothing."""
    rows = in_windows(series, windows)
    return rows.agg(F.try_divide(F.sum(F.col("ic") * F.col("weight")), F.sum("weight")).alias("ic"), F.count(F.lit(1)).alias("n"))


def first_contained(text, routes: dict[str, str], default: str = "momentum"):
    """Name of the first route whose keyword occurs in the text."""
    out = None
    for word, name in routes.items():
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def any_keyword(text, words: list[str]):
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def reviewed(candidates: DataFrame, keep: DataFrame, key: str = "name") -> DataFrame:
    """Candidates with `kept`: those named in keep, or all if keep is empty."""
    named = keep.select(F.col(key).alias("_name")).distinct()
    any_named = named.agg((F.count(F.lit(1)) > 0).alias("_any"))
    out = candidates.join(named, F.col(key) == F.col("_name"), "left").crossJoin(F.broadcast(any_named))  # one row
    return out.withColumn("kept", ~F.col("_any") | F.col("_name").isNotNull()).drop("_name", "_any")


def exposure(tagged: DataFrame, tag: str) -> DataFrame:
    """n of each tag and its share of the greatest."""
    n = tagged.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("exposure", F.col("n") / F.max("n").over(W.partitionBy(F.lit("all"))))  # one row a tag


def onto_panel(keys: DataFrame, factor: DataFrame) -> DataFrame:
    """Every (symbol, date) of keys with its factor, null where it has none."""
    return keys.select("symbol", "date").distinct().join(factor.select("symbol", "date", "factor"), ["symbol", "date"], "left")
