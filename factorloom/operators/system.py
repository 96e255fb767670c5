"""A factor system as a whole: matrix, summary by dimension, diversification, forecasts, methodology grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.cross import zscore

from . import combine, factors
from . import evaluate as ev


def matrix(bars: DataFrame, names: list[str], clip: float = 3.0) -> DataFrame:
    """symbol, date and each factor's z-score within the date, turned to its direction and clipped."""
    wide = factors.compute(bars, names)
    sign = {n: -1.0 if factors.LIBRARY[n].direction == "negative" else 1.0 for n in names}
    return wide.select("symbol", "date", *[zscore(F.col(n) * sign[n], clip=clip).alias(n) for n in names])


def dimension_summary(members: DataFrame) -> DataFrame:
    """dimension, n, weight, mean quality, names."""
    return members.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.avg("quality").alias("mean_quality"), F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("names"))


def diversification(bars: DataFrame, wide: DataFrame, order: list[str]) -> DataFrame:
    """n, icir of the equal-weight composite of the first n factors; all prefixes in one job."""
    made = []
    for n in range(1, len(order) + 1):
        value = sum((F.coalesce(k, F.lit(0.0)) for k in order[:n]), F.lit(0.0)) / n
        made.append(value.alias(f"first_{n:03d}"))
    rows = wide.select("symbol", "date", *made)
    got = ev.batch(bars, rows, [f"first_{n:03d}" for n in range(1, len(order) + 1)])
    return got.select(F.substring("factor_name", 7, 3).cast("int").alias("n"), "ic", "icir")


def analyse(bars: DataFrame, names: list[str], mode: str = "equal", only: str | None = None) -> dict[str, DataFrame]:
    """Single factors, composite, correlations and diversification of a system; with `only`, at least that part, without the jobs that it doesn't need."""
    wide = matrix(bars, names)
    if only == "correlation":
        return {only: combine.correlation_pairs(wide, names)}
    single = ev.batch(bars, wide, names)
    spark = bars.sparkSession
    rows = [(n, factors.LIBRARY[n].category, factors.LIBRARY[n].quality, 1.0) for n in names]
    members = spark.createDataFrame(rows, "name string, dimension string, quality double, weight double").join(single.select(F.col("factor_name").alias("name"), "ic", "icir"), "name", "left")
    weights = combine.resolve_weights(members, mode)
    w = {r["name"]: r["w"] for r in weights.collect()}
    composite = combine.synthesize(wide, w)
    by = {r["name"]: abs(r["icir"] or 0.0) for r in members.collect()}
    order = sorted(names, key=lambda n: (-by[n], n))
    return {
        "single": single,
        "composite": ev.ic_summary(ev.ic_series(ev.prepare(bars, composite))),
        "correlation": combine.correlation_pairs(wide, names),
        "dimensions": dimension_summary(members.join(weights, "name")),
        "diversification": diversification(bars, wide, order),
    }


def forecasts(bars: DataFrame, look_back: int = 20, horizon: int = 5) -> DataFrame:
    """symbol, date, predicted (change over the look-back, as far as there is one) and realised (change over the horizon, up to the last bar)."""
    by = W.partitionBy("symbol").orderBy("date")
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    past = F.coalesce(F.lag("close", look_back).over(by), F.first("close").over(by))
    ahead = F.coalesce(F.lead("close", horizon).over(by), F.last("close").over(whole))
    return bars.select("symbol", "date", (F.try_divide(F.col("close"), past) - 1).alias("predicted"), (F.try_divide(ahead, F.col("close")) - 1).alias("realised"))


def graded(sharpe, ret, turnover):
    """Fitness sharpe * sqrt(|ret| / max(turnover, 0.125)) and its grade."""
    fit = sharpe * F.sqrt(F.abs(ret) / F.greatest(turnover, F.lit(0.125)))
    grade = F.when(fit > 2.5, "spectacular").when(fit >= 2, "excellent").when(fit >= 1.5, "good").when(fit >= 1, "average").otherwise("needs improvement")
    return fit, grade


def dictionary_portfolio(bars: DataFrame, factor: DataFrame, sign: float = 1.0, limit: float = 9.5) -> DataFrame:
    """date, ret, turnover of the long-only portfolio weighted by the factor's excess over the date's mean.

    Weights are max(0, (factor - mean) * sign) over their sum; a symbol at its price limit on the date has weight 0, and the rest stay
    as they are. Turnover is half the summed change of weights.
    """
    by = W.partitionBy("symbol").orderBy("date")
    day = W.partitionBy("date")
    rows = bars.select("symbol", "date", "pct_chg", F.lead("ret").over(by).alias("fwd_ret")).join(factor.select("symbol", "date", "factor"), ["symbol", "date"]).na.drop(subset=["factor"])
    rows = rows.withColumn("raw", F.greatest(F.lit(0.0), (F.col("factor") - F.avg("factor").over(day)) * sign))
    rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("raw"), F.sum("raw").over(day)), F.lit(0.0)))
    rows = rows.withColumn("w", F.when(F.abs("pct_chg") >= limit, 0.0).otherwise(F.col("w")))
    rows = rows.withColumn("d", F.abs(F.col("w") - F.coalesce(F.lag("w").over(by), F.lit(0.0))))
    return rows.groupBy("date").agg(F.sum(F.col("w") * F.coalesce("fwd_ret", F.lit(0.0))).alias("ret"), (F.sum("d") / 2).alias("turnover"))


def statistical_quality(series: DataFrame, key: str, value: str) -> DataFrame:
    """key, quality: 0.4 / (sd + 1) + 0.3 (1 - min(|skew|, 5) / 5) + 0.3 |autocorrelation|, within 0 and 1; 0.3 under ten values."""
    from factorloom.functions.cross import safe_corr

    by = W.partitionBy(key).orderBy("date")
    rows = series.select(key, "date", F.col(value).alias("v")).filter("v IS NOT NULL").withColumn("before", F.lag("v").over(by))
    rows = rows.withColumn("z", (F.col("v") - F.avg("v").over(W.partitionBy(key))) / (F.stddev_pop("v").over(W.partitionBy(key)) + 1e-8))
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sd"), F.abs(F.avg(F.col("z") * F.col("z") * F.col("z"))).alias("skew"), F.abs(F.coalesce(safe_corr(F.col("before"), F.col("v")), F.lit(0.0))).alias("auto"))
    quality = 0.4 / (F.col("sd") + 1) + 0.3 * (1 - F.least(F.col("skew"), F.lit(5.0)) / 5) + 0.3 * F.col("auto")
    return got.select(key, F.when(F.col("n") < 10, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))).alias("quality"))


def member_scores(members: DataFrame) -> DataFrame:
    """name, score: 0.40 attention + 0.35 quality + 0.25 diversity."""
    return members.select("name", (0.4 * F.col("attention") + 0.35 * F.col("quality") + 0.25 * F.col("diversity")).alias("score"))


#: What makes a signal sound, factors too alike, and decay slow.
SOUND_IC, SOUND_ICIR, ALIKE, SLOW = 0.03, 0.4, 0.5, 0.5


def findings(bars: DataFrame, wide: DataFrame, names: list[str], later: int = 5) -> DataFrame:
    """topic, tone (ok, info or warn), text: what the numbers of a system of factors say, each from a table of a row or a row a factor.

    signal: the mean of all factors; correlation: of all pairs; factors: strongest and weakest by |icir|; decay: what is left of the signal's ic `later`
    bars on.
    """
    mixed = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0)) / len(names)
    rows = wide.withColumn("mixed", mixed)
    got = ev.batch(bars, rows, [*names, "mixed"]).withColumn("icir", F.coalesce("icir", F.lit(0.0)))
    signal = got.filter("factor_name = 'mixed'")
    sound = (F.abs("ic") >= SOUND_IC) & (F.abs("icir") >= SOUND_ICIR)
    out = signal.select(F.lit("signal").alias("topic"), F.when(sound, "ok").otherwise("warn").alias("tone"), F.format_string("ic %.4f, icir %.2f", "ic", "icir").alias("text"))
    mean = combine.correlation_pairs(wide, names).agg(F.avg(F.abs("rho")).alias("mean")).filter("mean IS NOT NULL")
    out = out.unionByName(mean.select(F.lit("correlation").alias("topic"), F.when(F.col("mean") >= ALIKE, "warn").otherwise("info").alias("tone"), F.format_string(f"mean absolute correlation %.2f of {len(names)} factors", "mean").alias("text")))
    ends = got.filter("factor_name <> 'mixed'").agg(F.max_by("factor_name", F.abs("icir")).alias("best"), F.min_by("factor_name", F.abs("icir")).alias("worst")).filter("best IS NOT NULL")
    out = out.unionByName(ends.select(F.lit("factors").alias("topic"), F.lit("info").alias("tone"), F.concat(F.lit("strongest "), "best", F.lit(", weakest "), "worst").alias("text")))
    decay = ev.ic_decay(bars, rows.select("symbol", "date", F.col("mixed").alias("factor")), (1, later))
    left = decay.agg(F.try_divide(F.abs(F.max(F.when(F.col("horizon") == later, F.col("ic")))), F.abs(F.max(F.when(F.col("horizon") == 1, F.col("ic"))))).alias("keep")).filter("keep IS NOT NULL")
    return out.unionByName(left.select(F.lit("decay").alias("topic"), F.when(F.col("keep") >= SLOW, "ok").otherwise("warn").alias("tone"), F.format_string(f"%.0f percent of the ic left at horizon {later}", F.col("keep") * 100).alias("text")))
