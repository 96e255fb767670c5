"""Metadata, caches, logs and snapshots as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def alive(entries: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """The newest entry of each (ns, key), if it is no older than the time to live."""
    last = entries.groupBy("ns", "key").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "value")).alias("v"))
    return last.select("ns", "key", F.col("v.value").alias("value"), F.col("v.ts").alias("ts")).filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") <= ttl_seconds)


def namespace_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ns").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))


def counts(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def recent(log: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of greatest key, newest first."""
    return log.orderBy(F.desc(key)).limit(n)


def sessions(messages: DataFrame) -> DataFrame:
    """conv_id, messages, users' share, length and first text of each chat session."""
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum((F.col("role") == "user").cast("int")).alias("from_user"),
        F.sum(F.length("text")).alias("characters"),
        F.substring(F.min_by("text", F.struct("turn", "role", "text")), 1, 40).alias("title"),
    )


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """base with rows of equal key replaced by the fresh ones."""
    both = base.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_new")]
    kept = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_new").alias("v"))
    return kept.select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change ("added", "removed" or "changed") between two snapshots (key, digest)."""
    b, a = before.select(key, F.col("digest").alias("old")), after.select(key, F.col("digest").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def best_runs(runs: DataFrame, metric: str) -> DataFrame:
    """The successful run of greatest metric of each experiment, ties by name."""
    ok = runs.filter("status = 'ok'")
    return ok.groupBy("experiment").agg(F.max_by(F.struct("name", metric), F.struct(F.col(metric), "name")).alias("r")).select("experiment", F.col("r.name").alias("name"), F.col(f"r.{metric}").alias(metric))


def decay_trend(records: DataFrame, least: int = 3) -> DataFrame:
    """factor_name, n, slope of ic over the record's number in order of date; null with fewer than `least`."""
    at = F.row_number().over(W.partitionBy("factor_name").orderBy("date")) - 1
    rows = records.withColumn("i", at.cast("double"))
    return rows.groupBy("factor_name").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.regr_slope("ic", "i")).alias("slope"))


def tiered(tiers: list[DataFrame], key: str) -> DataFrame:
    """Union of catalogues; of equal keys the one of the first tier stays."""
    rows = None
    for i, t in enumerate(tiers):
        one = t.withColumn("_tier", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    at = F.row_number().over(W.partitionBy(key).orderBy("_tier"))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at", "_tier")


def coalesced(key: str, value: str, *sources: DataFrame) -> DataFrame:
    """value of each key from the first source that has it."""
    out = sources[0].select(key, value)
    for s in sources[1:]:
        more = s.select(F.col(key), F.col(value).alias("_more"))
        out = out.join(more, key, "full_outer").select(key, F.coalesce(value, "_more").alias(value))
    return out


def learned_monitor(records: DataFrame, weak: float = 0.02) -> DataFrame:
    """n, mean |ic| and number of weak factors of each category."""
    return records.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("ic")).alias("mean_abs_ic"), F.sum((F.abs("ic") < weak).cast("int")).alias("weak"))
