"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight that may change over training time. Its cumulative token demand is the integral
of that weight; a document at cumulative size c of its source's shuffled stream is due when the demand
reaches c, so inverting the demand gives its training position, and documents are range-sorted by it.

Rows are placed on their source's stream by an md5 of doc_id, in `bins` equal slices of the hash range. Only
sums per (source, slice) are gathered, so a source with a third of all rows costs no more than any other, no
row moves before the final sort, and reruns agree. Within a slice a document stands where the rest of its hash puts it, so that each
has a position of its own at any size of the corpus; whole slices decide on extra copies.

Defined results: a null text has size 0, takes 0 and has position null; a null source is a source of its own,
ordered last; rows with equal doc_id fall in one slice and are taken alike; an empty table gives an empty
result; other columns of the input are ignored by `mix` and kept by `apply_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BINS = 1024
#: Sources up to which the table of sources is broadcast: a row holds BINS numbers of 8 bytes, so 8.4 MB at most.
BROADCAST_SOURCES = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def along(doc_id: Column, bins: int) -> Column:
    """struct(bin, within): slice of the source's stream, and the place in it, 0 to 1."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(bins) / F.lit(1 << 32)
    return F.struct(place.cast("int").alias("bin"), (place - F.floor(place)).alias("within"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source.

    Sources in code-point order take the weights in turn. Filling by weight up to max_repeat times the size:
    in order of limit per weight, the first source whose share of what is left keeps within its limit sets the
    level for itself and all after it; those before it get their limits.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * max_repeat)
    fill = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    s = s.withColumn("rank", F.row_number().over(fill)).withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("most")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("rank", "level"))).over(everything))
    held = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    return s.select("source", "source_size", "weight", F.when(held, F.col("most").cast("double")).otherwise(F.col("first.level") * F.col("weight")).alias("target"), (F.row_number().over(by_name) - 1).alias("ordinal"))


def plan_mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, bins: int = BINS) -> DataFrame:
    """(source, bin, size) -> per source: source_size, target, whole (full copies), cut (slices below it get one more), begins (size before each slice)."""
    per_bin = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    per_source = per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"), F.map_from_entries(F.collect_list(F.struct("bin", "bin_size"))).alias("sums"))
    # at most `bins` entries a source: slices are numbered, not rows
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(F.col("sums"), b), F.lit(0).cast("long")))
    running = F.aggregate(dense, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    begins = per_source.select("source", "source_size", running.alias("begins"))
    t = targets(per_source.select("source", "source_size"), weights, max_repeat)
    t = begins.join(t.drop("source_size"), begins.source.eqNullSafe(t.source)).drop(t.source)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    gaps = F.transform(F.col("begins"), lambda x: F.abs(x - F.col("rest")))
    return t.withColumn("whole", whole).withColumn("rest", rest).withColumn("cut", F.array_position(gaps, F.array_min(gaps)).cast("int") - 1).drop("rest")


def due(share: Column, slope: Column) -> Column:
    """Time in [0, 1] at which a source has demanded `share` of its target when its weight runs linearly from 1 - slope to 1 + slope."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope)
    return F.when(slope == 0, share).otherwise(root)


def with_plan(rows: DataFrame, plan: DataFrame, slopes: Sequence[float]) -> DataFrame:
    """Adds source_size, target, copies, taken and position (of the first copy, null if none) to rows of (source, bin, within, size)."""
    plan = plan.withColumnRenamed("source", "plan_source").withColumn("slope", F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("ordinal") % len(slopes) + 1).cast("int")))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    out = out.withColumn("copies", F.col("whole") + (F.col("bin") < F.col("cut")).cast("int"))
    start, end = F.element_at("begins", F.col("bin") + 1), F.element_at("begins", F.col("bin") + 2)
    out = out.withColumn("share", F.when(F.col("target") > 0, (start + F.col("within") * (end - start)) / F.col("target")))
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("position", F.when(F.col("taken") > 0, due(F.col("share"), F.col("slope")))).withColumn("lap", F.when(F.col("target") > 0, F.col("source_size") / F.col("target")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, slopes: Sequence[float] = (-0.5, 0.0, 0.5), bins: int = BINS) -> DataFrame:
    """(doc_id, source, text) -> doc_id, size, source_size, target, taken, copies, position; range-sorted by position."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), along(F.col("doc_id"), bins).alias("along"))
    sized = common.materialize(sized.select("doc_id", "source", "size", "along.*"))
    plan = common.materialize(plan_mix(sized, weights, max_repeat, bins))
    out = with_plan(sized, plan, slopes).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    out = common.materialize(out)
    common.release(sized)
    common.release(plan)
    return out.repartitionByRange(common.partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def apply_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, slopes: Sequence[float] = (-0.5, 0.0, 0.5), bins: int = BINS) -> DataFrame:
    """docs with every row repeated as often as the mix takes it, in training order; columns as in docs.

    Copies of a document are a lap of its source apart in demand, so repeats are spread over training.
    """
    kept = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    row = row.select("row", F.col("row.source").alias("source"), size_of(F.col("row.text")).alias("size"), along(F.col("row.doc_id"), bins).alias("along")).select("row", "source", "size", "along.*")
    plan = common.materialize(plan_mix(row.select("source", "bin", "size"), weights, max_repeat, bins))
    out = with_plan(row, plan, slopes).filter(F.col("taken") > 0)
    laps = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: due(F.col("share") + k * F.col("lap"), F.col("slope")))
    out = out.select("row", F.explode(laps).alias("position"))
    out = out.repartitionByRange(common.partitions(docs.sparkSession), "position", "row.doc_id").sortWithinPartitions("position", "row.doc_id")
    return out.select("row.*")
