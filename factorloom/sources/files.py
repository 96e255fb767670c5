"""Files of bars and dictionaries in, results out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import canonical


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="factorloom-files-")


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, until `cleanup`."""
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch folders of this process; call it once results have been saved."""
    while _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in a scratch folder: computed once, and there whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_upload(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A table out of csv, tsv, json (lines), txt (line, text) or parquet, with standard column names where aliases are found."""
    reader = spark.read.schema(schema) if schema and kind != "txt" else spark.read
    if kind in ("csv", "tsv"):
        out = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        out = reader.json(path)
    elif kind == "txt":
        return reader.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    elif kind == "parquet":
        out = reader.parquet(path)
    else:
        raise ValueError(f"no reader for {kind}")
    return canonical(out)


def describe(df: DataFrame) -> DataFrame:
    """n_rows, n_symbols, first_date, last_date of an upload."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def usable(df: DataFrame, days: int) -> DataFrame:
    """symbol, n, usable: whether each has at least max(20, half of days) bars."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("usable", F.col("n") >= F.lit(max(20, days * 0.5)))


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; nulls are left out."""
    df.write.mode("append").json(path)


def deliver(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def metrics_map(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds `metrics`, a map of the numeric columns that can be read as numbers."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.expr(f"try_cast(`{n}` AS DOUBLE)").alias("v")) for n in names])
    return df.withColumn("metrics", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))
