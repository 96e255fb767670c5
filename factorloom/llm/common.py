"""Helpers that the operators share: tables, shared storage, let-binding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factorloom-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_WRITTEN: list[str] = []


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that this session wrote to the shared folder; call it once results have been saved."""
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factorloom-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factorloom_path = path
    _WRITTEN.append(path)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    path = getattr(df, "_factorloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


#: Bounds of a batch that goes to Python: rows, and bytes, so that very long texts come a few at a time.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches of BATCH_ROWS rows and about BATCH_BYTES bytes at most for what Python maps from here on.

    Spark reads these bounds from the session when a plan is executed, so they are lowered there and stay; bounds that are
    already lower are kept, and no result depends on them.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(name)
        if not (held.isdigit() and 0 < int(held) <= most):
            conf.set(name, str(most))
    return df


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; a lambda variable, unlike a column, is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
