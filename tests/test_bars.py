import os

from factorloom.sources import bars

from .oracle import spark_rows


def test_bars_are_dealt_once_in_bounded_parts(spark, data, monkeypatch):
    """Lines go through one exchange, into as many partitions as the files ask for."""
    want = spark_rows(bars.bars(spark, data).drop("amount"))
    monkeypatch.setattr(bars, "PART_BYTES", os.path.getsize(f"{data}/lineitem.parquet") // 9)
    made = bars.bars(spark, data)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert made.rdd.getNumPartitions() >= 9
    assert spark_rows(made.drop("amount")) == want
    monkeypatch.setattr(bars, "LARGE_PART", 0)
    assert "ShuffledHashJoin" in (joined := bars.bars(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert spark_rows(joined.drop("amount")) == want
