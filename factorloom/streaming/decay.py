"""Decay of information coefficients as a stream: regression sums for each factor, carried over batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for this operator.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RESULT = "factor_name string, n long, slope double, mean_ic double, late long"
STATE = "n long, y double, iy double, last string, late long"


class Sums(StatefulProcessor):
    """Of a factor's records in order of date, numbered from 0: how many, sum of ic, sum of number times ic, last date, late ones.

    A record no newer than the last one is late: it is counted, not used. The slope needs `least` records.
    """

    def __init__(self, least: int = 3):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, y, iy, last, late = self.state.get() if self.state.exists() else (0, 0.0, 0.0, "", 0)
        fresh = pd.concat(list(rows)).sort_values(["date", "ic"], kind="stable")
        for day, ic in zip(fresh["date"], fresh["ic"], strict=True):
            if day <= last:
                late += 1
                continue
            y, iy, n, last = y + ic, iy + n * ic, n + 1, day
        self.state.update((n, y, iy, last, late))
        slope = (12 * iy - 6 * (n - 1) * y) / (n * (n * n - 1)) if n >= max(self.least, 2) else None
        yield pd.DataFrame({"factor_name": [key[0]], "n": [n], "slope": [slope], "mean_ic": [y / n if n else None], "late": [late]})

    def close(self) -> None:
        pass


def monitored(records: DataFrame, least: int = 3) -> DataFrame:
    """(factor_name, date, ic) stream -> the trend of each factor that a batch touches, as of that batch. Needs the state store STORE.

    The rows of a factor go to its own state only; what a batch holds of one factor is its new days.
    """
    rows = records.filter("factor_name IS NOT NULL AND date IS NOT NULL AND ic IS NOT NULL").select("factor_name", F.col("date").cast("string").alias("date"), F.col("ic").cast("double").alias("ic"))
    return rows.groupBy("factor_name").transformWithStateInPandas(Sums(least), RESULT, "Update", "None")


def verdict(slope: str = "slope", n: str = "n", least: int = 3):
    """'short' below `least` records, else 'decaying', 'growing' or 'stable' by a slope of 1e-4 a record."""
    s = F.col(slope)
    return F.when(F.col(n) < least, "short").when(s < -1e-4, "decaying").when(s > 1e-4, "growing").otherwise("stable")
