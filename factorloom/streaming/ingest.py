"""A resumable crawl: rounds of a source, each written exactly once, compared only when complete.

A round streams all that the source has that earlier batches of the round didn't deliver. A batch is written to a folder named by its number,
over whatever an earlier attempt left there, and is then entered in the ledger, by a file that appears at once or not at all. Only batches
in the ledger count, so a crash between writing and entering, or between entering and the stream's own commit, neither loses
rows nor doubles them. A round is complete once its stream has ended by itself; only complete rounds are compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators import store


@dataclass
class Crawl:
    """Rounds below a shared folder. after_write is called after a batch is written and before it is entered, for tests of crashes."""

    spark: SparkSession
    base: str
    after_write: Callable[[int], None] | None = None

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _mark(self, name: str) -> None:
        """Make an empty file that is there at once or not at all."""
        fs, p = self._path(name)
        fs.mkdirs(p.getParent())
        fs.create(p, True).close()

    def _names(self, folder: str) -> set[str]:
        fs, p = self._path(folder)
        return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()

    def complete(self, turn: str) -> bool:
        return "complete" in self._names(f"{self.base}/{turn}")

    def ledger(self, turn: str) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.base}/{turn}/ledger"))

    def run(self, turn: str, source: DataFrame) -> bool:
        """Go on with a round, or begin it, until the source has no more; False if it was complete already."""
        if self.complete(turn):
            return False
        base = f"{self.base}/{turn}"

        def write(batch: DataFrame, number: int) -> None:
            if number in self.ledger(turn):
                return
            batch.write.mode("overwrite").parquet(f"{base}/batches/{number}")
            if self.after_write is not None:
                self.after_write(number)
            self._mark(f"{base}/ledger/{number}")

        q = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        self._mark(f"{base}/complete")
        return True

    def rows(self, turn: str, schema) -> DataFrame:
        """What a round's ledger vouches for."""
        paths = [f"{self.base}/{turn}/batches/{n}" for n in self.ledger(turn)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def changes(self, before: str, after: str, key: str, schema) -> DataFrame:
        """key, change (added, removed, changed) between two complete rounds of (key, digest)."""
        for turn in (before, after):
            if not self.complete(turn):
                raise ValueError(f"round {turn} isn't complete")
        return store.diff(self.rows(before, schema), self.rows(after, schema), key)


def listing(pages: DataFrame, key: str, *content: str) -> DataFrame:
    """key and the digest of a page's content; nulls count as empty."""
    return pages.select(key, F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])).alias("digest"))
