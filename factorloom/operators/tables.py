"""User table functions: a row in, any number of rows out."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

RULE = re.compile(r"^[\s|:\-]+$")


@udtf(returnType="row int, name string, cell string")
class MarkdownCells:
    """(text): row number, column name and text of each cell of the first Markdown table in text; null texts have none."""

    def eval(self, text: str):
        lines = [x.strip() for x in (text or "").split("\n")]
        lines = [x.strip("|").split("|") for x in lines if x.startswith("|")]
        if len(lines) < 2 or not RULE.match("|".join(lines[1])):
            return
        names = [c.strip() for c in lines[0]]
        for i, cells in enumerate(lines[2:]):
            for name, cell in zip(names, cells):
                yield i, name, cell.strip()


@udtf(returnType="key string, number int, gap double")
class Gaps:
    """Of rows with key and value, partitioned by key and ordered: their number and the distance to the one before; state is one value."""

    def __init__(self):
        self.number, self.last = 0, None

    def eval(self, row):
        value = float(row["value"])
        gap = None if self.last is None else value - self.last
        self.number, self.last = self.number + 1, value
        yield row["key"], self.number, gap


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL as markdown_cells and gaps."""
    spark.udtf.register("markdown_cells", MarkdownCells)
    spark.udtf.register("gaps", Gaps)
