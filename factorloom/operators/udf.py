"""User factors in Python: the escape hatch, its lint, and a registry of metrics.

A user factor is declared for one axis, so that it runs in parallel: over time (a symbol's bars at once) or across
(a date's rows at once). The lint looks for reads of later bars in its source.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS: dict[str, Callable[..., Column]] = {}


def metric(name: str):
    """Registers a function of columns ic and rank_ic to an aggregate."""

    def put(f):
        METRICS[name] = f
        return f

    return put


@metric("stability")
def stability() -> Column:
    return F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.avg((F.col("ic") > 0).cast("double"))


@metric("worst")
def worst() -> Column:
    return F.min("ic")


def measured(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return series.groupBy(*by).agg(*[f().alias(n) for n, f in METRICS.items()])


def over_time(panel: DataFrame, f: Callable, check: bool = True) -> DataFrame:
    """symbol, date, factor: f(bars of one symbol in order of date) -> values, as a list or series. Later bars are refused by the lint."""
    if check:
        found = lint(inspect.getsource(f))
        if found:
            raise ValueError("; ".join(found))

    def run(pdf):
        pdf = pdf.sort_values("date")
        out = pdf[["symbol", "date"]].copy()
        out["factor"] = list(map(float, f(pdf)))
        return out

    made = panel.groupBy("symbol").applyInPandas(run, "symbol string, date date, factor double")
    return made.withColumn("factor", F.when(~F.isnan("factor"), F.col("factor")))


def across(panel: DataFrame, f: Callable) -> DataFrame:
    """symbol, date, factor: f(rows of one date) -> values."""

    def run(pdf):
        out = pdf[["symbol", "date"]].copy()
        out["factor"] = list(map(float, f(pdf)))
        return out

    made = panel.groupBy("date").applyInPandas(run, "symbol string, date date, factor double")
    return made.withColumn("factor", F.when(~F.isnan("factor"), F.col("factor")))


#: Names of later returns, and columns of prices that a signal may only use lagged.
LATER = ("fwd_ret", "forward_ret", "future", "next_ret", "target_ret")
PRICES = frozenset(("open", "high", "low", "close", "ret", "pct_chg"))


def moved(call: ast.Call) -> int | None:
    """By how many bars a call of shift, diff or pct_change goes back; None if that isn't a number in the source."""
    given = [*call.args[:1], *[k.value for k in call.keywords if k.arg == "periods"]]
    try:
        n = ast.literal_eval(given[0]) if given else 1
    except ValueError:
        return None
    return n if isinstance(n, int | float) else None


def lint(source: str) -> list[str]:
    """What in a factor's source reads the present or later bars as if they were known; each finding once.

    Shifts that don't go back, names (of variables, attributes or columns) of later returns, and prices read as attributes that enter a
    computation without lying in a shift that goes back.
    """
    try:
        tree = ast.parse(textwrap.dedent(source))
    except SyntaxError as error:
        return [f"line {error.lineno}: the source can't be parsed"]
    found: list[str] = []

    def look(node: ast.AST, lagged: bool, within: ast.AST | None) -> None:
        name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else ""
        if any(k in name.lower() for k in LATER):
            found.append(f"line {node.lineno}: {name} names later returns")
        elif isinstance(node, ast.Attribute) and name in PRICES and not lagged and isinstance(within, ast.BinOp | ast.Compare | ast.UnaryOp | ast.Call):
            found.append(f"line {node.lineno}: {name} is used without a lag")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("shift", "diff", "pct_change"):
            n = moved(node)
            if n is not None and (n < 0 or (n == 0 and node.func.attr == "shift")):
                found.append(f"line {node.lineno}: {node.func.attr}({n}) reads the present or later bars")
            back = node.func.attr == "shift" and n is not None and n >= 1
            look(node.func.value, lagged or back, None)
            for a in [*node.args, *[k.value for k in node.keywords]]:
                look(a, lagged, node)
            return
        for child in ast.iter_child_nodes(node):
            look(child, lagged, node)

    look(tree, False, None)
    return list(dict.fromkeys(found))


def lint_batch(batch: pd.Series) -> pd.Series:
    """`lint` of a batch of sources; equal ones are looked at once."""
    made = {text: lint(text or "") for text in batch.unique()}
    return pd.Series([made[text] for text in batch], dtype=object)


def findings(source: Column) -> Column:
    """`lint` of a column of sources, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return lint_batch(batch)

    return run(source)
