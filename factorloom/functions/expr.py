"""Expression trees over a bar panel: the engine's one intermediate form.

A tree is built of columns, numbers, scalar operators and window operators (per symbol in order of date, or across a date).
`columns` compiles many trees at once into Spark columns: window operators are hoisted level by level
and shared by their canonical text, so that any number of factors costs one shuffle by symbol (and one by
date where a cross-section is used). `sql` compiles the same trees to SQL text, level by level as CTEs.
Exponential averages, which have no window form, run as one fold per symbol.

Nulls are missing values throughout; a division by zero is null.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOWED = {"lag", "lead", "sum", "mean", "std", "min", "max", "skew", "kurt", "corr", "cov", "rank", "cumsum", "ema", "slope", "maxdd", "streak", "xs_mean", "xs_rank", "xs_std"}


@dataclass(frozen=True)
class E:
    op: str
    args: tuple = ()
    n: int = 0
    least: int = 0
    value: object = field(default=None)

    def __str__(self) -> str:
        if self.op == "col":
            return str(self.value)
        if self.op == "lit":
            return repr(self.value)
        extra = f";{self.n},{self.least}" if self.n or self.least else ""
        return f"{self.op}({','.join(map(str, self.args))}{extra})"

    def __add__(self, o):
        return E("add", (self, e(o)))

    def __radd__(self, o):
        return E("add", (e(o), self))

    def __sub__(self, o):
        return E("sub", (self, e(o)))

    def __rsub__(self, o):
        return E("sub", (e(o), self))

    def __mul__(self, o):
        return E("mul", (self, e(o)))

    def __rmul__(self, o):
        return E("mul", (e(o), self))

    def __truediv__(self, o):
        return E("div", (self, e(o)))

    def __rtruediv__(self, o):
        return E("div", (e(o), self))

    def __neg__(self):
        return E("neg", (self,))

    def __gt__(self, o):
        return E("gt", (self, e(o)))

    def __ge__(self, o):
        return E("ge", (self, e(o)))

    def __lt__(self, o):
        return E("lt", (self, e(o)))

    def __le__(self, o):
        return E("le", (self, e(o)))


def e(x) -> E:
    return x if isinstance(x, E) else E("lit", value=float(x))


def col(name: str) -> E:
    return E("col", value=name)


def _unary(op):
    return lambda x: E(op, (e(x),))


absolute, ln, log1p, sqrt, sign, exp = (_unary(k) for k in ("abs", "ln", "log1p", "sqrt", "sign", "exp"))


def greatest(*xs) -> E:
    return E("greatest", tuple(map(e, xs)))


def least_of(*xs) -> E:
    return E("least", tuple(map(e, xs)))


def where(cond: E, a, b) -> E:
    """a where cond is true; b where it is false or null."""
    return E("where", (cond, e(a), e(b)))


def fill(x: E, value) -> E:
    return E("fill", (x, e(value)))


def lag(x: E, n: int = 1) -> E:
    return E("lag", (x,), n)


def lead(x: E, n: int = 1) -> E:
    return E("lead", (x,), n)


def _rolling(op):
    return lambda x, n, least=None: E(op, (e(x),), n, n if least is None else least)


total, mean, std, low, high, skew, kurt = (_rolling(k) for k in ("sum", "mean", "std", "min", "max", "skew", "kurt"))
rank, slope, maxdd = (_rolling(k) for k in ("rank", "slope", "maxdd"))


def cov(x: E, y: E, n: int, least: int | None = None) -> E:
    return E("cov", (x, y), n, n if least is None else least)


def corr(x: E, y: E, n: int, least: int | None = None) -> E:
    return E("corr", (x, y), n, n if least is None else least)


def cumsum(x: E) -> E:
    return E("cumsum", (x,))


def ema(x: E, span: int) -> E:
    return E("ema", (x,), span)


def streak(flag: E) -> E:
    """Length of the run of equal flags up to here where the flag is 1, else 0."""
    return E("streak", (flag,))


def xs_mean(x: E) -> E:
    return E("xs_mean", (x,))


def xs_std(x: E) -> E:
    return E("xs_std", (x,))


def xs_rank(x: E) -> E:
    """Average-tie rank within the date over the number of values."""
    return E("xs_rank", (x,))


def key(x: E) -> str:
    return "w_" + hashlib.md5(str(x).encode()).hexdigest()[:12]


def lookahead(x: E) -> bool:
    """Whether the tree reads later bars."""
    return x.op == "lead" or (x.op == "lag" and x.n < 0) or any(lookahead(a) for a in x.args if isinstance(a, E))


def depth(x: E) -> int:
    inner = max((depth(a) for a in x.args), default=0)
    return inner + (2 if x.op == "streak" else 1) if x.op in WINDOWED else inner


def windows(xs: list[E]) -> dict[int, dict[str, E]]:
    """Window operators of the trees by level, each once."""
    out: dict[int, dict[str, E]] = {}

    def walk(x: E) -> None:
        for a in x.args:
            walk(a)
        if x.op in WINDOWED:
            out.setdefault(depth(x), {}).setdefault(key(x), x)

    for x in xs:
        walk(x)
    return out


# ---- Spark


def safe_corr(a: Column, b: Column, over=None) -> Column:
    """Pearson correlation of the pairs without nulls; null where either side is constant (corr itself would fail under ANSI)."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    # a constant side may have a variance of rounding errors only
    varies = (on(F.min(x)) < on(F.max(x))) & (on(F.min(y)) < on(F.max(y)))
    return F.when(varies, F.try_divide(on(F.covar_pop(x, y)), on(F.stddev_pop(x)) * on(F.stddev_pop(y))))


def rank_pct(x: Column, *by: str) -> Column:
    """Average-tie rank of x within `by` over its number of values; null for null."""
    return F.when(x.isNotNull(), average_rank(x, *by) / F.count(x).over(W.partitionBy(*by)))


def average_rank(x: Column, *by: str) -> Column:
    """Rank of x within `by`, from 1, equal values sharing the mean of theirs; one sort and one exchange give rank and ties."""
    order = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow))
    return F.rank().over(order) + (ties - 1) / 2


def scalar(x: E, inner) -> Column:
    a = [inner(k) for k in x.args]
    match x.op:
        case "add":
            return a[0] + a[1]
        case "sub":
            return a[0] - a[1]
        case "mul":
            return a[0] * a[1]
        case "div":
            return F.try_divide(a[0], a[1])
        case "neg":
            return -a[0]
        case "gt":
            return a[0] > a[1]
        case "ge":
            return a[0] >= a[1]
        case "lt":
            return a[0] < a[1]
        case "le":
            return a[0] <= a[1]
        case "abs":
            return F.abs(a[0])
        case "ln":
            return F.when(a[0] > 0, F.ln(a[0]))
        case "log1p":
            return F.when(a[0] > -1, F.log1p(a[0]))
        case "sqrt":
            return F.when(a[0] >= 0, F.sqrt(a[0]))
        case "sign":
            return F.signum(a[0])
        case "exp":
            return F.exp(a[0])
        case "greatest":
            return F.greatest(*a)
        case "least":
            return F.least(*a)
        case "where":
            return F.when(a[0], a[1]).otherwise(a[2])
        case "fill":
            return F.coalesce(a[0], a[1])
    raise ValueError(f"no scalar operator {x.op}")


def windowed(x: E, inner) -> Column:
    by = W.partitionBy("symbol").orderBy("date")
    frame = by.rowsBetween(-(x.n - 1), 0) if x.n else by
    a = [inner(k) for k in x.args]
    guard = lambda c: F.when(F.count(a[0]).over(frame) >= x.least, c)
    n = F.count(a[0]).over(frame).cast("double")
    match x.op:
        case "lag":
            return F.lag(a[0], x.n).over(by)
        case "lead":
            return F.lead(a[0], x.n).over(by)
        case "sum" | "mean" | "std" | "min" | "max":
            f = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[x.op]
            return guard(f(a[0]).over(frame))
        case "skew":
            return guard(F.when(n > 2, F.skewness(a[0]).over(frame) * F.sqrt(n * (n - 1)) / (n - 2)))
        case "kurt":
            return guard(F.when(n > 3, ((n + 1) * (F.kurtosis(a[0]).over(frame) + 3) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3))))
        case "corr":
            pairs = F.count(F.when(a[0].isNotNull() & a[1].isNotNull(), 1)).over(frame)
            return F.when(pairs >= x.least, safe_corr(a[0], a[1], frame))
        case "cov":
            p, q = F.when(a[1].isNotNull(), a[0]), F.when(a[0].isNotNull(), a[1])
            return F.when(F.count(p).over(frame) >= max(x.least, 2), F.covar_samp(p, q).over(frame))
        case "rank":
            held = F.collect_list(a[0]).over(frame)
            below, same = F.size(F.filter(held, lambda v: v < a[0])), F.size(F.filter(held, lambda v: v == a[0]))
            return F.when(a[0].isNotNull(), guard((below + (same + 1) / 2) / F.size(held)))
        case "cumsum":
            return F.sum(a[0]).over(by.rowsBetween(W.unboundedPreceding, 0))
        case "slope":
            return guard(F.regr_slope(a[0], F.unix_date("date").cast("double") * 0 + F.col("bar_number")).over(frame))
        case "maxdd":
            fold = F.aggregate(
                F.collect_list(a[0]).over(frame),
                F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("dd")),
                lambda s, v: F.struct(F.greatest(s["top"], v).alias("top"), F.greatest(s["dd"], (F.greatest(s["top"], v) - v) / (F.greatest(s["top"], v) + 1e-8)).alias("dd")),
            )["dd"]
            return guard(fold)
        case "xs_mean":
            return F.avg(a[0]).over(W.partitionBy("date"))
        case "xs_std":
            return F.stddev_samp(a[0]).over(W.partitionBy("date"))
        case "xs_rank":
            return rank_pct(a[0], "date")
    raise ValueError(f"no window operator {x.op}")


def compiled(x: E) -> Column:
    """x with its window operators read from their hoisted columns."""
    if x.op in WINDOWED:
        return F.col(key(x))
    if x.op == "col":
        return F.col(str(x.value))
    if x.op == "lit":
        return F.lit(x.value)
    return scalar(x, compiled)


#: Decay, as a power of e, after which what came before is left out of an exponential average: a part in 10^100.
FADED = 230.0


def exponential(df: DataFrame, todo: dict[str, E]) -> DataFrame:
    """Exponential averages (span n, no bias correction) as running sums, in windows by symbol only.

    With decay d, the average at a bar is the sum of shares of values times what they have decayed to. A running sum needs values to be
    scaled by the inverse of their decay since some start, which would overflow, so bars are parted into stretches of FADED each: an average takes
    its own stretch and the one before, and what is older is beyond a double's digits. Across g bars without a value the average has
    decayed g times, and the new value's share is to the whole of both; bars without a value keep the last average.
    """
    by = W.partitionBy("symbol").orderBy("date")
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_bar": F.row_number().over(by), **{f"x_{k}": compiled(x.args[0]).cast("double") for k, x in todo.items()}})
    df = df.withColumns({f"g_{k}": F.col("_bar") - F.last(F.when(F.col(f"x_{k}").isNotNull(), F.col("_bar")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)) for k in todo})
    added = {}
    for k, x in todo.items():
        alpha = min(2.0 / (x.n + 1), 1 - 1e-16)
        # what is left of the average before, and the share of the new value; the first value is the average
        left = F.pow(F.lit(1.0 - alpha), F.col(f"g_{k}"))
        fresh = F.col(f"x_{k}").isNotNull()
        added[f"a_{k}"] = F.when(fresh & F.col(f"g_{k}").isNotNull(), F.col(f"g_{k}") * -math.log1p(-alpha) + F.ln(left + alpha)).otherwise(0.0)
        added[f"b_{k}"] = F.when(fresh, F.when(F.col(f"g_{k}").isNull(), 1.0).otherwise(alpha / (left + alpha)))
    df = df.withColumns(added)
    df = df.withColumns({f"l_{k}": F.sum(f"a_{k}").over(so_far) for k in todo})
    df = df.withColumns({f"s_{k}": F.floor(F.col(f"l_{k}") / FADED) for k in todo})
    scaled = lambda k: F.coalesce(F.col(f"x_{k}") * F.col(f"b_{k}") * F.exp(F.col(f"l_{k}") - F.col(f"s_{k}") * FADED), F.lit(0.0))
    inside = lambda k: W.partitionBy("symbol", f"s_{k}").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"p_{k}": F.sum(scaled(k)).over(inside(k)) for k in todo})
    df = df.withColumns({f"h_{k}": F.lag(F.struct(f"p_{k}", f"s_{k}")).over(by) for k in todo})
    df = df.withColumns({f"h_{k}": F.first(f"h_{k}").over(inside(k)) for k in todo})
    out = {}
    for k, x in todo.items():
        before = F.coalesce(F.col(f"h_{k}")[f"p_{k}"] * F.exp(-(F.col(f"s_{k}") - F.col(f"h_{k}")[f"s_{k}"]) * FADED), F.lit(0.0))
        average = F.exp(F.col(f"s_{k}") * FADED - F.col(f"l_{k}")) * (F.col(f"p_{k}") + before)
        out[k] = F.when(F.count(f"x_{k}").over(so_far) > 0, average) if x.n > 1 else F.last(f"x_{k}", ignorenulls=True).over(so_far)
    return df.withColumns(out).drop("_bar", *[f"{c}_{k}" for c in "xgablsph" for k in todo])


def columns(panel: DataFrame, trees: dict[str, E], keep: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """panel -> keep columns and one column for each named tree."""
    levels = windows(list(trees.values()))
    if any(x.op == "slope" for level in levels.values() for x in level.values()):
        panel = panel.withColumn("bar_number", F.row_number().over(W.partitionBy("symbol").orderBy("date")).cast("double"))
    out = panel
    for d in sorted(levels):
        plain = {k: x for k, x in levels[d].items() if x.op not in ("ema", "streak")}
        streaks = {k: x for k, x in levels[d].items() if x.op == "streak"}
        emas = {k: x for k, x in levels[d].items() if x.op == "ema"}
        if streaks:
            by = W.partitionBy("symbol").orderBy("date")
            flags = {f"f_{k}": compiled(x.args[0]) for k, x in streaks.items()}
            out = out.withColumns(flags)
            out = out.withColumns({f"c_{k}": F.when(F.col(f"f_{k}").eqNullSafe(F.lag(f"f_{k}").over(by)), 0).otherwise(1) for k in streaks})
            out = out.withColumns({f"i_{k}": F.sum(f"c_{k}").over(by.rowsBetween(W.unboundedPreceding, 0)) for k in streaks})
            for k in streaks:
                out = out.withColumn(k, F.col(f"f_{k}") * F.row_number().over(W.partitionBy("symbol", f"i_{k}").orderBy("date")))
        if plain:
            out = out.withColumns({k: windowed(x, compiled) for k, x in plain.items()})
        if emas:
            out = exponential(out, emas)
    return out.select(*keep, *[compiled(x).alias(name) for name, x in trees.items()])


# ---- SQL


def scalar_sql(x: E) -> str:
    if x.op in WINDOWED:
        return key(x)
    if x.op == "col":
        return str(x.value)
    if x.op == "lit":
        return f"({x.value!r}::DOUBLE)"
    a = [scalar_sql(k) for k in x.args]
    infix = {"add": "+", "sub": "-", "mul": "*", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
    if x.op in infix:
        return f"({a[0]} {infix[x.op]} {a[1]})"
    match x.op:
        case "div":
            return f"({a[0]} / nullif({a[1]}, 0))"
        case "neg":
            return f"(-{a[0]})"
        case "ln":
            return f"(CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END)"
        case "log1p":
            return f"(CASE WHEN {a[0]} > -1 THEN ln(1 + {a[0]}) END)"
        case "sqrt":
            return f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)"
        case "where":
            return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        case "fill":
            return f"coalesce({a[0]}, {a[1]})"
    return f"{x.op}({', '.join(a)})"


def window_sql(x: E) -> str:
    by = "PARTITION BY symbol ORDER BY date"
    frame = f"({by} ROWS BETWEEN {x.n - 1} PRECEDING AND CURRENT ROW)"
    a = [scalar_sql(k) for k in x.args]
    guard = lambda c: f"CASE WHEN count({a[0]}) OVER {frame} >= {x.least} THEN {c} END"
    match x.op:
        case "lag" | "lead":
            return f"{x.op}({a[0]}, {x.n}) OVER ({by})"
        case "sum" | "mean" | "std" | "min" | "max":
            f = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[x.op]
            return guard(f"{f}({a[0]}) OVER {frame}")
        case "skew":
            return guard(f"skewness({a[0]}) OVER {frame}")
        case "kurt":
            return guard(f"kurtosis({a[0]}) OVER {frame}")
        case "corr":
            p, q = f"(CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END)", f"(CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} END)"
            varies = f"min({p}) OVER {frame} < max({p}) OVER {frame} AND min({q}) OVER {frame} < max({q}) OVER {frame}"
            return f"CASE WHEN count({p}) OVER {frame} >= {x.least} AND {varies} THEN corr({p}, {q}) OVER {frame} END"
        case "cov":
            p, q = f"(CASE WHEN {a[1]} IS NOT NULL THEN {a[0]} END)", f"(CASE WHEN {a[0]} IS NOT NULL THEN {a[1]} END)"
            return f"CASE WHEN count({p}) OVER {frame} >= {max(x.least, 2)} THEN covar_samp({p}, {q}) OVER {frame} END"
        case "rank":
            held = f"list_filter(list({a[0]}) OVER {frame}, lambda v: v IS NOT NULL)"
            below, same = f"len(list_filter({held}, lambda v: v < {a[0]}))", f"len(list_filter({held}, lambda v: v = {a[0]}))"
            return f"CASE WHEN {a[0]} IS NOT NULL AND count({a[0]}) OVER {frame} >= {x.least} THEN ({below} + ({same} + 1) / 2.0) / len({held}) END"
        case "cumsum":
            return f"sum({a[0]}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        case "slope":
            return guard(f"regr_slope({a[0]}, bar_number) OVER {frame}")
        case "maxdd":
            held = f"list({a[0]}) OVER {frame}"
            return guard(f"list_max(list_transform(range(1, len({held}) + 1), lambda i: (list_max(({held})[1:i]) - ({held})[i]) / (list_max(({held})[1:i]) + 1e-8)))")
        case "ema":
            alpha = 2.0 / (x.n + 1)
            held = f"list_filter(list({a[0]}) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL)"
            return f"CASE WHEN len({held}) > 0 THEN list_reduce({held}, lambda p, v: p * (1 - {alpha!r}) + v * {alpha!r}) END"
        case "xs_mean":
            return f"avg({a[0]}) OVER (PARTITION BY date)"
        case "xs_std":
            return f"stddev_samp({a[0]}) OVER (PARTITION BY date)"
        case "xs_rank":
            return f"CASE WHEN {a[0]} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {a[0]} NULLS LAST) + (count(*) OVER (PARTITION BY date, {a[0]}) - 1) / 2.0) / count({a[0]}) OVER (PARTITION BY date) END"
    raise ValueError(f"no window operator {x.op}")


def sql(source: str, trees: dict[str, E], keep: tuple[str, ...] = ("symbol", "date"), places: int | None = None) -> str:
    """CTE text that ends in a SELECT of keep columns and the trees; source names a relation."""
    levels = windows(list(trees.values()))
    ctes = [f"l0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date)::DOUBLE AS bar_number FROM {source})"]
    at = "l0"
    for d in sorted(levels):
        streaks = {k: x for k, x in levels[d].items() if x.op == "streak"}
        plain = {k: x for k, x in levels[d].items() if x.op != "streak"}
        for k, x in streaks.items():
            by = "PARTITION BY symbol ORDER BY date"
            ctes.append(f"a_{k} AS (SELECT *, {scalar_sql(x.args[0])} AS f_{k} FROM {at})")
            ctes.append(f"b_{k} AS (SELECT *, CASE WHEN f_{k} IS NOT DISTINCT FROM lag(f_{k}) OVER ({by}) THEN 0 ELSE 1 END AS c_{k} FROM a_{k})")
            ctes.append(f"d_{k} AS (SELECT *, sum(c_{k}) OVER ({by} ROWS UNBOUNDED PRECEDING) AS i_{k} FROM b_{k})")
            ctes.append(f"e_{k} AS (SELECT *, f_{k} * row_number() OVER (PARTITION BY symbol, i_{k} ORDER BY date) AS {k} FROM d_{k})")
            at = f"e_{k}"
        if plain:
            ctes.append(f"l{d} AS (SELECT *, " + ", ".join(f"{window_sql(x)} AS {k}" for k, x in plain.items()) + f" FROM {at})")
            at = f"l{d}"
    cell = (lambda x: f"round({scalar_sql(x)}, {places}) + 0") if places is not None else scalar_sql
    return ", ".join(ctes) + f" SELECT {', '.join(keep)}, " + ", ".join(f"{cell(x)} AS {n}" for n, x in trees.items()) + f" FROM {at}"
