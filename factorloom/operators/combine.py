"""Weighting, combining and screening factors.

Wide frames hold symbol, date and one column a factor. Only matrices of factors by factors reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions.cross import panel_ranks_of, rank_pct, safe_corr, zscore
from factorloom.sources.files import written


def positive_weights(metric: dict[str, float]) -> dict[str, float]:
    """Positive parts, made to sum to 1; equal if none is positive."""
    w = {k: max(0.0, v or 0.0) for k, v in metric.items()}
    s = sum(w.values())
    return {k: v / s for k, v in w.items()} if s > 0 else dict.fromkeys(metric, 1 / max(1, len(metric)))


def resolve_weights(members: DataFrame, mode: str = "equal") -> DataFrame:
    """members (name, dimension, quality, ic, icir, weight) -> name, w: weights that sum to 1.

    mode: equal, quality, ic, icir, dimension (equal among dimensions, then within), manual.
    """
    every = W.partitionBy(F.lit(0))
    raw = {
        "equal": F.lit(1.0),
        "quality": F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(0.01)),
        "ic": F.abs(F.coalesce("ic", F.lit(0.0))),
        "icir": F.abs(F.coalesce("icir", F.lit(0.0))),
        "dimension": F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("dimension")),
        "manual": F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)),
    }[mode]
    rows = members.withColumn("raw", raw)
    whole = F.sum("raw").over(every)
    return rows.select("name", F.when(whole > 0, F.col("raw") / whole).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(every)).alias("w"))


def ic_weighted(wide: DataFrame, ics: dict[str, float], least: float = 0.005) -> DataFrame:
    """Sum of z-scores weighted by |IC| (below `least`: 0; all 0: equal); missing values count 0.

    Means and deviations are a table of one row a date, which goes to the rows; factors without weight aren't read.
    """
    w = {k: abs(v) if abs(v) >= least else 0.0 for k, v in ics.items()}
    s = sum(w.values())
    w = {k: v / s for k, v in w.items()} if s > 0 else dict.fromkeys(w, 1 / len(w))
    used = {k: v for k, v in w.items() if v}
    if not used:
        return wide.select("symbol", "date", F.lit(0.0).alias("factor"))
    stats = wide.groupBy(F.col("date").alias("_date")).agg(*[f(k).alias(f"_{n}_{k}") for k in used for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    rows = wide.select("symbol", "date", *used).join(F.broadcast(stats), F.col("date").eqNullSafe(F.col("_date")), "left")
    z = {k: F.try_divide(F.col(k) - F.col(f"_mean_{k}"), F.col(f"_sd_{k}") + 1e-12) for k in used}
    return rows.select("symbol", "date", sum((F.coalesce(z[k], F.lit(0.0)) * v for k, v in used.items()), F.lit(0.0)).alias("factor"))


def synthesize(wide: DataFrame, weights: dict[str, float], least_valid: float = 0.3) -> DataFrame:
    """Weighted sum over the factors that a row has, weights made to sum to 1 among them; null where they hold less than `least_valid` of the weight."""
    s = sum(abs(v) for v in weights.values())
    w = {k: v / s for k, v in weights.items()} if s else dict.fromkeys(weights, 1 / len(weights))
    have = sum((F.when(F.col(k).isNotNull(), F.lit(abs(v))).otherwise(0.0) for k, v in w.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(k), F.lit(0.0)) * v for k, v in w.items()), F.lit(0.0))
    return wide.select("symbol", "date", F.when(have >= least_valid, F.try_divide(value, have)).alias("factor"))


def gram(wide: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, column sums, rows) of the factor columns, in one aggregation."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = wide.agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s_{i}") for i, a in enumerate(names)], *cells).first()
    k = len(names)
    g = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float)
    return g, np.array([row[f"s_{i}"] or 0.0 for i in range(k)], float), row["n"]


def gram_schmidt(g: np.ndarray) -> np.ndarray:
    """T with Q = X T orthonormal, from X'X: projections use the original column, each column is normalised."""
    k = len(g)
    t = np.zeros((k, k))
    for c in range(k):
        e = np.eye(k)[c]
        v = e.copy()
        for j in range(c):
            q = t[:, j]
            v = v - (q @ g @ e) / (q @ g @ q + 1e-12) * q
        norm = float(np.sqrt(max(0.0, v @ g @ v)))
        t[:, c] = v / (norm + 1e-12) if norm > 1e-12 else v
    return t


def linear(names: list[str], weights: np.ndarray) -> Column:
    return sum((F.col(n) * float(w) for n, w in zip(names, weights, strict=True)), F.lit(0.0))


def linear_filled(names: list[str], weights: np.ndarray) -> Column:
    """`linear` with missing values as 0."""
    return sum((F.coalesce(n, F.lit(0.0)) * float(w) for n, w in zip(names, weights, strict=True)), F.lit(0.0))


def blend(wide: DataFrame, names: list[str], weights: np.ndarray, orthogonal: bool = True) -> DataFrame:
    """Composite of factors, missing as 0, orthogonalised over the whole panel, ranked within the date."""
    rows = wide.select("symbol", "date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    w = gram_schmidt(gram(rows, names)[0]) @ weights if orthogonal and len(names) > 1 else weights
    return rows.select("symbol", "date", linear(names, w).alias("v")).select("symbol", "date", rank_pct(F.col("v"), "date").alias("factor"))


def leave_one_out(wide: DataFrame, names: list[str], icirs: dict[str, float], score=None, score_all=None) -> list[tuple[str, float, float]]:
    """(name, score without it, change); score: a blended frame -> number, or score_all: a frame with a blend a column, and their names -> numbers.

    The products of all factors are summed once, as those of any part of the factors are among them.
    """
    rows = wide.select("symbol", "date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    g = gram(rows, names)[0]
    blends = {}
    for i, gone in enumerate([None, *names]):
        at = [j for j, k in enumerate(names) if k != gone]
        w = np.array(list(positive_weights({names[j]: icirs[names[j]] for j in at}).values()))
        blends[f"b{i:03d}"] = linear([names[j] for j in at], gram_schmidt(g[np.ix_(at, at)]) @ w if len(at) > 1 else w)
    ranked = rows.select("symbol", "date", *[v.alias(b) for b, v in blends.items()]).select("symbol", "date", *[rank_pct(F.col(b), "date").alias(b) for b in blends])
    found = score_all(ranked, list(blends)) if score_all else [score(ranked.select("symbol", "date", F.col(b).alias("factor"))) for b in blends]
    return [(n, v, v - found[0]) for n, v in zip(names, found[1:], strict=True)]


def ascend(wide: DataFrame, names: list[str], weights: np.ndarray, score_all, rounds: int = 20, step: float = 0.05) -> np.ndarray:
    """Coordinate ascent on weights; score_all scores a list of weightings in one job. Every round tries all single steps and takes the best."""
    best = score_all([weights])[0]
    for _ in range(rounds):
        trials = []
        for k in range(len(names)):
            for d in (step, -step):
                t = weights.copy()
                t[k] = max(0.0, t[k] + d)
                if t.sum() > 0:
                    trials.append(t / t.sum())
        scores = score_all(trials)
        i = int(np.argmax(scores))
        if not scores[i] > best + 1e-6:
            break
        best, weights = scores[i], trials[i]
    return weights


def correlation_pairs(wide: DataFrame, names: list[str], least: int = 30) -> DataFrame:
    """a, b, n, rho for each pair of factors, over rows that have both; 0 with fewer than `least`."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells += [F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}"), safe_corr(F.col(a), F.col(b)).alias(f"r{i}")]
    made = wide.agg(*cells)
    rho = lambda i: F.when(F.col(f"n{i}") >= least, F.coalesce(f"r{i}", F.lit(0.0))).otherwise(0.0)
    return made.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), rho(i).alias("rho")) for i, (a, b) in enumerate(pairs)])))


def redundant(pairs: DataFrame, least: float = 0.8, top: int = 12) -> DataFrame:
    return pairs.filter(F.abs("rho") >= least).orderBy(F.desc(F.abs("rho")), "a", "b").limit(top)


def principal(pairs: DataFrame, names: list[str]) -> tuple[list[float], list[float], float]:
    """(explained shares, loadings of the first component, effective number) of the factors' correlation matrix."""
    m = np.eye(len(names))
    for r in pairs.collect():
        i, j = names.index(r["a"]), names.index(r["b"])
        m[i, j] = m[j, i] = r["rho"]
    values, vectors = np.linalg.eigh(m)
    share = np.maximum(values[::-1], 0) / np.maximum(values, 0).sum()
    first = vectors[:, -1]
    return share.tolist(), (first * (1 if first.sum() >= 0 else -1)).tolist(), float(1 / (share**2).sum())


def screen_by_return(wide: DataFrame, names: list[str], target: str) -> DataFrame:
    """name, score, keep: |pooled correlation| with the target; keeps the max(3, half) best."""
    made = wide.agg(*[safe_corr(F.col(n), F.col(target)).alias(n) for n in names])
    rows = made.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.abs(F.coalesce(n, F.lit(0.0))).alias("score")) for n in names])))
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "name"))
    return rows.withColumn("keep", at <= max(3, len(names) // 2))


def lasso_path(g: np.ndarray, xy: np.ndarray, strength: float, rounds: int = 200) -> np.ndarray:
    """Lasso coefficients by coordinate descent on X'X and X'y (divided by rows)."""
    b = np.zeros(len(xy))
    for _ in range(rounds):
        before = b.copy()
        for k in range(len(b)):
            r = xy[k] - g[k] @ b + g[k, k] * b[k]
            b[k] = np.sign(r) * max(0.0, abs(r) - strength) / g[k, k] if g[k, k] > 0 else 0.0
        if np.abs(b - before).max(initial=0.0) < 1e-10:
            break
    return b


def lasso_screen(wide: DataFrame, names: list[str], target: str, folds: int = 5, strengths: int = 20) -> list[tuple[str, float, bool]]:
    """(name, coefficient, keep): lasso on standardised factors, its strength chosen by cross-validation.

    One aggregation by fold gathers every fold's X'X and X'y; all fits are on the driver. Under three factors pass through;
    with under 50 rows the correlation screen decides.
    """
    if len(names) < 3:
        return [(n, 1.0, True) for n in names]
    cols = [*names, target]
    rows = wide.na.drop(subset=[target]).select(F.pmod(F.xxhash64("symbol", "date"), F.lit(folds)).alias("fold"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    parts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)], *cells).collect()
    k = len(cols)

    def moments(used) -> tuple[np.ndarray, np.ndarray, float]:
        n = float(sum(r["n"] for r in used))
        s = np.array([sum(r[f"s_{i}"] for r in used) for i in range(k)]) / n
        g = np.array([[sum(r[f"g_{min(i, j)}_{max(i, j)}"] for r in used) for j in range(k)] for i in range(k)]) / n
        return g - np.outer(s, s), s, n

    whole, _, n = moments(parts) if parts else (None, None, 0)
    if n < 50:
        return [(r["name"], r["score"], r["keep"]) for r in screen_by_return(wide, names, target).collect()]
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-300))

    def scaled(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        z = c / np.outer(scale, scale)
        return z[:-1, :-1], z[:-1, -1], float(z[-1, -1])

    top = float(np.abs(scaled(whole)[1]).max())
    tries = top * np.logspace(0, -3, strengths)
    loss = np.zeros(strengths)
    for out in parts:
        g, xy, _ = scaled(moments([r for r in parts if r is not out])[0])
        held, hxy, yy = scaled(moments([out])[0])
        for i, s in enumerate(tries):
            b = lasso_path(g, xy, s)
            loss[i] += (yy - 2 * b @ hxy + b @ held @ b) * out["n"]
    g, xy, _ = scaled(whole)
    b = lasso_path(g, xy, tries[int(np.argmin(loss))])
    return [(n, float(v), bool(abs(v) > 1e-6)) for n, v in zip(names, b, strict=True)]


def orthogonalize_in_turn(wide: DataFrame, names: list[str], least: int = 5) -> DataFrame:
    """Each factor's residual, within the date, on all before it with intercept; null with fewer than `least` complete rows.

    Several regressors have no window form, so each date is one small group in Python.
    """
    schema = "symbol string, date date, " + ", ".join(f"`{n}_orth` double" for n in names)

    def run(pdf):
        out = pdf[["symbol", "date"]].copy()
        m = pdf[names].to_numpy(float)
        for i, n in enumerate(names):
            r = m[:, i].copy()
            if i:
                ok = ~np.isnan(m[:, : i + 1]).any(axis=1)
                r[:] = np.nan
                if ok.sum() >= least:
                    a = np.column_stack([np.ones(ok.sum()), m[ok, :i]])
                    r[ok] = m[ok, i] - a @ np.linalg.lstsq(a, m[ok, i], rcond=None)[0]
            out[f"{n}_orth"] = r
        return out

    made = wide.select("symbol", "date", *names).groupBy("date").applyInPandas(run, schema)
    return made.select("symbol", "date", *[F.when(~F.isnan(f"{n}_orth"), F.col(f"{n}_orth")).alias(f"{n}_orth") for n in names])


def truncate(scores: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """The best max(least, ceil(n * ratio)) rows by score."""
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "name"))
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return scores.withColumns({"rank": at, "_n": n}).filter(F.col("rank") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * ratio))).drop("_n")


def screen(wide: DataFrame, names: list[str], target: str, icirs: dict[str, float], keep: list[str] | None = None, ratio: float = 0.1, least: int = 5) -> tuple[list[str], list[tuple[str, int, int, str]]]:
    """Names that pass three levels, and the audit (level, into it, out of it, how).

    lasso: those with a coefficient, or all if none has one. review: those in keep, all if it is None or names none of them. top: the best max(least, ceil(n * ratio)) by ICIR.
    """
    first = [n for n, _, ok in lasso_screen(wide, names, target) if ok] or names
    second = first if keep is None else [n for n in first if n in keep] or first
    how = "auto" if keep is None else "human" if any(n in keep for n in first) else "none left, all kept"
    most = max(least, math.ceil(len(second) * ratio))
    third = second if len(second) <= least else sorted(second, key=lambda n: (-(icirs.get(n) or 0.0), n))[:most]
    return third, [("lasso", len(names), len(first), "lasso" if len(names) >= 3 else "few"), ("review", len(first), len(second), how), ("top", len(second), len(third), f"{ratio:g}")]


def fuse(frames: dict[str, DataFrame], method: str = "ranked", weights: dict[str, float] | None = None, by_date: bool = False) -> DataFrame:
    """symbol, date, factor over the union of the frames' keys, missing values 0.

    method: mean; ranked (mean rank over the panel, or within dates); weighted; orthogonalized (others less their fit on the first).
    """
    names = list(frames)
    out = None
    for n, df in frames.items():
        one = df.select("symbol", "date", F.col("factor").alias(n))
        out = one if out is None else out.join(one, ["symbol", "date"], "full_outer")
    out = out.select("symbol", "date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    mean = lambda cols: sum(cols, F.lit(0.0)) / len(names)
    if method == "mean":
        value = mean([F.col(n) for n in names])
    elif method == "ranked":
        if not by_date:
            out = written(out, "fused")
            ranks = written(panel_ranks_of(out, names), "fused")
            for n in names:
                at = ranks.filter(F.col("name") == n).select(F.col("value").alias(n), ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(f"rank_{n}"))
                out = out.join(at, n)
            value = mean([F.col(f"rank_{n}") for n in names])
        else:
            value = mean([rank_pct(F.col(n), "date") for n in names])
    elif method == "weighted":
        w = weights or dict.fromkeys(names, 1.0)
        value = sum((F.col(n) * float(w.get(n, 0)) for n in names), F.lit(0.0)) / (sum(w.get(n, 0) for n in names) or 1.0)
    elif method == "orthogonalized":
        base = names[0]
        fits = out.agg(*[f(F.col(n), F.col(base)).alias(f"{k}_{n}") for n in names[1:] for k, f in (("b", F.regr_slope), ("a", F.regr_intercept))])
        out = out.crossJoin(F.broadcast(fits))  # a single row of coefficients
        value = mean([F.col(base), *[F.col(n) - F.col(f"b_{n}") * F.col(base) - F.col(f"a_{n}") for n in names[1:]]])
    else:
        raise ValueError(f"no fusion {method}")
    return out.select("symbol", "date", value.alias("factor"))
