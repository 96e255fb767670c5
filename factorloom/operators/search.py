"""Searching for factors: evolution of expression trees, beam search over combinations, grids of parameters.

The loops run on the driver over a few dozen candidates; every generation is scored in one Spark job.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.cross import rank_pct
from factorloom.functions.expr import E

from . import evaluate as ev

TERMINALS = ("open", "high", "low", "close", "volume", "amount")
WINDOWS = (3, 5, 10, 20, 60)
WORST = -1e9


def random_tree(rng: random.Random, depth: int) -> E:
    if depth <= 0 or rng.random() < 0.2:
        return x.col(rng.choice(TERMINALS)) if rng.random() < 0.9 else x.e(round(rng.uniform(-1, 1), 2))
    a = random_tree(rng, depth - 1)
    n = rng.choice(WINDOWS)
    match rng.choice(("add", "sub", "mul", "div", "log", "abs", "sqrt", "neg", "sign", "delta", "mean", "zscore", "min", "max", "rank", "corr")):
        case "add":
            return a + random_tree(rng, depth - 1)
        case "sub":
            return a - random_tree(rng, depth - 1)
        case "mul":
            return a * random_tree(rng, depth - 1)
        case "div":
            b = random_tree(rng, depth - 1)
            return a / (b * (b / b) + 1e-12)  # a divisor of 0 has no quotient
        case "log":
            return x.ln(x.absolute(a) + 1e-12)
        case "abs":
            return x.absolute(a)
        case "sqrt":
            return x.sqrt(x.absolute(a) + 1e-12)
        case "neg":
            return -a
        case "sign":
            return x.sign(a)
        case "delta":
            return a - x.lag(a)
        case "mean":
            return x.mean(a, n, 1)
        case "zscore":
            return (a - x.mean(a, n, 3)) / (x.std(a, n, 3) + 1e-8)
        case "min":
            return x.low(a, n, 3)
        case "max":
            return x.high(a, n, 3)
        case "rank":
            return x.rank(a, n, 3)
    return x.corr(a, random_tree(rng, depth - 1), max(n, 5), 5)


def subtrees(t: E) -> list[E]:
    return [t, *[s for a in t.args for s in subtrees(a)]]


def replaced(t: E, old: E, new: E) -> E:
    if t is old:
        return new
    return E(t.op, tuple(replaced(a, old, new) for a in t.args), t.n, t.least, t.value) if t.args else t


def mutate(rng: random.Random, t: E, depth: int) -> E:
    return replaced(t, rng.choice(subtrees(t)), random_tree(rng, max(1, depth - 1)))


def cross(rng: random.Random, a: E, b: E) -> E:
    return replaced(a, rng.choice(subtrees(a)), rng.choice(subtrees(b)))


def fitness(bars: DataFrame, trees: dict[str, E]) -> dict[str, float]:
    """Mean IC of each lagged tree with the next return; WORST where it has none. One job for the whole population."""
    wide = x.columns(bars, {k: x.lag(t) for k, t in trees.items()})
    got = {r["factor_name"]: r["ic"] for r in ev.batch(bars, wide, list(trees)).select("factor_name", "ic").collect()}
    return {k: abs(got[k]) if got.get(k) is not None else WORST for k in trees}


def next_pool(rng: random.Random, ranked: list[E], known: dict[str, float], population: int, depth: int, elite: int) -> list[E]:
    """The elite and children of tournament winners; a child that grew too large is replaced by a new tree."""
    pool = ranked[:elite]
    while len(pool) < population:
        best = lambda: max(rng.sample(ranked, min(len(ranked), max(3, population // 5))), key=lambda t: known[x.key(t)])
        child = cross(rng, best(), best()) if rng.random() < 0.6 else mutate(rng, best(), depth)
        pool.append(child if x.depth(child) <= 4 and len(subtrees(child)) <= 40 else random_tree(rng, depth))
    return pool


def by_fitness(pool: list[E], known: dict[str, float]) -> list[E]:
    unique = {x.key(t): t for t in pool if not x.lookahead(t)}
    return sorted(unique.values(), key=lambda t: (-known[x.key(t)], str(t)))


def score_new(bars: DataFrame, pool: list[E], known: dict[str, float]) -> None:
    """Adds the fitness of trees that aren't known yet, equal ones (by canonical text) once, all in one job."""
    fresh = {x.key(t): t for t in pool if not x.lookahead(t) and x.key(t) not in known}
    if fresh:
        known.update(fitness(bars, fresh))


def evolve(bars: DataFrame, seed: int = 7, population: int = 16, generations: int = 3, depth: int = 3, elite: int = 2) -> list[tuple[E, float]]:
    """Trees by falling fitness."""
    rng = random.Random(seed)
    pool = [random_tree(rng, depth) for _ in range(population)]
    known: dict[str, float] = {}
    for _ in range(generations):
        score_new(bars, pool, known)
        pool = next_pool(rng, by_fitness(pool, known), known, population, depth, elite)
    score_new(bars, pool, known)
    return [(t, known[x.key(t)]) for t in by_fitness(pool, known)]


def cut_dates(bars: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Bars up to the date that leaves test_share of the dates after it, and the later ones."""
    dates = [r["date"] for r in bars.select("date").distinct().orderBy("date").collect()]  # one row a date
    if not dates:
        return bars, bars
    cut = F.lit(dates[min(len(dates) - 1, int(len(dates) * (1 - test_share)))])
    return bars.filter(F.col("date") <= cut), bars.filter(F.col("date") > cut)


def evolve_islands(bars: DataFrame, islands: int = 3, seed: int = 7, population: int = 8, generations: int = 2, depth: int = 3, migrants: int = 2, every: int = 1, test_share: float = 0.2, top: int = 20) -> list[dict]:
    """The best different trees of several populations: tree, island, train_ic, test_ic, overfit_gap, by falling train_ic.

    Populations evolve apart on the earlier dates; after every `every` generations each one's best `migrants` replace the last of the next one's in a ring. The later dates
    are scored once, at the end. A generation of all islands is one job.
    """
    train, test = cut_dates(bars, test_share)
    rngs = [random.Random(seed * 1009 + i) for i in range(islands)]
    pools = [[random_tree(r, depth) for _ in range(population)] for r in rngs]
    known: dict[str, float] = {}
    for g in range(generations):
        score_new(train, [t for p in pools for t in p], known)
        ranked = [by_fitness(p, known) for p in pools]
        if (g + 1) % every == 0 and islands > 1:
            best = [r[:migrants] for r in ranked]
            ranked = [by_fitness([*r[: max(1, len(r) - migrants)], *best[i - 1]], known) for i, r in enumerate(ranked)]
        pools = [next_pool(rng, r, known, population, depth, 2) if r else p for rng, r, p in zip(rngs, ranked, pools, strict=True)]
    score_new(train, [t for p in pools for t in p], known)
    found: dict[str, tuple[E, int]] = {}
    for i, p in enumerate(pools):
        for t in by_fitness(p, known):
            found.setdefault(x.key(t), (t, i))
    chosen = sorted(found.values(), key=lambda v: (-known[x.key(v[0])], str(v[0])))[:top]
    later = fitness(test, {x.key(t): t for t, _ in chosen}) if chosen else {}
    rows = [(t, i, known[x.key(t)], later[x.key(t)]) for t, i in chosen]
    return [{"tree": str(t), "island": i, "train_ic": a, "test_ic": b, "overfit_gap": a - b} for t, i, a, b in rows]


def beam(bars: DataFrame, wide: DataFrame, names: list[str], width: int = 3, size: int = 3) -> list[tuple[tuple[str, ...], float]]:
    """Best equal-weight combinations by |ICIR| of their ranked sum, grown one factor at a time; each step is one job."""
    beams: list[tuple[str, ...]] = [()]
    done: dict[tuple[str, ...], float] = {}
    for _ in range(size):
        trials = sorted({tuple(sorted((*b, n))) for b in beams for n in names if n not in b})
        trials = [t for t in trials if t not in done]
        if not trials:
            break
        sums = wide.select("symbol", "date", *[sum((F.coalesce(n, F.lit(0.0)) for n in t), F.lit(0.0)).alias(f"c{i}") for i, t in enumerate(trials)])
        ranked = sums.select("symbol", "date", *[rank_pct(F.col(f"c{i}"), "date").alias(f"c{i}") for i in range(len(trials))])
        got = {r["factor_name"]: r["icir"] for r in ev.batch(bars, ranked, [f"c{i}" for i in range(len(trials))]).select("factor_name", "icir").collect()}
        done |= {t: abs(got.get(f"c{i}") or 0.0) for i, t in enumerate(trials)}
        beams = sorted(trials, key=lambda t: (-done[t], t))[: max(width, 3)]
    return sorted(done.items(), key=lambda kv: (-kv[1], kv[0]))


def grid(bars: DataFrame, make, params: list[dict]) -> list[tuple[dict, float]]:
    """Parameter sets by falling |ICIR|; make(**params) -> tree. All are scored in one job."""
    trees = {f"p{i}": make(**p) for i, p in enumerate(params)}
    got = {r["factor_name"]: r["icir"] for r in ev.batch(bars, x.columns(bars, trees), list(trees)).select("factor_name", "icir").collect()}
    return sorted(((p, abs(got.get(f"p{i}") or 0.0)) for i, p in enumerate(params)), key=lambda v: -v[1])


def planted(bars: DataFrame, strength: float = 0.5) -> DataFrame:
    """symbol, date, close, beta: prices whose returns follow a hidden loading of the symbol, to test recovery."""
    unit = lambda *k: F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in k])), 1, 8), 16, 10).cast("double") / (1 << 32) - 0.5
    rows = bars.select("symbol", "date", unit("symbol").alias("beta"), unit("symbol", "date").alias("noise"))
    rows = rows.withColumn("ret", (F.col("beta") * strength + F.col("noise")) * 0.05)
    from pyspark.sql import Window as W

    by = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("symbol", "date", F.exp(F.sum(F.log1p("ret")).over(by)).alias("close"), "beta")


def attention_importance(vectors: np.ndarray) -> np.ndarray:
    """Mean attention that each of a few vectors gets from all: softmax of scaled inner products, averaged."""
    s = vectors @ vectors.T / np.sqrt(vectors.shape[1])
    w = np.exp(s - s.max(axis=1, keepdims=True))
    return (w / w.sum(axis=1, keepdims=True)).mean(axis=0)
