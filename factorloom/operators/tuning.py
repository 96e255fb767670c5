"""Searching parameters by a tree-structured Parzen estimator; a batch of proposals is scored in one Spark job.

Finished trials are parted into the best ones and the others. Each parameter's values among the best make one density, among the others a
second one: Gaussians around the values and a wide one around the middle of the range, cut off at its ends. Values are drawn from the first density, and
of the draws the one with the greatest ratio of both densities, over all parameters, is proposed. Proposals of a batch that aren't scored
yet count among the others, so that a batch spreads. The driver holds the trials, which are a few hundred at most; rows stay in Spark.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.cross import winsorize  # noqa: F401

from . import evaluate as ev

WORST = -1e9


@dataclass(frozen=True)
class Range:
    """A parameter between low and high, both included; whole: integers only."""

    low: float
    high: float
    whole: bool = False

    def drawn(self, rng: random.Random) -> float:
        return rng.randint(int(self.low), int(self.high)) if self.whole else rng.uniform(self.low, self.high)

    def fit(self, v: float) -> float:
        v = min(max(v, self.low), self.high)
        return int(round(v)) if self.whole else float(v)


class Density:
    """Gaussians around values and a wide one around the middle."""

    def __init__(self, values: list[float], of: Range):
        width = (of.high - of.low) or 1.0
        at = np.array([*values, (of.low + of.high) / 2], float)
        order = np.sort(at)
        # each is as wide as the way to its neighbours, within bounds that narrow as values gather
        gaps = np.array([max(order[min(i + 1, len(order) - 1)] - order[i], order[i] - order[max(i - 1, 0)]) for i in np.searchsorted(order, at)])
        self.of, self.at = of, at
        self.sd = np.clip(gaps, width / min(100, len(at) + 1), width)
        self.sd[-1] = width

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.at))
        return self.of.fit(rng.gauss(self.at[i], self.sd[i]))

    def log(self, v: float) -> float:
        z = (v - self.at) / self.sd
        return float(np.log(np.mean(np.exp(-z * z / 2) / self.sd) + 1e-300))


Trial = tuple[dict[str, float], float]


def proposals(rng: random.Random, space: dict[str, Range], done: list[Trial], n: int, share: float = 0.2, draws: int = 24) -> list[dict[str, float]]:
    """n parameter sets worth trying after the trials done."""
    ranked = sorted(done, key=lambda t: -t[1])
    best = ranked[: max(2, int(np.ceil(share * len(ranked))))]
    rest = [p for p, _ in ranked[len(best) :]]
    out: list[dict[str, float]] = []
    for _ in range(n):
        good = {k: Density([p[k] for p, _ in best], r) for k, r in space.items()}
        poor = {k: Density([p[k] for p in [*rest, *out]], r) for k, r in space.items()}
        tried = [{k: good[k].draw(rng) for k in space} for _ in range(draws)]
        out.append(max(tried, key=lambda p: sum(good[k].log(p[k]) - poor[k].log(p[k]) for k in space)))
    return out


def search(space: dict[str, Range], score: Callable[[list[dict[str, float]]], list[float]], trials: int = 32, batch: int = 8, startup: int = 8, seed: int = 0) -> list[Trial]:
    """All trials by falling score, ties in the order they were made. score takes a batch; the first `startup` are drawn evenly."""
    rng = random.Random(seed)
    done: list[Trial] = []
    while len(done) < trials:
        n = min(batch, trials - len(done))
        if len(done) < startup:
            some = [{k: r.drawn(rng) for k, r in space.items()} for _ in range(min(n, startup - len(done)))]
        else:
            some = proposals(rng, space, done, n)
        done += list(zip(some, score(some), strict=True))
    return sorted(done, key=lambda t: -t[1])


#: The ways to test a factor that are searched: groups, bars ahead, and the share cut off at either end.
BACKTEST = {"groups": Range(3, 10, True), "ahead": Range(1, 5, True), "cut": Range(0.005, 0.05)}


def backtest_scores(bars: DataFrame, factor: DataFrame, params: list[dict[str, float]]) -> list[float]:
    """ICIR of the factor, cut within dates, with the return of the bar `ahead`, less a hundredth of the turnover of the top group; one job for all.

    The quantiles of all cuts are one aggregate, of a row a date, which goes to the rows; the tops of all numbers of groups come from one ranking.
    """
    later = sorted({int(p["ahead"]) for p in params})
    panel = bars.select("symbol", "date", F.try_divide(F.col("close"), F.lag("close").over(ev.by_symbol())).alias("r"))
    panel = panel.select("symbol", "date", *[(F.lead("r", h).over(ev.by_symbol()) - 1).alias(f"ahead{h}") for h in later]).join(factor.select("symbol", "date", "factor"), ["symbol", "date"])
    at = sorted({q for p in params for q in (float(p["cut"]), 1 - float(p["cut"]))})
    edges = panel.groupBy(F.col("date").alias("_date")).agg(F.percentile("factor", F.array(*[F.lit(q) for q in at])).alias("_edges"))
    panel = panel.join(F.broadcast(edges), F.col("date") == F.col("_date"))
    edge = lambda q: F.get("_edges", at.index(q))
    clipped = lambda c: F.when(F.col("factor").isNotNull(), F.greatest(edge(c), F.least(edge(1 - c), F.col("factor"))))
    cut = panel.select("symbol", "date", *[f"ahead{h}" for h in later], *[clipped(float(p["cut"])).alias(f"cut{i}") for i, p in enumerate(params)])
    each = F.array(*[F.struct(F.lit(i).alias("trial"), F.col(f"cut{i}").alias("factor"), F.col(f"ahead{int(p['ahead'])}").alias("fwd_ret")) for i, p in enumerate(params)])
    long = cut.select("symbol", "date", F.explode(each).alias("t")).select("symbol", "date", "t.*").na.drop(subset=["factor", "fwd_ret"])
    got = ev.ic_summary(ev.ic_series(long, ("trial",)), ("trial",)).select("trial", "icir")
    groups = sorted({int(p["groups"]) for p in params})
    moved = ev.turnovers(factor.na.drop(subset=["factor"]), {f"g{q}": 1 / q for q in groups})
    icir = {r["trial"]: r["icir"] for r in got.collect()}
    turn = {q: r[f"g{q}"] or 0.0 for r in moved.collect() for q in groups}
    return [(icir[i] if icir.get(i) is not None else WORST) - 0.01 * turn[int(p["groups"])] for i, p in enumerate(params)]


def blended_scores(bars: DataFrame, wide: DataFrame, names: list[str], params: list[dict[str, float]]) -> list[float]:
    """|ICIR| of the sum of factors with the weights of each parameter set; one job for all."""
    sums = wide.select("symbol", "date", *[sum((F.coalesce(F.col(n), F.lit(0.0)) * float(p[n]) for n in names), F.lit(0.0)).alias(f"c{i}") for i, p in enumerate(params)])
    got = {r["factor_name"]: r["icir"] for r in ev.batch(bars, sums, [f"c{i}" for i in range(len(params))]).select("factor_name", "icir").collect()}
    return [abs(got[f"c{i}"]) if got.get(f"c{i}") is not None else WORST for i in range(len(params))]
