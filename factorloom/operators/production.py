"""Evolution within event windows and by clusters of factors, and the store that keeps what it finds.

A generation of all clusters is scored in one job. The fitness of a tree is its information coefficient a date, weighted by the event windows
that the date lies in (weights of several windows multiply), over dates within windows only if there are any, plus a small bonus for trees that
grow from a cluster's own factors.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.expr import E

from . import evaluate as ev
from . import search, store
from .align import in_windows

#: What a cluster's trees have on top, the windows that trees are tried with, and the fitness that earns a place in the store.
BONUS, WINDOWS, LEAST = 0.005, (3, 5, 10, 20, 30, 60), 0.005


def date_weights(windows: DataFrame, dates: DataFrame) -> DataFrame:
    """(window, start, end, weight), dates -> date, weight: the product over the windows that a date lies in; other dates have none."""
    held = in_windows(dates.select("date").distinct(), windows)
    # a product by logarithms: weights are over 0
    return held.groupBy("date").agg(F.exp(F.sum(F.ln("weight"))).alias("weight"))


def focused(bars: DataFrame, trees: dict[str, E], windows: DataFrame | None = None) -> DataFrame:
    """factor_name, ic (weighted mean over dates), n_dates, of lagged trees; those without a coefficient have no row."""
    wide = x.columns(bars, {k: x.lag(t) for k, t in trees.items()})
    ret = F.try_divide(F.col("close"), F.lag("close").over(ev.by_symbol())) - 1
    ahead = bars.select("symbol", "date", ret.alias("ret")).select("symbol", "date", F.lead("ret").over(ev.by_symbol()).alias("fwd_ret"))
    rows = ev.unfolded(wide.join(ahead, ["symbol", "date"]), list(trees))
    if windows is None:
        series = ev.ic_series(rows, ("factor_name",)).withColumn("weight", F.lit(1.0))
    else:
        series = ev.ic_series(rows, ("factor_name",)).join(date_weights(windows, bars), "date")
    mean = F.try_divide(F.sum(F.col("ic") * F.col("weight")), F.sum("weight"))
    return series.groupBy("factor_name").agg(mean.alias("ic"), F.count(F.lit(1)).alias("n_dates")).filter("ic IS NOT NULL")


def scored(bars: DataFrame, trees: dict[str, E], windows: DataFrame | None, known: dict[str, float]) -> None:
    """Adds to known the |ic| of trees that aren't there, WORST without one; one job."""
    fresh = {k: t for k, t in trees.items() if k not in known}
    if fresh:
        got = {r["factor_name"]: r["ic"] for r in focused(bars, fresh, windows).collect()}
        known.update({k: abs(got[k]) if k in got else search.WORST for k in fresh})


def with_window(t: E, n: int) -> E:
    """The tree with all its rolling windows set to n bars; the least number of bars falls with them."""
    args = tuple(with_window(a, n) for a in t.args)
    rolls = t.op not in ("lag", "lead") and t.n is not None and t.n > 1
    return E(t.op, args, n if rolls else t.n, min(t.least, n) if rolls and t.least is not None else t.least, t.value)


def produced(bars: DataFrame, clusters: dict[str, list[E]], windows: DataFrame | None = None, seed: int = 7, population: int = 8, generations: int = 2, depth: int = 3, per_cluster: int = 5, test_share: float = 0.2) -> DataFrame:
    """digest, cluster, tree, fitness, test, of the trees worth keeping, by cluster's evolution and variation of their windows.

    Clusters evolve apart from their own factors and random trees on the earlier dates; the best of each are tried with all WINDOWS, then those
    with a fitness over LEAST are scored on the later dates. Equal trees, by canonical text, are one, of the first cluster by name.
    """
    spark = bars.sparkSession
    train, test = search.cut_dates(bars, test_share)
    known: dict[str, float] = {}
    names = sorted(c for c in clusters if clusters[c])
    rngs = {c: random.Random(f"{seed}:{c}") for c in names}
    pools = {c: [*clusters[c], *[search.random_tree(rngs[c], depth) for _ in range(max(0, population - len(clusters[c])))]] for c in names}
    fit = lambda pool: {x.key(t): t for t in pool if not x.lookahead(t)}
    for g in range(generations + 1):
        scored(train, {k: t for c in names for k, t in fit(pools[c]).items()}, windows, known)
        if g < generations:
            for c in names:
                # the bonus lifts the whole cluster, so the order within it is that of the coefficients
                if ranked := search.by_fitness(pools[c], known):
                    pools[c] = search.next_pool(rngs[c], ranked, known, population, depth, 2)
    best = {c: search.by_fitness(pools[c], known)[:per_cluster] for c in names}
    varied = {c: [*best[c], *[with_window(t, n) for t in best[c] for n in WINDOWS]] for c in names}
    scored(train, {k: t for c in names for k, t in fit(varied[c]).items()}, windows, known)
    found: dict[str, tuple[str, E]] = {}
    for c in names:
        for k, t in fit(varied[c]).items():
            if known[k] > LEAST:
                found.setdefault(k, (c, t))
    later: dict[str, float] = {}
    scored(test, {k: t for k, (_, t) in found.items()}, None, later)
    rows = [(digest(t), c, str(t), known[k] + BONUS, later[k] if later[k] > search.WORST else None) for k, (c, t) in sorted(found.items())]
    return spark.createDataFrame(rows, "digest string, cluster string, tree string, fitness double, test double")


def digest(t: E) -> str:
    return hashlib.md5(x.key(t).encode()).hexdigest()


def kept(held: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The store of trees by digest after fresh ones: new scores replace those of equal trees."""
    return fresh if held is None else store.upsert(held, fresh, "digest")
