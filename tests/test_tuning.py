import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import production, search, tuning
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source


@pytest.fixture(scope="module")
def bars(spark, data):
    return source.bars(spark, data).persist()


@pytest.fixture(scope="module")
def planted(spark, bars):
    """Bars whose returns follow a hidden loading, and five signals, two of which hold parts of it beside noise."""
    rows = search.planted(bars, 0.3).persist()
    noise = lambda k: F.pmod(F.xxhash64("symbol", "date", F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5
    wide = rows.select("symbol", "date", (F.col("beta") + noise(1)).alias("a"), (noise(1) * 0.5 - F.col("beta") * 0.2).alias("b"), noise(3).alias("c"), noise(4).alias("d"), noise(5).alias("e"))
    return rows, wide.persist()


def test_beats_random_search_on_planted_bars(planted):
    rows, wide = planted
    names = ["a", "b", "c", "d", "e"]
    space = {n: tuning.Range(-1.0, 1.0) for n in names}
    score = lambda some: tuning.blended_scores(rows, wide, names, some)
    better = []
    for seed in range(3):
        found = tuning.search(space, score, trials=40, batch=8, seed=seed)
        rng = random.Random(seed)
        drawn = score([{k: r.drawn(rng) for k, r in space.items()} for _ in range(40)])
        assert len(found) == 40 and found[0][1] == max(s for _, s in found)
        better.append(found[0][1] - max(drawn))
    assert np.mean(better) > 0 and sum(b > 0 for b in better) >= 2


def test_repeats_by_seed_and_keeps_ranges():
    space = {"x": tuning.Range(-5, 5), "n": tuning.Range(3, 10, True), "fixed": tuning.Range(2, 2, True)}
    score = lambda some: [-((p["x"] - 2) ** 2) - abs(p["n"] - 7) for p in some]
    runs = [tuning.search(space, score, trials=60, batch=6, seed=s) for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    assert all(-5 <= p["x"] <= 5 and p["n"] in range(3, 11) and p["fixed"] == 2 for p, _ in runs[0])
    rng = random.Random(0)
    best = [max(score([{k: r.drawn(rng) for k, r in space.items()} for _ in range(60)])) for _ in range(20)]
    assert np.mean([tuning.search(space, score, trials=60, batch=6, seed=s)[0][1] for s in range(20)]) > np.mean(best)


def test_backtest_scores_equal_single_evaluations(bars):
    factor = x.columns(bars, {"factor": x.lag(-x.total(x.col("ret"), 3))})
    params = [{"groups": 3, "ahead": 1, "cut": 0.05}, {"groups": 5, "ahead": 2, "cut": 0.01}, {"groups": 3, "ahead": 4, "cut": 0.02}]
    got = tuning.backtest_scores(bars, factor, params)
    for p, s in zip(params, got, strict=True):
        panel = ev.prepare(bars, factor, p["ahead"])
        cut = panel.select("symbol", "date", "fwd_ret").join(factor.select("symbol", "date", tuning.winsorize(F.col("factor"), p["cut"]).alias("factor")), ["symbol", "date"])
        want = ev.ic_summary(ev.ic_series(cut)).first()["icir"] - 0.01 * ev.turnover(factor.na.drop(), 1 / p["groups"]).first()[0]
        assert s == pytest.approx(want)


def test_focused_fitness_equals_brute_force(spark, bars):
    trees = {"m": x.mean(x.col("ret"), 3), "v": x.col("volume"), "flat": x.col("close") * 0.0}
    days = sorted(r[0] for r in bars.select("date").distinct().collect())
    spans = [("a", days[2], days[9], 2.0), ("b", days[6], days[14], 0.5), ("none", days[5], days[4], 9.0)]
    windows = spark.createDataFrame(spans, "window string, start date, end date, weight double")
    got = {r.factor_name: (r.ic, r.n_dates) for r in production.focused(bars, trees, windows).collect()}
    pdf = bars.select("symbol", "date", "close", "volume", "ret").toPandas().sort_values(["symbol", "date"])
    by = pdf.groupby("symbol")
    pdf["fwd"] = by["close"].transform(lambda c: (c / c.shift(1) - 1).shift(-1))
    pdf["m"] = by["ret"].transform(lambda c: c.rolling(3).mean().shift(1))
    pdf["v"] = by["volume"].shift(1)
    for name in ("m", "v"):
        total = weight = n = 0
        for day, g in pdf.dropna(subset=[name, "fwd"]).groupby("date"):
            w = float(np.prod([s[3] for s in spans if s[1] <= day <= s[2]])) if any(s[1] <= day <= s[2] for s in spans) else 0
            ic = g[name].corr(g["fwd"]) if len(g) > 1 else np.nan
            if w and np.isfinite(ic):
                total, weight, n = total + w * ic, weight + w, n + 1
        assert got[name] == (pytest.approx(total / weight), n)
    assert "flat" not in got


def test_production_keeps_each_tree_once(spark, bars):
    P = x.col("ret")
    clusters = {"trend": [x.mean(P, 5), x.mean(P, 10)], "volume": [x.mean(x.col("volume"), 5), x.mean(P, 5)], "empty": []}
    first = production.produced(bars, clusters, population=4, generations=1, per_cluster=2)
    rows = first.collect()
    assert rows and len({r.digest for r in rows}) == len(rows) and {r.cluster for r in rows} <= {"trend", "volume"}
    assert all(r.fitness > production.LEAST + production.BONUS for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, production.produced(bars, clusters, population=4, generations=1, per_cluster=2).collect()))
    r = rows[0]
    fresh = spark.createDataFrame([(r.digest, "x", r.tree, 9.0, None), ("new", "x", "t", 1.0, 0.0)], first.schema)
    held = {k.digest: k.fitness for k in production.kept(first, fresh).collect()}
    assert len(held) == len(rows) + 1 and held[r.digest] == 9.0
    days = sorted(d[0] for d in bars.select("date").distinct().collect())
    windows = spark.createDataFrame([("a", days[0], days[len(days) // 2], 1.0)], "window string, start date, end date, weight double")
    assert production.produced(bars, {"trend": [x.mean(P, 5)]}, windows, population=3, generations=1, per_cluster=1).schema == first.schema


def test_quotient_by_zero_is_null(spark):
    df = spark.createDataFrame([("s", datetime.date(2022, 1, 1), 1.0, 0.0), ("s", datetime.date(2022, 1, 2), 1.0, 2.0)], "symbol string, date date, a double, b double")
    a, b = x.col("a"), x.col("b")
    got = [r.q for r in x.columns(df, {"q": a / (b * (b / b) + 1e-12)}).orderBy("date").collect()]
    assert got == [None, pytest.approx(0.5)]
