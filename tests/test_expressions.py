"""Window operators and factors against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest

from factorloom.functions import cross
from factorloom.functions import expr as x
from factorloom.operators import factors


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))
        for i in range(90):
            o = close[i] * (1 + rng.normal(0, 0.01))
            rows.append((f"S{s}", datetime.date(2020, 1, 1) + datetime.timedelta(i), o, max(o, close[i]) * 1.01, min(o, close[i]) * 0.99, close[i], float(rng.integers(1, 50)), 0.0))
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume", "amount"])
    pdf["amount"] = pdf.close * pdf.volume
    pdf["ret"] = pdf.groupby("symbol").close.pct_change()
    pdf["pct_chg"] = pdf.ret * 100
    return pdf, spark.createDataFrame(pdf)


def got(frame, tree):
    out = x.columns(frame, {"v": tree}).toPandas().sort_values(["symbol", "date"]).v.to_numpy(float)
    return out


def same(a, b):
    np.testing.assert_allclose(a, np.asarray(b, float), rtol=1e-8, atol=1e-10, equal_nan=True)


def by(pdf, f):
    return pdf.sort_values(["symbol", "date"]).groupby("symbol", group_keys=False).apply(f, include_groups=False)


def test_rolling_moments(panel):
    pdf, df = panel
    same(got(df, x.skew(factors.R, 20)), by(pdf, lambda g: g.close.pct_change().rolling(20).skew()))
    same(got(df, x.kurt(factors.R, 20)), by(pdf, lambda g: g.close.pct_change().rolling(20).kurt()))
    same(got(df, x.corr(factors.C, factors.V, 20)), by(pdf, lambda g: g.close.rolling(20).corr(g.volume)))
    same(got(df, x.rank(factors.V, 10, 5)), by(pdf, lambda g: g.volume.rolling(10, min_periods=5).rank(pct=True)))


def test_exponential(panel):
    pdf, df = panel
    same(got(df, x.ema(factors.C, 12)), by(pdf, lambda g: g.close.ewm(span=12, adjust=False).mean()))


def test_rsi(panel):
    pdf, df = panel

    def rsi(g):
        d = g.close.diff()
        up, down = d.where(d > 0, 0.0).rolling(14).mean(), (-d.where(d < 0, 0.0)).rolling(14).mean()
        return ((100 - 100 / (1 + up / (down + 1e-8))) / 100).shift(1)

    same(got(df, factors.LIBRARY["rsi_14d"].tree), by(pdf, rsi))


def test_drawdown_and_streak(panel):
    pdf, df = panel
    same(got(df, x.maxdd(factors.C, 20)), by(pdf, lambda g: g.close.rolling(20).apply(lambda w: ((np.maximum.accumulate(w) - w) / (np.maximum.accumulate(w) + 1e-8)).max(), raw=True)))
    flag = lambda g: (g.close > g.close.shift(1)).astype(int)
    same(got(df, x.streak(factors.UP)), by(pdf, lambda g: flag(g) * (flag(g).groupby((flag(g) != flag(g).shift()).cumsum()).cumcount() + 1)))


def test_library():
    assert len(factors.LIBRARY) == 62
    counts = pd.Series([f.category for f in factors.LIBRARY.values()]).value_counts()
    assert [counts[c] for c in (factors.TREND, factors.VOLATILITY, factors.TRADING, factors.DIVERGENCE, factors.FORMULA)] == [19, 13, 10, 9, 11]
    assert not any(x.lookahead(f.tree) for f in factors.LIBRARY.values())
    assert x.lookahead(x.lead(factors.C)) and x.lookahead(x.lag(factors.C, -1) + 1)


def test_qcut_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": np.repeat(range(8), 30), "v": rng.integers(0, 6, 240).astype(float)})
    pdf.loc[pdf.date == 7, "v"] = 1.0
    pdf["i"] = range(len(pdf))
    out = spark.createDataFrame(pdf).select("i", cross.qcut(cross.F.col("v")).alias("g")).toPandas().sort_values("i").g.to_numpy(float)
    want = pdf.groupby("date").v.transform(lambda v: pd.qcut(v, 5, labels=False, duplicates="drop"))
    np.testing.assert_array_equal(out, want.to_numpy(float))


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 6.0), (2, 1.0, 1.0), (2, 2.0, 3.0), (2, None, 9.0)], "g int, a double, b double")
    rows = {r.g: r.c for r in df.groupBy("g").agg(cross.safe_corr(cross.F.col("a"), cross.F.col("b")).alias("c")).collect()}
    assert rows[1] is None and rows[2] == pytest.approx(1.0)


def test_exponential_of_long_series_with_gaps(spark):
    """Series over many stretches of decay, with values missing at the start, the end and between, as pandas has them."""
    rng = np.random.default_rng(8)
    day = datetime.date(2000, 1, 1)
    rows = []
    for s, n in (("long", 3000), ("short", 5), ("none", 4)):
        for i in range(n):
            v = float(rng.normal() * 10.0 ** int(rng.integers(-3, 4))) if s != "none" and i > 1 and rng.random() > 0.2 and not 1000 < i < 1700 else None
            rows.append((s, day + datetime.timedelta(i), v))
    df = spark.createDataFrame(rows, "symbol string, date date, v double")
    spans = (1, 2, 5, 12, 60)
    got = x.columns(df, {f"e{n}": x.ema(x.col("v"), n) for n in spans}).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "v"]).sort_values(["symbol", "date"]).reset_index(drop=True)
    for n in spans:
        want = pdf.groupby("symbol")["v"].transform(lambda v, n=n: v.astype(float).ewm(span=n, adjust=False).mean())
        assert np.allclose(got[f"e{n}"].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rolling_covariance(spark):
    rng = np.random.default_rng(9)
    day = datetime.date(2000, 1, 1)
    rows = [("s", day + datetime.timedelta(i), float(rng.normal()), float(rng.normal()) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double")
    got = x.columns(df, {"c": x.cov(x.col("a"), x.col("b"), 10, 3)}).orderBy("date").toPandas()["c"].to_numpy(float)
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "a", "b"])
    a = pdf["a"].where(pdf["b"].notna())
    assert np.allclose(got, a.rolling(10, min_periods=3).cov(pdf["b"].astype(float)).to_numpy(float), equal_nan=True)
