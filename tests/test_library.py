"""Library factors against plain pandas formulas, one symbol at a time."""

import datetime

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import factors

EPS = 1e-8


@pytest.fixture(scope="module")
def computed(spark):
    rng = np.random.default_rng(12)
    frames = []
    for s in range(4):
        n = 110
        close = 80 * np.exp(np.cumsum(rng.normal(0, 0.04, n)))
        open_ = close * (1 + rng.normal(0, 0.02, n))
        g = pd.DataFrame({"symbol": f"S{s}", "date": [datetime.date(2022, 1, 1) + datetime.timedelta(i) for i in range(n)], "open": open_, "close": close})
        g["high"], g["low"] = g[["open", "close"]].max(axis=1) * (1 + rng.random(n) * 0.02), g[["open", "close"]].min(axis=1) * (1 - rng.random(n) * 0.02)
        g["volume"] = rng.integers(1, 90, n).astype(float)
        g["amount"] = g.close * g.volume * (1 + rng.normal(0, 0.01, n))
        g["pct_chg"] = g.close.pct_change() * 100
        frames.append(g)
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf)
    df = df.withColumn("pct_chg", factors.F.when(~factors.F.isnan("pct_chg"), factors.F.col("pct_chg")))
    return pdf, factors.compute(df).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def ema(x, n):
    return x.ewm(span=n, adjust=False).mean()


def true_range(g):
    before = g.close.shift(1)
    return pd.concat([g.high - g.low, (g.high - before).abs(), (g.low - before).abs()], axis=1).max(axis=1)


def rsi(x):
    d = x.diff()
    up, down = d.clip(lower=0).fillna(0.0).rolling(14).mean(), (-d.clip(upper=0)).fillna(0.0).rolling(14).mean()
    return (100 - 100 / (1 + up / (down + EPS))) / 100


def vw(g, n):
    return (g.close * g.volume).rolling(n).sum() / (g.volume.rolling(n).sum() + EPS)


def clv(g):
    return ((g.close - g.low) - (g.high - g.close)) / (g.high - g.low + EPS)


def obv(g):
    return (g.volume * np.sign(g.close.diff()).fillna(0)).cumsum()


def mfi(g):
    tp = (g.high + g.low + g.close) / 3
    d, flow = tp.diff(), tp * g.volume
    return (100 - 100 / (1 + flow.where(d > 0, 0.0).rolling(14).sum() / (flow.where(d < 0, 0.0).rolling(14).sum() + EPS))) / 100


def keltner(g):
    mid, atr = ema(g.close, 20), true_range(g).rolling(20).mean()
    up, low = mid + 2 * atr, mid - 2 * atr
    return (g.close - low) / (up - low + EPS)


def turn(g, n):
    return g.amount / (g.amount.rolling(n).mean() + EPS)


def macd(g):
    dif = ema(g.close, 12) - ema(g.close, 26)
    return (dif - ema(dif, 9)) / (g.close + EPS)


def eom(g):
    mid = (g.high + g.low) / 2
    box = (g.amount / (g.volume + EPS)) / (g.high - g.low + EPS)
    return (mid.diff() / (box + EPS)).rolling(14).mean()


def ret(g):
    return g.close.pct_change()


UNLAGGED = {
    "momentum_5d": lambda g: (g.pct_chg / 100).rolling(5).sum(),
    "momentum_60d": lambda g: (g.pct_chg / 100).rolling(60).sum(),
    "reversal_1d": lambda g: -g.pct_chg / 100,
    "reversal_10d": lambda g: -(g.pct_chg / 100).rolling(10).sum(),
    "ma_cross_5_20": lambda g: (g.close.rolling(5).mean() - g.close.rolling(20).mean()) / (g.close.rolling(20).mean() + EPS),
    "close_to_high_20d": lambda g: (g.close - g.low.rolling(20).min()) / (g.high.rolling(20).max() - g.low.rolling(20).min() + EPS),
    "trend_strength_20d": lambda g: ret(g).rolling(20).sum() / (ret(g).rolling(20).std() + EPS),
    "rsi_14d": lambda g: rsi(g.close),
    "macd_signal": macd,
    "realized_vol_20d": lambda g: -ret(g).rolling(20).std(),
    "parkinson_vol_20d": lambda g: -np.sqrt((np.log(g.high / (g.low + EPS)) ** 2).rolling(20).mean() / (4 * np.log(2))),
    "gk_vol_20d": lambda g: -np.sqrt((0.5 * np.log(g.high / (g.low + EPS)) ** 2 - (2 * np.log(2) - 1) * np.log(g.close / (g.open + EPS)) ** 2).rolling(20).mean()),
    "atr_14d": lambda g: -true_range(g).rolling(14).mean() / (g.close + EPS),
    "skewness_20d": lambda g: -ret(g).rolling(20).skew(),
    "kurtosis_20d": lambda g: -ret(g).rolling(20).kurt(),
    "vol_of_vol_20d": lambda g: -ret(g).rolling(5).std().rolling(20).std(),
    "downside_vol_20d": lambda g: -ret(g).where(ret(g) < 0, 0.0).rolling(20).std(),
    "up_down_vol_ratio_20d": lambda g: -ret(g).where(ret(g) > 0, 0.0).rolling(20).std() / ((-ret(g)).where(ret(g) < 0, 0.0).rolling(20).std() + EPS),
    "jump_risk_20d": lambda g: -((g.pct_chg / 100) < -0.03).astype(float).rolling(20).sum(),
    "amplitude_20d": lambda g: -((g.high - g.low) / (g.close + EPS)).rolling(20).mean(),
    "turnover_5d": lambda g: -turn(g, 20).rolling(5).mean(),
    "turnover_20d": lambda g: -turn(g, 60).rolling(20).mean(),
    "turnover_change_5d": lambda g: -(turn(g, 20) - turn(g, 20).rolling(5).mean()) / (turn(g, 20).rolling(5).mean() + EPS),
    "amihud_illiquidity_20d": lambda g: (ret(g).abs() / (g.volume * g.close + EPS)).rolling(20).mean(),
    "dollar_volume_20d": lambda g: -np.log1p((g.close * g.volume).rolling(20).mean()),
    "limit_up_touch_20d": lambda g: -(g.pct_chg >= 9.5).astype(float).rolling(20).sum(),
    "volume_concentration_20d": lambda g: -g.volume.rolling(20).max() / (g.volume.rolling(20).sum() + EPS),
    "price_volume_corr_20d": lambda g: ret(g).rolling(20).corr(g.volume.pct_change()),
    "volume_delta_price_20d": lambda g: -(g.volume.pct_change(20) - g.close.pct_change(20)),
    "obv_momentum_20d": lambda g: (obv(g) / obv(g).shift(20) - 1).replace([np.inf, -np.inf], np.nan),
    "vwap_deviation_5d": lambda g: (g.close - vw(g, 5)) / (vw(g, 5) + EPS),
    "mfi_14d": lambda g: -mfi(g),
    "volume_price_ratio_20d": lambda g: g.close.pct_change(20).abs() / (g.volume.pct_change(20).abs() + EPS),
    "volume_breakout_5d": lambda g: -(g.volume / (g.volume.rolling(20).mean() + EPS) - 1),
    "up_volume_ratio_20d": lambda g: (g.volume * (g.close > g.close.shift(1))).rolling(20).sum() / (g.volume.rolling(20).sum() + EPS),
    "net_flow_pressure_5d": lambda g: (g.amount * (2 * (g.close > g.close.shift(1)).astype(float) - 1)).rolling(5).sum() / (g.amount.rolling(5).sum() + EPS),
    "vcmf_20d": lambda g: (clv(g) * g.volume).rolling(20).sum() / (g.volume.rolling(20).sum() + EPS),
    "eom_14d": eom,
    "vwma_ratio_5_20": lambda g: vw(g, 5) / (vw(g, 20) + EPS) - 1,
    "keltner_pct_20d": keltner,
    "pvo_12_26": lambda g: ema(g.volume, 12) / (ema(g.volume, 26) + EPS) - 1,
    "vrsi_14d": lambda g: -rsi(g.volume),
    "volume_weighted_close_10d": lambda g: vw(g, 10) / (g.close.shift(1) + EPS) - 1,
    "bollinger_pct_20d": lambda g: (g.close - (g.close.rolling(20).mean() - 2 * g.close.rolling(20).std())) / (4 * g.close.rolling(20).std() + EPS),
    "bollinger_width_20d": lambda g: -4 * g.close.rolling(20).std() / (g.close.rolling(20).mean() + EPS),
    "ad_line_20d": lambda g: (clv(g) * g.volume).rolling(20).mean() / (g.volume + EPS),
    "force_index_13d": lambda g: ema(g.close.diff() * g.volume, 13) / (g.volume.rolling(20).mean() + EPS),
}


@pytest.mark.parametrize("name", sorted(UNLAGGED))
def test_formula(computed, name):
    pdf, got = computed
    want = pd.concat([UNLAGGED[name](g).shift(1) for _, g in pdf.groupby("symbol")], ignore_index=True)
    assert want.notna().any()
    np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-7, atol=1e-9, equal_nan=True)
