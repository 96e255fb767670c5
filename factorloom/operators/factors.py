"""The factor library: 62 factors as expression trees, with templates, the zoo and the raw pool.

Every library factor ends in a lag of one bar, so that it is known before the bar it stands at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.functions.expr import E, col, corr, cumsum, ema, fill, high, kurt, lag, ln, log1p, low, maxdd, mean, skew, slope, sqrt, std, streak, total, where, xs_mean

O, H, L, C, V, A, PCT = (col(k) for k in ("open", "high", "low", "close", "volume", "amount", "pct_chg"))
P = PCT / 100
R = C / lag(C) - 1
EPS = 1e-8
UP = where(C > lag(C), 1, 0)
DIFF = C - lag(C)
TRUE_RANGE = x.greatest(H - L, x.absolute(H - lag(C)), x.absolute(L - lag(C)))
TYPICAL = (H + L + C) / 3
CLV = ((C - L) - (H - C)) / (H - L + EPS)
LN2 = 0.6931471805599453


def change(v: E, n: int = 1) -> E:
    return v / lag(v, n) - 1


def weighted(v: E, w: E, n: int) -> E:
    return total(v * w, n) / (total(w, n) + EPS)


def strength(v: E, n: int) -> E:
    """Relative strength: share of rises among the moves of v, 0 to 1."""
    d = v - lag(v)
    gain, loss = where(d > 0, d, 0), where(d < 0, -d, 0)
    return (100 - 100 / (1 + mean(gain, n) / (mean(loss, n) + EPS))) / 100


def money_flow(n: int) -> E:
    d = TYPICAL - lag(TYPICAL)
    flow = TYPICAL * V
    up, down = where(d > 0, flow, 0), where(d < 0, flow, 0)
    return (100 - 100 / (1 + total(up, n) / (total(down, n) + EPS))) / 100


TURN20, TURN60 = A / (mean(A, 20) + EPS), A / (mean(A, 60) + EPS)
BODY, RANGE = ln(C / (O + EPS)), ln(H / (L + EPS))
DIF = ema(C, 12) - ema(C, 26)
BALANCE = cumsum(V * where(C > lag(C), 1, where(C < lag(C), -1, 0)))
BOX = (A / (V + EPS)) / (H - L + EPS)
MID = (H + L) / 2
BAND = 2 * mean(TRUE_RANGE, 20)


class Factor(NamedTuple):
    name: str
    category: str
    direction: str
    quality: float
    tree: E


TREND, VOLATILITY, TRADING, DIVERGENCE, FORMULA = "trend", "volatility", "trading", "price_volume", "formula"


def _library() -> list[Factor]:
    out = []

    def add(category, name, quality, tree, direction="positive"):
        out.append(Factor(name, category, direction, quality, tree))

    for n, q in ((5, 0.6), (10, 0.65), (20, 0.75), (60, 0.55)):
        add(TREND, f"momentum_{n}d", q, lag(total(P, n)))
    add(TREND, "momentum_residual_20d", 0.7, lag(total(R - xs_mean(R), 20)))
    add(TREND, "reversal_1d", 0.8, lag(-P))
    for n, q in ((5, 0.7), (10, 0.6)):
        add(TREND, f"reversal_{n}d", q, lag(-total(P, n)))
    for a, b, q in ((5, 20, 0.55), (10, 60, 0.5), (20, 60, 0.55)):
        add(TREND, f"ma_cross_{a}_{b}", q, lag((mean(C, a) - mean(C, b)) / (mean(C, b) + EPS)))
    for n, q in ((20, 0.65), (60, 0.6)):
        add(TREND, f"close_to_high_{n}d", q, lag((C - low(L, n)) / (high(H, n) - low(L, n) + EPS)))
    add(TREND, "max_up_consecutive", 0.5, fill(lag(streak(UP)), 0))
    add(TREND, "breakout_20d_high", 0.55, fill(lag(where(C >= high(H, 20), 1, 0)), 0))
    add(TREND, "trend_strength_20d", 0.6, lag(total(R, 20) / (std(R, 20) + EPS)))
    add(TREND, "rsi_14d", 0.55, lag(strength(C, 14)))
    add(TREND, "macd_signal", 0.5, lag((DIF - ema(DIF, 9)) / (C + EPS)))
    add(TREND, "path_dependency_maxdd_20d", 0.6, lag(maxdd(C, 20)))

    def vol(name, quality, tree):
        add(VOLATILITY, name, quality, -lag(tree), "negative")

    for n, q in ((5, 0.65), (20, 0.8), (60, 0.6)):
        vol(f"realized_vol_{n}d", q, std(R, n))
    vol("parkinson_vol_20d", 0.7, sqrt(mean(RANGE * RANGE, 20) / (4 * LN2)))
    vol("gk_vol_20d", 0.7, sqrt(mean(0.5 * (RANGE * RANGE) - (2 * LN2 - 1) * (BODY * BODY), 20)))
    vol("atr_14d", 0.65, mean(TRUE_RANGE, 14) / (C + EPS))
    vol("skewness_20d", 0.65, skew(R, 20))
    vol("kurtosis_20d", 0.55, kurt(R, 20))
    vol("vol_of_vol_20d", 0.6, std(std(R, 5), 20))
    vol("downside_vol_20d", 0.7, std(where(R < 0, R, 0), 20))
    vol("up_down_vol_ratio_20d", 0.65, std(where(R > 0, R, 0), 20) / (std(where(R < 0, -R, 0), 20) + EPS))
    vol("jump_risk_20d", 0.55, total(where(P < -0.03, 1, 0), 20))
    vol("amplitude_20d", 0.55, mean((H - L) / (C + EPS), 20))

    def trading(name, quality, tree, direction="negative"):
        add(TRADING, name, quality, -lag(tree) if direction == "negative" else lag(tree), direction)

    trading("turnover_5d", 0.7, mean(TURN20, 5))
    trading("turnover_20d", 0.8, mean(TURN60, 20))
    trading("turnover_change_5d", 0.65, (TURN20 - mean(TURN20, 5)) / (mean(TURN20, 5) + EPS))
    trading("amihud_illiquidity_20d", 0.75, mean(x.absolute(R) / (V * C + EPS), 20), "positive")
    trading("dollar_volume_20d", 0.7, log1p(mean(C * V, 20)))
    trading("high_low_spread_20d", 0.6, mean((H - L) / (C + EPS), 20))
    trading("limit_up_touch_20d", 0.6, total(where(PCT >= 9.5, 1, 0), 20))
    trading("limit_down_touch_20d", 0.65, total(where(PCT <= -9.5, 1, 0), 20))
    trading("volume_concentration_20d", 0.55, high(V, 20) / (total(V, 20) + EPS))
    trading("zero_volume_days_20d", 0.55, total(where(V < 1e-6, 1, 0), 20))

    def pv(name, quality, tree, direction="positive"):
        add(DIVERGENCE, name, quality, -lag(tree) if direction == "negative" else lag(tree), direction)

    pv("price_volume_corr_20d", 0.7, corr(R, change(V), 20))
    pv("volume_delta_price_20d", 0.65, change(V, 20) - change(C, 20), "negative")
    pv("obv_momentum_20d", 0.65, change(BALANCE, 20))
    pv("vwap_deviation_5d", 0.6, (C - weighted(C, V, 5)) / (weighted(C, V, 5) + EPS))
    pv("mfi_14d", 0.55, money_flow(14), "negative")
    pv("volume_price_ratio_20d", 0.6, x.absolute(change(C, 20)) / (x.absolute(change(V, 20)) + EPS))
    pv("volume_breakout_5d", 0.6, V / (mean(V, 20) + EPS) - 1, "negative")
    pv("up_volume_ratio_20d", 0.65, total(V * UP, 20) / (total(V, 20) + EPS))
    pv("net_flow_pressure_5d", 0.6, total(A * (2 * UP - 1), 5) / (total(A, 5) + EPS))

    def formula(name, quality, tree, direction="positive"):
        add(FORMULA, name, quality, lag(tree) if direction == "positive" else -lag(tree), direction)

    formula("vcmf_20d", 0.65, total(CLV * V, 20) / (total(V, 20) + EPS))
    formula("eom_14d", 0.6, mean((MID - lag(MID)) / (BOX + EPS), 14))
    formula("vwma_ratio_5_20", 0.6, weighted(C, V, 5) / (weighted(C, V, 20) + EPS) - 1)
    formula("keltner_pct_20d", 0.55, (C - (ema(C, 20) - BAND)) / ((ema(C, 20) + BAND) - (ema(C, 20) - BAND) + EPS))
    formula("pvo_12_26", 0.55, ema(V, 12) / (ema(V, 26) + EPS) - 1)
    formula("vrsi_14d", 0.55, strength(V, 14), "negative")
    formula("volume_weighted_close_10d", 0.6, weighted(C, V, 10) / (lag(C) + EPS) - 1)
    formula("bollinger_pct_20d", 0.55, (C - (mean(C, 20) - 2 * std(C, 20))) / (4 * std(C, 20) + EPS))
    formula("bollinger_width_20d", 0.5, (4 * std(C, 20)) / (mean(C, 20) + EPS), "non_linear")
    formula("ad_line_20d", 0.6, mean(CLV * V, 20) / (V + EPS))
    formula("force_index_13d", 0.6, ema(DIFF * V, 13) / (mean(V, 20) + EPS))
    return out


LIBRARY = {f.name: f for f in _library()}

#: Keyword templates, each lagged one bar.
TEMPLATES = {
    "template_momentum": lag(total(R, 20)),
    "template_reversal": lag(-total(R, 5)),
    "template_volatility": lag(-std(R, 20)),
    "template_size": lag(-log1p(mean(A, 5))),
    "template_liquidity": lag(log1p(mean(A, 20))),
    "template_growth": lag(slope(ln(C), 20, 5)),
}

#: The zoo: known factors that new ones are held against, not lagged.
ZOO = {
    "mom_20": change(C, 20),
    "reversal_5": -change(C, 5),
    "vol_20": std(R, 20),
    "liquidity_amihud": mean(x.absolute(R) / V, 21),
    "skew_20": skew(R, 20),
    "hl_range_5": mean((H - L) / C, 5),
}

#: Columns of the raw factor pool.
POOL = {
    "ret": R,
    "log_ret": ln(C) - lag(ln(C)),
    **{f"mom_{n}": change(C, n) for n in (5, 20, 60)},
    **{f"vol_{n}": std(R, n) for n in (5, 20, 60)},
    **{f"reversal_{n}": -change(C, n) for n in (5, 20)},
    **{f"turnover_{n}": mean(V, n) for n in (5, 20)},
    "amihud_21": mean(x.absolute(R) / V, 21),
    **{f"skew_{n}": skew(R, n) for n in (10, 20)},
    "hl_range_5": mean((H - L) / C, 5),
    "ret_1": lag(R),
}

#: 28 proxy features of past changes.
FEATURES = {f"feature_{i:02d}": (where(C > 0, 0, 0) if i == 1 else change(C, i - 1 if i <= 10 else i - 5)) for i in range(1, 29)}


def compute(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """symbol, date and a column for each named library factor (all by default)."""
    return x.columns(panel, {n: LIBRARY[n].tree for n in (names or LIBRARY)})


def by_category(category: str) -> dict[str, E]:
    return {f.name: f.tree for f in LIBRARY.values() if f.category == category}


def catalog(spark: SparkSession) -> DataFrame:
    """name, category, direction, quality, hash of the canonical tree."""
    rows = [(f.name, f.category, f.direction, f.quality, x.key(f.tree)[2:]) for f in LIBRARY.values()]
    return spark.createDataFrame(rows, "name string, category string, direction string, quality double, hash string")


def search(catalogue: DataFrame, text: str = "", category: str | None = None, direction: str | None = None, least: float = 0.0) -> DataFrame:
    out = catalogue.filter(F.lower("name").contains(text.lower()) & (F.col("quality") >= least))
    if category:
        out = out.filter(F.col("category") == category)
    return out.filter(F.col("direction") == direction) if direction else out


def stats(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.max("quality").alias("max_quality"), F.min("quality").alias("min_quality"))


def diverse(catalogue: DataFrame, per_category: int) -> DataFrame:
    """The best by quality in each category, ties by name."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("category").orderBy(F.desc("quality"), "name"))
    return catalogue.withColumn("rank", at).filter(F.col("rank") <= per_category)
