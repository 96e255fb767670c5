"""The lint of user factors, rule by rule, and the recipes whose formula goes over dates."""

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import recipes, udf
from factorloom.plans import extra_queries
from factorloom.sources import bars


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ("df.groupby('symbol')['close'].shift(0)", 1),
        ("df.groupby('symbol')['close'].shift(-1)", 1),
        ("df.groupby('symbol')['close'].shift(1)", 0),
        ("df.groupby('symbol')['close'].shift(periods=-2)", 1),
        ("df['fwd_ret']", 1),
        ("df.fwd_ret", 1),
        ("df.close / df.open", 2),
        ("(df.close / df.open).shift(1)", 0),
        ("df.close.shift(1) - df.close.shift(5)", 0),
        ("-df.ret", 1),
        ("df.volume * 2", 0),
        ("(df.close.rolling(5).mean() / df.close).shift(0)", 2),
        ("df.close.pct_change(-1)", 1),
    ],
)
def test_lint(body, n):
    assert len(udf.lint(f"def f(df):\n    return {body}\n")) == n


def test_lint_of_no_source():
    assert udf.lint("def f(:") and udf.lint("") == []


def ranks(v):
    r = v.fillna(0).rank()
    return (r - r.mean()) / r.std() if r.std() > 0 else r * 0.0


def test_mixed_equals_pandas(spark, data):
    """Reversal and illiquidity as plain pandas computes them, date by date."""
    panel = bars.bars(spark, data)
    p = panel.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    by = p.groupby("symbol")
    cap = p.close * p.volume
    market = (p.ret * cap).groupby(p.date).sum() / cap.groupby(p.date).sum()
    p["excess"] = p.ret - p.date.map(market)
    p["rev"] = by.excess.transform(lambda v: v.rolling(5).sum().shift(1))
    p["costly"] = np.log(p.ret.abs() / (p.amount / 1e8) + 1e-10)
    p["ill"] = by.costly.transform(lambda v: v.rolling(21).mean().shift(1))
    p["rev"], p["ill"] = p.groupby("date").rev.transform(ranks), p.groupby("date").ill.transform(ranks)

    def rest(g):
        if len(g) < recipes.LEAST or g.rev.std(ddof=0) < 1e-9:
            return pd.Series(0.0, g.index)
        b, a = np.polyfit(g.rev, g.ill, 1)
        return g.ill - a - b * g.rev

    p["raw"] = pd.concat([rest(g) for _, g in p.groupby("date")]) - p.rev
    p["factor"] = p.groupby("date").raw.transform(ranks)
    got = recipes.mixed(panel).toPandas().merge(p, on=["symbol", "date"], suffixes=("", "_want"))
    assert len(got) == len(p)
    assert np.allclose(got.reversal, got.rev, atol=1e-9) and np.allclose(got.illiquidity, got.ill, atol=1e-9) and np.allclose(got.factor, got.factor_want, atol=1e-9)


def test_demo_equals_pandas(spark, data):
    panel = bars.bars(spark, data)
    p = panel.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    by = p.groupby("symbol")
    change = lambda n: p.close / by.close.shift(n) - 1
    want = {
        "momentum": change(20),
        "divergence": -change(5) * (p.volume / by.volume.transform(lambda v: v.rolling(20).mean())),
        "low_volatility": -by.ret.transform(lambda v: v.rolling(20).std()),
        "mixed": 0.5 * (-change(5)).rank(pct=True) + 0.5 * change(60).rank(pct=True),
    }
    for k, v in want.items():
        p[k] = v.clip(v.quantile(0.01), v.quantile(0.99)).groupby(p.date).rank(pct=True)
    got = recipes.demo(panel).toPandas().merge(p, on=["symbol", "date"], suffixes=("", "_want"))
    assert len(got) == len(p)
    for k in want:
        assert np.allclose(got[k].astype(float), got[f"{k}_want"], atol=1e-9, equal_nan=True)


def test_equal_sources_are_looked_at_once(monkeypatch):
    looked, one = [], udf.lint
    monkeypatch.setattr(udf, "lint", lambda text: (looked.append(text), one(text))[1])
    bad, good = "def f(df):\n    return df.x.shift(-1)", "def f(df):\n    return df.x.shift(1)"
    got = udf.lint_batch(pd.Series([bad, good, None, bad, None, good, "("]))
    assert got.tolist() == [one(t or "") for t in (bad, good, None, bad, None, good, "(")]
    assert sorted(looked) == sorted({bad, good, "", "("})


def test_sources_are_dealt(spark, data):
    plan = extra_queries.linted(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")
