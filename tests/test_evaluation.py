import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import combine, portfolio, robust, search, store, text
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(12):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.05, 60)))
        rows += [(f"S{s:02d}", datetime.date(2021, 1, 1) + datetime.timedelta(i), float(close[i]), float(rng.integers(0, 6)), 0.0) for i in range(60)]
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "close", "volume", "amount"])
    pdf["amount"] = pdf.close * pdf.volume
    pdf["ret"] = pdf.groupby("symbol").close.pct_change()
    return spark.createDataFrame(pdf).withColumn("ret", source.finite(F.col("ret")))


def test_foresight_and_noise(bars):
    known = bars.select("symbol", "date", F.lead("ret").over(ev.by_symbol()).alias("factor"))
    assert ev.ic_summary(ev.ic_series(ev.prepare(bars, known))).first()["ic"] > 0.99
    noise = bars.select("symbol", "date", (F.pmod(F.xxhash64("symbol", "date"), F.lit(1000)) / 1000).alias("factor"))
    assert abs(ev.ic_summary(ev.ic_series(ev.prepare(bars, noise))).first()["ic"]) < 0.2
    assert 0 <= ev.turnover(noise).first()[0] <= 2


@pytest.mark.parametrize(("share", "limit", "slow"), [(0.2, 0.06, 1), (0.1, 0.01, 1), (0.1, 0.02, 20), (0.3, 0.005, 7), (0.1, 0.001, 1)])
def test_walk_matches_plain_loop(bars, share, limit, slow):
    """slow: for so many dates at a time the factor stays, so that symbols are held on and off; low limits leave dates without a buy."""
    factor = bars.select("symbol", "date", (F.pmod(F.xxhash64("symbol", F.floor(F.unix_date("date") / slow)), F.lit(997)) / 997).alias("factor"))
    panel = portfolio.tradable_panel(bars, factor, share=share)
    both = panel.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("portfolio"))
    walked = portfolio.walk(both, limit, ("portfolio",)).toPandas().sort_values(["portfolio", "date"])
    got = portfolio.walk(panel, limit=limit).toPandas().sort_values("date")
    for name in "ab":
        assert np.allclose(walked[walked.portfolio == name][["gross", "turnover", "sells", "holdings"]].to_numpy(float), got[["gross", "turnover", "sells", "holdings"]].to_numpy(float))
    assert portfolio.touched(panel, limit).count() <= panel.count()
    pdf = bars.toPandas().sort_values(["symbol", "date"])
    f = factor.toPandas()
    pdf = pdf.merge(f, on=["symbol", "date"])
    g = pdf.groupby("symbol")
    pdf["fwd"], pdf["vn"], pdf["an"] = g.ret.shift(-1), g.volume.shift(-1), g.amount.shift(-1)
    pdf = pdf.dropna(subset=["factor", "fwd"])
    days = sorted(pdf.date.unique())
    held, want = {}, []
    for t in days[:-1]:
        sub = pdf[pdf.date == t].set_index("symbol")
        gross = sum(w * sub.fwd[s] for s, w in held.items() if s in sub.index)
        can = sub[(sub.vn > 0) & (sub.an >= 0)]
        new = {s: held[s] for s in sub.index if held.get(s, 0) > 0 and s not in can.index}
        ranked = can.reset_index().sort_values(["factor", "symbol"], ascending=[False, True]).symbol
        longs = set(ranked.head(max(1, int(np.ceil(share * len(can)))))) if len(can) else set()
        for s in longs:
            if sub.fwd[s] < limit - 1e-6:
                new[s] = 1.0
        for s in can.index:
            if held.get(s, 0) > 0 and s not in longs and sub.fwd[s] <= -limit + 1e-6:
                new[s] = held[s]
        if not new:
            new = {s: held[s] for s in sub.index if held.get(s, 0) > 0}
        tot = sum(new.values())
        new = {s: w / tot for s, w in new.items()} if tot > 0 else dict(held)
        keys = set(held) | set(new)
        want.append((gross, 0.5 * sum(abs(new.get(k, 0) - held.get(k, 0)) for k in keys)))
        held = new
    np.testing.assert_allclose(got[["gross", "turnover"]].to_numpy(), np.array(want), atol=1e-12)


def test_gram_schmidt():
    m = np.random.default_rng(0).normal(size=(200, 4))
    q = m @ combine.gram_schmidt(m.T @ m)
    np.testing.assert_allclose((q * q).sum(axis=0), 1, atol=1e-9)
    assert abs(q[:, 0] @ q[:, 1]) < 1e-9


def test_leave_one_out_and_ascent(bars):
    wide = x.columns(bars.withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("pct_chg", F.col("ret") * 100), {"a": x.lag(x.total(x.col("ret"), 3)), "b": x.lag(x.col("ret")), "c": x.col("volume")})
    score = lambda f: ev.icir_proxy(bars, f).first()["icir"]
    rows = combine.leave_one_out(wide, ["a", "b", "c"], {"a": 0.1, "b": 0.2, "c": 0.0}, score)
    assert [r[0] for r in rows] == ["a", "b", "c"]
    best = combine.ascend(wide, ["a", "b"], np.array([0.5, 0.5]), lambda ws: [-(w[0] - 0.7) ** 2 for w in ws], rounds=5)
    assert best[0] > 0.55


def test_deflated_sharpe_and_verdict():
    assert robust.deflated_sharpe(0.3, 250, 10) > robust.deflated_sharpe(0.1, 250, 10)
    assert robust.verdict(0.1, 0.99, True) == "PASS" and robust.verdict(-0.1, 0.99, True) == "FAIL"


def test_evolution_is_repeatable(bars):
    rich = bars.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    a = search.evolve(rich, seed=3, population=6, generations=1, depth=2)
    b = search.evolve(rich, seed=3, population=6, generations=1, depth=2)
    assert [str(t) for t, _ in a] == [str(t) for t, _ in b]


def test_canonical_names(spark):
    df = spark.createDataFrame([("2020-01-01", "1", "2.5", "x")], "Trade_Date string, `代码` string, CLOSE string, other string")
    assert source.canonical(df).columns == ["date", "symbol", "close", "other"]
    row = source.conform(df).first()
    assert row["open"] == 2.5 and row["volume"] == 0.0 and row["pct_chg"] is None
    assert source.canonical(spark.createDataFrame([], "a int")).columns == ["a"]


def test_chunks_keep_all_words(spark):
    t = "One two three. Four five! " * 30 + "x" * 700
    made = spark.createDataFrame([(t,)], "t string").select(text.chunks(F.col("t"), 100).alias("c")).first()["c"]
    assert all(len(c) <= 100 for c in made)
    assert "".join("".join(made).split()) == "".join(t.split())


def test_upsert_and_ttl(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(a, b, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_lint():
    from factorloom.operators import udf

    body = "def f(df):\n    return df.close.{}\n"
    assert udf.lint(body.format("shift(0)")) and udf.lint(body.format("shift(-1)")) and udf.lint("def f(df):\n    return df['fwd_ret']\n")
    assert not udf.lint(body.format("shift(1)"))


def test_user_factor_is_refused(bars):
    from factorloom.operators import udf

    def peek(pdf):
        return pdf.close.shift(-1)

    with pytest.raises(ValueError):
        udf.over_time(bars, peek)


def test_lasso_keeps_what_predicts(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(600, 4))
    pdf = pd.DataFrame(m, columns=list("abcd"))
    pdf["ret"] = 0.8 * pdf.a - 0.5 * pdf.c + rng.normal(0, 0.1, 600)
    pdf["symbol"], pdf["date"] = [str(i % 20) for i in range(600)], [datetime.date(2020, 1, 1) + datetime.timedelta(i // 20) for i in range(600)]
    got = {n: (b, k) for n, b, k in combine.lasso_screen(spark.createDataFrame(pdf), list("abcd"), "ret")}
    assert got["a"][1] and got["c"][1] and got["a"][0] > 0.5 and got["c"][0] < -0.3 and abs(got["b"][0]) < 0.05


def test_orthogonal_in_turn(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(60, 3))
    m[:, 2] += m[:, 0] - 2 * m[:, 1]
    pdf = pd.DataFrame(m, columns=list("abc"))
    pdf["symbol"], pdf["date"] = [str(i) for i in range(60)], datetime.date(2020, 1, 1)
    out = combine.orthogonalize_in_turn(spark.createDataFrame(pdf), list("abc")).toPandas()
    c = np.corrcoef(out[["a_orth", "b_orth", "c_orth"]].to_numpy().T)
    np.testing.assert_allclose(c, np.eye(3), atol=1e-9)


def test_as_of(spark):
    from factorloom.operators import align

    left = spark.createDataFrame([("k", 5, 1.0), ("k", 1, 2.0), ("z", 9, 3.0)], "key string, at int, x double")
    right = spark.createDataFrame([("k", 2, 7), ("k", 5, 8), ("k", 9, 9)], "key string, at int, v int")
    got = {(r.key, r["at"]): r.v for r in align.as_of(left, right, "key", "at", ["v"]).collect()}
    assert got == {("k", 5): 8, ("k", 1): None, ("z", 9): None}
