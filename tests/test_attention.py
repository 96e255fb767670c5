import datetime

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import attention, encode


def test_attention_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{k}", f"n{i}", [float(v) for v in rng.normal(size=64)]) for k in range(5) for i in range(k + 1)]
    got = {r.key: r for r in attention.fused(spark.createDataFrame(rows, "key string, name string, encoding array<double>"), "key").collect()}
    drawn = np.random.RandomState(42)
    w = [[drawn.randn(64, 16) / 8 for _ in range(3)] for _ in range(4)]
    for k in range(5):
        x = np.array([e for key, _, e in rows if key == f"k{k}"])
        assert got[f"k{k}"].names == [f"n{i}" for i in range(k + 1)]
        if k == 0:
            assert np.allclose(got["k0"].fused, x[0]) and got["k0"].importance == [1.0]
            continue
        outs, total = [], np.zeros((k + 1, k + 1))
        for q, key, v in w:
            s = (x @ q) @ (x @ key).T / 4
            soft = np.array([[np.exp(a - max(row)) for a in row] for row in s])
            soft = np.array([row / (sum(row) + 1e-8) for row in soft])
            outs.append(soft @ (x @ v))
            total += soft / 4
        assert np.allclose(got[f"k{k}"].fused, np.hstack(outs).mean(0))
        assert np.allclose(got[f"k{k}"].importance, np.full(k + 1, 1 / (k + 1)), atol=1e-6) and np.allclose(got[f"k{k}"].received, total.mean(0))


def test_projection_and_scores(spark):
    rng = np.random.default_rng(5)
    day = datetime.date(2022, 1, 1)
    rows = [(f"s{k}", day + datetime.timedelta(i), *[float(v) for v in rng.normal(size=2)]) for k in range(3) for i in range(40)]
    wide = spark.createDataFrame(rows, "symbol string, date date, a double, b double")
    features = encode.series_features(attention.factor_series(wide, ["a", "b"]), "series", "value").collect()
    want = {r.series: np.array([r[c] for c in encode.NAMES]) @ (np.random.RandomState(42).randn(28, 64) / np.sqrt(28)) for r in features}
    made = attention.series_encodings(wide, ["a", "b"])
    got = {f"{r[0]}\x1f{r[1]}": r[2] for r in made.select("symbol", "name", "encoding").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    held = made.filter("name = 'a'").select("symbol", "encoding")
    scored = attention.scores(wide, ["a", "b"], held).collect()
    assert len(scored) == 6
    for r in scored:
        assert r.score == pytest.approx(0.4 * r.attention + 0.35 * r.quality + 0.25 * r.diversity)
        assert r.attention == pytest.approx(0.5, abs=1e-6) and (r["name"] == "b" or r.diversity == pytest.approx(0.2))


def test_sequence_encoder_equals_plain_loop(spark):
    rng = np.random.default_rng(6)
    day = datetime.date(2022, 1, 1)
    rows = [(f"s{k}", day + datetime.timedelta(i), float(rng.normal()), float(rng.normal()) if i % 5 else None) for k in range(4) for i in range(12)]
    panel = spark.createDataFrame(rows, "symbol string, date date, a double, b double")
    w, v = np.random.default_rng(0).standard_normal((2, 128)) * 0.1, np.random.default_rng(1).standard_normal(2) * 0.1
    for r in attention.sequence_encodings(panel, ["a", "b"]).collect():
        total, n = np.zeros(128), 0
        for s, _, a, b in rows:
            if s == r.symbol:
                total, n = total + np.array([a, b or 0.0]) @ w, n + 1
        assert np.allclose(r.encoding, total / n)
    got = {(r.symbol, r.date): r.factor for r in attention.sequence_factor(panel, ["a", "b"]).collect()}
    for d in {r[1] for r in rows}:
        score = {s: np.array([a, b or 0.0]) @ v for s, e, a, b in rows if e == d}
        for s, x in score.items():
            assert got[s, d] == pytest.approx(min(sum(y <= x for y in score.values()) / len(score), 1 - 1e-6))


def test_memory_evicts_upserts_and_recalls(spark):
    schema = "name string, encoding array<double>, ic double, ts long"
    first = spark.createDataFrame([("a", [1.0, 0.0], 0.5, 1), ("b", [0.0, 1.0], 0.1, 2), ("c", [1.0, 1.0], -0.5, 3), ("d", [1.0, 2.0], 0.0, 4), ("e", [2.0, 1.0], 0.3, 5)], schema)
    memory = attention.remembered(None, first, most=2)
    assert sorted((r["name"], r.quality) for r in memory.collect()) == [("b", "winner"), ("c", "loser"), ("e", "winner")]
    second = attention.remembered(memory, spark.createDataFrame([("b", [0.0, -1.0], -0.2, 9), ("z", [1.0, 0.1], 0.9, 10)], schema), most=2)
    held = {r["name"]: (r.quality, r.encoding) for r in second.collect()}
    assert held == {"b": ("loser", [0.0, -1.0]), "c": ("loser", [1.0, 1.0]), "e": ("winner", [2.0, 1.0]), "z": ("winner", [1.0, 0.1])}
    asked = spark.createDataFrame([("q", [0.0, -2.0]), ("z", [1.0, 0.1]), ("n", [0.0, 0.0])], "name string, encoding array<double>")
    got = {r["name"]: (r.winner, r.loser, r.advice) for r in attention.advised(attention.recalled(second, asked)).collect()}
    assert got == {"q": ("z", "b", "avoid"), "z": ("e", "c", "known"), "n": ("e", "b", "explore")}
    with pytest.raises(ValueError, match="at most"):
        attention.recalled(second, asked, most=1)
    assert attention.advised(attention.recalled(second.limit(0), asked)).filter("advice = 'explore' AND winner IS NULL").count() == 3
    region = {r.dimension: r.region for r in attention.dispersion(second).collect()}
    assert region == {0: "explored", 1: "open"} or region == {0: "open", 1: "explored"}


def test_recall_meets_the_memory_in_blocks(spark):
    """However many rows a batch has, ASKED meet the memory at a time, and what they recall doesn't depend on it."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=8)], float(rng.normal()), i) for i in range(600)]
    seen = spark.createDataFrame(rows, "name long, encoding array<double>, ic double, ts long").coalesce(1)
    memory = attention.remembered(None, seen).persist()
    many = seen.selectExpr("name", "encoding", "explode(sequence(0, 9)) AS i").selectExpr("i * 1000 + name AS name", "encoding").coalesce(1)
    run = lambda frame: {r["name"]: r for r in attention.recalled(memory, frame, k=2).collect()}
    got, few = run(many), run(many.filter("name < 600"))
    assert len(got) == 6000 and len(few) == 600 and all(got[k] == few[k] for k in few)
    memory.unpersist()
    cut = list(attention.blocks(iter([pd.DataFrame({"n": range(6000)}), pd.DataFrame({"n": []}), pd.DataFrame({"n": [1]})])))
    assert max(map(len, cut)) == attention.ASKED and sum(map(len, cut)) == 6001
