"""What searches make Spark do: ranks that nobody reads aren't computed, and rows are joined before they are multiplied."""

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import combine, production, search, system, tuning
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source

TREES = {"a": x.total(x.col("close"), 3), "b": x.mean(x.col("volume"), 3)}


def plans(spark, monkeypatch, run):
    """Optimized plans of the tables that run collects."""
    seen, kind = [], type(spark.range(1))
    collect = kind.collect
    with monkeypatch.context() as m:
        m.setattr(kind, "collect", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), collect(df))[1])
        run()
    return seen


def test_fitness_ranks_nothing(spark, data, monkeypatch):
    b = source.saved(spark, data)
    (plan,) = plans(spark, monkeypatch, lambda: search.fitness(b, TREES))
    assert "rank(" not in plan
    beam = plans(spark, monkeypatch, lambda: search.beam(b, x.columns(b, TREES), list(TREES), size=1))
    assert all(p.count(" rank(") <= 2 for p in beam)  # of the two sums, not of the returns


def test_joins_come_before_unfolding(spark, data):
    b = source.saved(spark, data)
    for df in (ev.batch(b, x.columns(b, TREES), list(TREES)), production.focused(b, TREES)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Join")


def test_scores_need_no_rows_of_a_date_together(spark, data):
    """z-scores take a date's mean and deviation from a small table."""
    b = source.saved(spark, data)
    wide = x.columns(b, TREES).persist()
    got = combine.ic_weighted(wide, {"a": 0.04, "b": -0.02})
    assert "windowspecdefinition(date" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = wide.select("symbol", "date", *[F.coalesce(combine.zscore(F.col(k), eps=1e-12), F.lit(0.0)).alias(k) for k in TREES])
    want = {(r.symbol, r.date): (r.a * 0.04 + r.b * 0.02) / 0.06 for r in want.collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r.factor - want[r.symbol, r.date]) < 1e-9 for r in rows)
    wide.unpersist()


def test_trials_share_quantiles_and_ranks(spark, data, monkeypatch):
    """However many cuts and groups are tried, quantiles are one aggregate a date and tops one ranking."""
    b = source.saved(spark, data)
    params = [{"groups": g, "ahead": 1, "cut": 0.01 * g} for g in (3, 4, 5)]
    seen = plans(spark, monkeypatch, lambda: tuning.backtest_scores(b, x.columns(b, {"factor": TREES["a"]}), params))
    assert sum(p.count(" percentile(") for p in seen) == 1 and sum(p.count("row_number()") for p in seen) == 1


def test_parts_of_a_system_by_themselves(spark, data, monkeypatch):
    b = source.saved(spark, data)
    assert plans(spark, monkeypatch, lambda: system.analyse(b, ["momentum_5d", "turnover_5d"], only="correlation")) == []


def test_leaving_one_out_scores_all_blends_at_once(spark):
    rows = [(str(i), "d", float(i % 5), float(i % 7), float(i % 3)) for i in range(40)]
    wide = spark.createDataFrame(rows, "symbol string, date string, a double, b double, c double")
    icirs, names = {"a": 0.3, "b": 0.1, "c": 0.2}, ["a", "b", "c"]
    calls = []

    def score_all(frame, blends):
        calls.append(blends)
        return [float(r) for r in frame.agg(*[F.max_by(n, "symbol") for n in blends]).first()]

    one = lambda f: f.selectExpr("max_by(factor, symbol)").first()[0]
    want = [(n, one(combine.blend(wide, k, combine.np.array(list(combine.positive_weights({j: icirs[j] for j in k}).values()))))) for n in names for k in [[j for j in names if j != n]]]
    got = combine.leave_one_out(wide, names, icirs, score_all=score_all)
    assert len(calls) == 1 and [(n, round(v, 9)) for n, v, _ in got] == [(n, round(v, 9)) for n, v in want]
