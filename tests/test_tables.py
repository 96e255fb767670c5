import datetime
import os

import pytest
from pyspark.sql import functions as F

from factorloom.operators import sketches, tables, text
from factorloom.plans import table_queries
from factorloom.sources import bars as source
from factorloom.sources import fundamentals

ROWS = [
    (1, "1.5万", 'var hq_str_sh600000="Bank,10.5,10.2,10.9";', 'x ```json\n{"a": 1}\n``` y', "000001:2, 600519:3;000002", "buy 600519 and 000001, 600519"),
    (2, "2.25亿", 'var hq_str_x="";', 'reply {"b": {"c": 2}} end', "000001", "none"),
    (3, "3万亿", "garbage", "no json", "a:1 b:2", "1234567"),
    (4, "12,345.5", 'var hq_str_y="a,b";', "{broken", "", "x123456"),
    (5, "-7.5%", 'var hq_str_z="1,,3";', '{"k": [1, 2]}', "q:0.5", "000001"),
    (6, "abc", "", "", "z", ""),
    (7, None, None, None, None, None),
]


def test_loose_formats(spark):
    rows = spark.createDataFrame(ROWS, "id long, number string, quote string, reply string, weights string, note string")
    got = rows.select("id", text.cn_number(F.col("number")).alias("v"), F.concat_ws("|", text.quote_fields(F.col("quote"))).alias("f"), F.regexp_replace(text.json_block(F.col("reply")), r"\s", "").alias("j"), F.concat_ws("|", text.codes_in(F.col("note"))).alias("c")).collect()
    assert [r.v for r in got] == [15000.0, 225000000.0, 3e12, 12345.5, -7.5, None, None]
    assert [r.f for r in got] == ["Bank|10.5|10.2|10.9", "", "", "a|b", "1||3", "", ""]
    assert [r.j for r in got] == ['{"a":1}', '{"b":{"c":2}}', None, None, '{"k":[1,2]}', None, None]
    assert [r.c for r in got] == ["600519|000001", "", "", "", "000001", "", ""]


def test_dates_feeds_and_quotes(spark):
    dates = spark.createDataFrame([("2024-01-05",), ("20240106",), ("2024/01/07",), ("2024.01.08",), ("soon",), (None,)], "t string")
    assert [str(r[0]) for r in dates.select(text.parsed_date(F.col("t"))).collect()] == ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", "None", "None"]
    line = spark.createDataFrame([('var hq_str_sz1="Other,3,0,1";',), ("none",)], "line string").select(text.quote(F.col("line")).alias("q")).select("q.*").collect()
    assert (line[0].code, line[0].price, line[0].percent) == ("sz1", 1.0, None) and line[1].price is None


def test_table_functions(spark):
    tables.register(spark)
    pages = [(1, "| a | b |\n|---|:--|\n| 1 | two |\n| 3 | four | five |\n"), (2, "no table"), (3, None), (4, "| a |\n| no rule |"), (5, "x\n|a|\n|-|")]
    spark.createDataFrame(pages, "id long, page string").createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT id, t.* FROM pages_of_test, LATERAL markdown_cells(page) AS t").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a", "1"), (1, 0, "b", "two"), (1, 1, "a", "3"), (1, 1, "b", "four")]
    spark.createDataFrame([("a", 3.0, 2), ("b", 1.0, 1), ("a", 1.0, 1), ("a", 7.0, 3)], "key string, value double, at int").repartition(3).createOrReplaceTempView("values_of_test")
    got = spark.sql("SELECT * FROM gaps(TABLE(values_of_test) PARTITION BY key ORDER BY at)").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("a", 1, None), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, None)]


def test_sketches_stay_within_their_error(spark):
    days = [datetime.datetime(2024, 1, d) for d in range(1, 9)]
    rows = spark.range(200_000).select(F.element_at(F.array(*[F.lit(d) for d in days]), (F.pmod("id", F.lit(8)) + 1).cast("int")).alias("ts"), F.lit("k").alias("by"), F.pmod(F.xxhash64("id"), F.lit(90_000)).alias("what"))
    got = sketches.over_days(sketches.daily(rows, "by", "what"), "by", 3).join(sketches.exact_over_days(rows, "by", "what", 3), ["by", "day"]).collect()
    assert len(got) == 8 and all(abs(r.estimate - r.n) <= 4 * sketches.ERROR * r.n for r in got) and max(r.n for r in got) > 40_000


def test_frames_reach_by_days_not_rows(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("s", day + datetime.timedelta(n), float(v)) for n, v in ((0, 1), (1, 2), (40, 3), (41, 4))] + [("t", day, None)]
    got = {r.date: r for r in sketches.frames(spark.createDataFrame(rows, "symbol string, date date, v double"), "v", 30).collect()}
    assert [(r.n, r.mean, r["first"], r.second) for _, r in sorted(got.items())] == [(1, 1.0, 1.0, 2.0), (2, 1.5, 1.0, 2.0), (1, 3.0, 3.0, 2.0), (2, 3.5, 3.0, 2.0)]


def test_quotes_replies_and_statements(spark):
    quotes = "symbol string, price double, ts long"
    a = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 2), ("y", None, 3)], quotes)
    b = spark.createDataFrame([("x", 9.0, 9), ("y", 5.0, 1), ("q", 1.0, 1)], quotes)
    wanted = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "symbol string")
    assert sorted(map(tuple, fundamentals.quoted(wanted, ("a", a), ("b", b)).collect())) == [("x", 2.0, 2, "a"), ("y", 5.0, 1, "b"), ("z", None, None, None)]
    replies = spark.createDataFrame([(1, '{"code":"ok","data":{"rows":[{"a":1},{"a":null,"b":"t"}]}}'), (2, '{"code":"no"}'), (3, "broken"), (4, None)], "id long, reply string")
    assert sorted(map(tuple, fundamentals.gateway_rows(replies, "reply", "a:int,b:string", ["id"]).collect()), key=str) == [(1, 1, None), (1, None, "t")]
    day = datetime.date(2024, 6, 30)
    bars = spark.createDataFrame([("x", day, 10.0), ("x", day + datetime.timedelta(60), 20.0)], "symbol string, date date, close double")
    reports = spark.createDataFrame([("x", day + datetime.timedelta(45), 30.0, 60.0, 3.0)], "symbol string, known date, earnings double, assets double, shares double")
    first, second = fundamentals.valued(bars, reports).orderBy("date").collect()
    assert first.ep is None and (second.ep, second.bp, second.roa) == (pytest.approx(0.5), pytest.approx(1.0), pytest.approx(0.5))


def test_bars_follow_their_files(spark, data, tmp_path):
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first = source.saved(spark, str(tmp_path))
    n = first.count()
    assert source.saved(spark, str(tmp_path)) is first
    spark.read.parquet(f"{data}/lineitem.parquet").filter("l_suppkey <= 5").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    second = source.saved(spark, str(tmp_path))
    assert second is not first and 0 < second.count() < n and second.select("symbol").distinct().count() <= 6
    source.forget(spark)
    assert source.saved(spark, str(tmp_path)) is not second


def test_costly_rows_are_dealt(spark, data, monkeypatch):
    """Feeds aren't parsed by the one task that reads a small file."""
    monkeypatch.setattr(source, "DEALT_BYTES", os.path.getsize(f"{data}/part.parquet") // 9)
    part = source.dealt(spark, data, "part", "p_partkey")
    assert part.rdd.getNumPartitions() >= 9 and part.exceptAll(source.table(spark, data, "part")).isEmpty() and part.count() == source.table(spark, data, "part").count()
    kinds = table_queries.parsers(spark, data).filter("kind != 'date'")
    assert kinds._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 3
