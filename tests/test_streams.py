import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import store
from factorloom.plans import index_queries
from factorloom.sources.bars import table as source_table
from factorloom.streaming import decay, ingest, joins

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def file_of(path, name, rows, schema):
    """One parquet file; files are taken in order of their time."""
    import os
    import time

    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    os.makedirs(path, exist_ok=True)
    if "ts" in pdf:
        pdf["ts"] = pd.to_datetime(pdf["ts"]).astype("datetime64[us]")
    pdf.to_parquet(f"{path}/{name}.parquet", index=False)
    now = time.time() - 1000 + len(os.listdir(path)) * 10
    os.utime(f"{path}/{name}.parquet", (now, now))


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(stream, base, mode="append"):
    """All batches of a stream, as lists of rows."""
    out = []
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(lambda df, _: out.append(df.collect())).start()
    q.awaitTermination()
    return out


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def test_join_of_streams_drops_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    file_of(path, "a", [(1, minutes(0), 1, "view"), (2, minutes(5), 2, "view"), (9, minutes(400), 9, "view"), (10, minutes(400), 9, "purchase")], EVENTS)
    # the watermark stands at 340 after this file, and late rows are told by it from the file after the next on: 3 still joins
    file_of(path, "b", [(3, minutes(20), 1, "purchase"), (4, minutes(410), 9, "purchase")], EVENTS)
    file_of(path, "c", [(5, minutes(521), 9, "purchase"), (6, minutes(900), 8, "view"), (7, minutes(100), 7, "view"), (8, minutes(110), 7, "purchase"), (11, minutes(350), 6, "view"), (12, minutes(355), 6, "purchase")], EVENTS)
    got = [r for b in collected(joins.funnel(read(spark, path, EVENTS)), tmp_path) for r in b]
    assert sorted((r.first_id, r.second_id) for r in got) == [(1, 3), (9, 4), (9, 10), (11, 12)]
    whole = joins.funnel(spark.read.schema(EVENTS).parquet(path)).collect()
    assert sorted((r.first_id, r.second_id) for r in whole) == [(1, 3), (7, 8), (9, 4), (9, 10), (11, 12)]


def test_outer_join_of_streams_gives_lonely_rows_once(spark, tmp_path):
    path = str(tmp_path / "in")
    file_of(path, "a", [(1, minutes(0), 1, "view"), (2, minutes(5), 2, "view"), (3, minutes(30), 2, "purchase")], EVENTS)
    file_of(path, "b", [(4, minutes(1000), 3, "view"), (5, minutes(1000), 3, "purchase")], EVENTS)
    file_of(path, "c", [(6, minutes(2000), 4, "view"), (7, minutes(2000), 5, "purchase")], EVENTS)
    got = [r for b in collected(joins.funnel(read(spark, path, EVENTS), how="leftOuter"), tmp_path) for r in b]
    assert sorted((r.first_id, r.second_id or 0) for r in got) == [(1, 0), (2, 3), (4, 5)]


RECORDS = "factor_name string, date string, ic double"


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_decay_over_restarts_equals_one_regression(spark, tmp_path, parts):
    spark.conf.set(*decay.STORE)
    rng = random.Random(parts)
    days = [(T0 + datetime.timedelta(days=i)).strftime("%Y-%m-%d") for i in range(30)]
    rows = [(f"f{k}", d, rng.uniform(-1, 1) * 0.1 - i * 0.001 * k) for i, d in enumerate(days) for k in range(4) if k < 3 or i < 2]
    path = str(tmp_path / "in")
    last = {}
    size = -(-len(rows) // parts)
    for p in range(parts):
        # a new query each time, as after a restart: the state comes from the checkpoint
        file_of(path, f"p{p}", rows[p * size : (p + 1) * size], RECORDS)
        for batch in collected(decay.monitored(read(spark, path, RECORDS)), tmp_path, "update"):
            last |= {r.factor_name: r for r in batch}
    want = {r.factor_name: r for r in store.decay_trend(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {k: (r.n, r.late) for k, r in last.items()} == {k: (r.n, 0) for k, r in want.items()}
    assert all((r.slope is None) == (want[k].slope is None) and abs((r.slope or 0) - (want[k].slope or 0)) < 1e-12 for k, r in last.items())
    file_of(path, "late", [("f1", days[3], 5.0), ("f1", days[-1], 5.0), ("f1", "2025-01-01", 0.0)], RECORDS)
    (row,) = [r for b in collected(decay.monitored(read(spark, path, RECORDS)), tmp_path, "update") for r in b]
    assert (row.n, row.late) == (31, 2)
    named = spark.createDataFrame(list(last.values())).select("factor_name", decay.verdict().alias("v"))
    assert dict(named.collect()) == {k: "short" if r.n < 3 else "decaying" if r.slope < -1e-4 else "growing" if r.slope > 1e-4 else "stable" for k, r in last.items()}


PAGES = "page long, body string"


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_crawl_goes_on_after_a_crash(spark, tmp_path, stop):
    path, turn = str(tmp_path / "in"), "one"
    for i in range(3):
        file_of(path, f"p{i}", [(10 * i + j, f"text {i} {j}") for j in range(5)], PAGES)
    source = lambda: ingest.listing(read(spark, path, PAGES), "page", "body")
    crawl = ingest.Crawl(spark, str(tmp_path / "out"))

    def crash(number):
        if number == stop:
            raise RuntimeError("stopped between sink and ledger")

    crawl.after_write = crash
    with pytest.raises(Exception, match="stopped"):
        crawl.run(turn, source())
    assert crawl.ledger(turn) == list(range(stop)) and not crawl.complete(turn)
    assert crawl.rows(turn, "page long, digest string").count() == 5 * stop
    with pytest.raises(ValueError, match="complete"):
        crawl.changes(turn, turn, "page", "page long, digest string")
    crawl.after_write = None
    assert crawl.run(turn, source()) and crawl.complete(turn) and not crawl.run(turn, source())
    rows = crawl.rows(turn, "page long, digest string").collect()
    assert sorted(r.page for r in rows) == sorted(10 * i + j for i in range(3) for j in range(5))
    # the next round: one page gone, one changed, one new
    path = str(tmp_path / "next")
    file_of(path, "p", [(10 * i + j, f"text {i} {j}" if (i, j) != (1, 1) else "other") for i in range(3) for j in range(5) if (i, j) != (0, 0)] + [(99, "new")], PAGES)
    crawl.run("two", ingest.listing(read(spark, path, PAGES), "page", "body"))
    assert sorted(map(tuple, crawl.changes("one", "two", "page", "page long, digest string").collect())) == [(0, "removed"), (11, "changed"), (99, "added")]


def test_crash_between_ledger_and_commit(spark, tmp_path):
    path = str(tmp_path / "in")
    file_of(path, "p", [(1, "a"), (2, "b")], PAGES)
    crawl = ingest.Crawl(spark, str(tmp_path / "out"))
    mark = crawl._mark

    def crash(name):
        mark(name)
        raise RuntimeError("stopped after the ledger")

    crawl._mark = crash
    with pytest.raises(Exception, match="stopped"):
        crawl.run("one", ingest.listing(read(spark, path, PAGES), "page", "body"))
    crawl._mark = mark
    assert crawl.run("one", ingest.listing(read(spark, path, PAGES), "page", "body"))
    assert crawl.rows("one", "page long, digest string").count() == 2 == crawl.rows("one", "page long, digest string").agg(F.countDistinct("page")).first()[0]


def test_tables_that_are_folders_of_files(spark, data, tmp_path):
    """Streams read a table of several files as they read one of a single file."""
    names = ("labels", "documents", "events")
    for name in names:
        source_table(spark, data, name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    key = lambda df: sorted(map(str, df.collect()))
    for query in (index_queries.QUERIES["crawl_changes"], index_queries.QUERIES["stream_pairs"]):
        want = key(query(spark, data))
        assert want and key(query(spark, str(tmp_path))) == want
