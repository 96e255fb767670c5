import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import vector, vector_index
from factorloom.sources.bars import table


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    return str(tmp_path_factory.mktemp("index"))


def test_recall_and_all_rows(spark, data, base):
    v = table(spark, data, "embeddings")
    index = vector_index.build(v, f"{base}/recall", "one")
    assert sorted(r[0] for r in index.rows.select("vec_id").collect()) == sorted(r[0] for r in v.select("vec_id").collect())
    near = np.argmax(vector.unit(np.array([r[1] for r in index.rows.select("cell", "embedding").collect()], np.float64)) @ index.cells.T, axis=1)
    assert (near == [r[0] for r in index.rows.select("cell").collect()]).all()
    q = v.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vector.top_k(v, q).collect()}
    found = {(r.query_id, r.vec_id) for r in vector_index.top_k(index, q).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    everywhere = vector_index.top_k(index, q, probes=len(index.cells))
    assert sorted(map(tuple, everywhere.select("query_id", "vec_id", "score", "rank").collect())) == sorted(map(tuple, vector.top_k(v, q).select("query_id", "vec_id", "score", "rank").collect()))


def test_recall_on_large_cells(spark, base):
    """Clustered vectors, a hot cell of a third of all rows, blocks of few rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in (centres[0] if i % 3 == 0 else centres[i % 40]) + rng.normal(size=16) * 0.3]) for i in range(6000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    index = vector_index.build(v, f"{base}/hot", "one")
    q = v.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vector.top_k(v, q).collect()}
    found = {(r.query_id, r.vec_id) for r in vector_index.top_k(index, q).collect()}
    assert len(exact) == 1500 and len(exact & found) / len(exact) >= 0.9


def test_upserts_versions_and_crashes(spark, base):
    rng = random.Random(1)
    row = lambda i: (i, [rng.uniform(-1, 1) for _ in range(8)])
    path = f"{base}/upsert"
    v = spark.createDataFrame([row(i) for i in range(200)] + [(900, None), (901, [None] * 8), (None, [0.5] * 8)], "vec_id long, embedding array<float>")
    first = vector_index.ensured(spark, path, "one", lambda: v)
    assert first.rows.count() == 200 and first.generation == 1
    fresh = [row(i) for i in range(150, 260)]
    second = vector_index.upsert(first, spark.createDataFrame(fresh, "vec_id long, embedding array<float>"))
    held = {r.vec_id: r.embedding for r in second.rows.collect()}
    assert sorted(held) == list(range(260)) and all(np.allclose(held[i], e, atol=1e-6) for i, e in fresh) and (second.cells == first.cells).all()
    assert first.rows.count() == 200  # a reader of the generation before isn't disturbed
    assert vector_index.ensured(spark, path, "one", lambda: 1 / 0).generation == 2
    # a generation whose manifest is missing doesn't count
    os.remove(f"{path}/generation-2/manifest/_SUCCESS")
    assert vector_index.opened(spark, path).generation == 1
    third = vector_index.ensured(spark, path, "two", lambda: second.rows.withColumn("embedding", F.slice("embedding", 1, 4)))
    assert third.version == "two" and third.cells.shape[1] == 4 and third.rows.count() == 260
    none = vector_index.build(v.limit(0), f"{base}/none", "one")
    assert none.rows.count() == 0 and vector_index.opened(spark, f"{base}/missing") is None


def test_queries_are_spread_in_bounded_pieces(spark, data, base):
    """A batch of queries is never copied for all of its cells at once, and not at all where every cell is searched."""
    rng = np.random.default_rng(5)
    cells = vector.unit(rng.normal(size=(1500, 4)))
    batch = pd.DataFrame({"vec_id": range(300), "embedding": list(rng.normal(size=(300, 4)))})
    frames = list(vector_index.spread(cells, 1000, iter([batch])))
    assert max(len(f) for f in frames) <= vector_index.SPREAD and sum(len(f) for f in frames) == 300_000
    v = table(spark, data, "embeddings")
    index = vector_index.build(v, f"{base}/bounded", "one")
    plan = vector_index.top_k(index, v, probes=len(index.cells))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan
