"""Queries of the vector index and of stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import vector_index
from factorloom.sources.bars import table
from factorloom.sources.files import scratch
from factorloom.streaming import bars as stream
from factorloom.streaming import decay, ingest, joins

from .base import rounded
from .misc_queries import NEAREST


def index_of(s, d):
    return vector_index.build(table(s, d, "embeddings"), scratch(s, "index"), "one")


def asked(s, d):
    return table(s, d, "embeddings").filter(F.col("vec_id") % 20 == 0)


def upserted(s, d):
    """An index after an upsert that turns every vector with a negative first component round, and adds a copy of each under a new id."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    turned = v.filter(F.get("embedding", 0) < 0).select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    more = v.select((-F.col("vec_id") - 1).alias("vec_id"), "embedding")
    index = vector_index.upsert(index_of(s, d), turned.unionByName(more))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(index.rows.select("vec_id", F.size("embedding").alias("n"), total.alias("total")), 5)


UPSERTED = """WITH a AS (SELECT vec_id, CASE WHEN embedding[1] < 0 THEN [-x FOR x IN embedding] ELSE embedding END AS e FROM embeddings UNION ALL SELECT -vec_id - 1, embedding FROM embeddings)
SELECT vec_id, len(e)::INT AS n, round(list_sum([x::DOUBLE FOR x IN e]), 5) + 0 AS total FROM a"""


def pairs(s, d):
    out = stream.run_once(joins.funnel(stream.events(s, d), span="6 hours"), "append")
    return out.select("user_id", "first_id", "second_id")


PAIRS = """SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b USING (user_id)
WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR"""


def trends(s, d):
    """The trend of each event type's values, as a stream that carries sums."""
    held = s.conf.get(decay.STORE[0])
    s.conf.set(*decay.STORE)
    try:
        e = stream.events(s, d)
        at = F.concat_ws("#", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
        out = stream.run_once(decay.monitored(e.select(F.col("event_type").alias("factor_name"), at.alias("date"), F.col("value").alias("ic"))), "update")
    finally:
        s.conf.set(decay.STORE[0], held)
    last = out.groupBy("factor_name").agg(F.max_by(F.struct("n", "slope", "mean_ic", "late"), F.col("n") + F.col("late")).alias("r"))
    return rounded(last.select("factor_name", "r.n", "r.slope", "r.mean_ic", "r.late").withColumn("verdict", decay.verdict()), 7)


TRENDS = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
g AS (SELECT event_type AS factor_name, count(*) AS n, regr_slope(value, i) AS slope, avg(value) AS mean_ic FROM r GROUP BY event_type)
SELECT factor_name, n, round(slope, 7) + 0 AS slope, round(mean_ic, 7) + 0 AS mean_ic, 0::BIGINT AS late, CASE WHEN n < 3 THEN 'short' WHEN slope < -1e-4 THEN 'decaying' WHEN slope > 1e-4 THEN 'growing' ELSE 'stable' END AS verdict FROM g"""


def crawled(s, d):
    """Two rounds of a crawl, the labels' and the documents' view of each doc_id, and what changed between them."""
    crawl = ingest.Crawl(s, scratch(s, "crawl"))
    crawl.run("labels", ingest.listing(stream.events(s, d, "labels"), "doc_id", "quality"))
    crawl.run("documents", ingest.listing(stream.events(s, d, "documents"), "doc_id", "lang"))
    return crawl.changes("labels", "documents", "doc_id", "doc_id long, digest string")


CRAWLED = """WITH a AS (SELECT doc_id, coalesce(quality::VARCHAR, '') AS x FROM labels), b AS (SELECT doc_id, coalesce(lang, '') AS y FROM documents)
SELECT doc_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE x IS DISTINCT FROM y"""

_ALL = {
    "vector_index_top": (lambda s, d: vector_index.top_k(index_of(s, d), asked(s, d)), None),
    "vector_index_exact": (lambda s, d: (lambda i: vector_index.top_k(i, asked(s, d), probes=len(i.cells)))(index_of(s, d)), NEAREST),
    "vector_index_upsert": (upserted, UPSERTED),
    "stream_pairs": (pairs, PAIRS),
    "stream_decay": (trends, TRENDS),
    "crawl_changes": (crawled, CRAWLED),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
