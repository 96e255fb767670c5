"""Queries of scans, panels, text, vectors, minute bars and the metadata store."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import minute, store, text, vector
from factorloom.sources import bars as source
from factorloom.sources.bars import table

from .base import TICKS_SQL, bars_sql, rounded

BARS = bars_sql()
POSITIVE, NEGATIVE = ["the", "and", "is"], ["of", "that", "it"]
TAGS = {"energy": ["oil", "the"], "finance": ["bank", "ing"], "health": ["drug", "zz"]}
STOP = ["the", "of", "and", "to", "in", "is", "that", "it"]


def doc(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def sql_hits(words):
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


def sql_occ(words):
    return " + ".join(f"(length(t) - length(replace(t, '{w}', '')))::DOUBLE / {len(w)}" for w in words)


SENTIMENT = f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, {sql_hits(POSITIVE)} AS p, {sql_hits(NEGATIVE)} AS n, {sql_occ(POSITIVE)} AS po, {sql_occ(NEGATIVE)} AS no FROM d)
SELECT doc_id, round(tanh((p - n)::DOUBLE / (p + n + 1)), 4) + 0 AS presence, round(coalesce((po - no) / nullif(po + no, 0), 0), 6) + 0 AS by_count FROM h"""


def sentiment(s, d):
    return rounded(doc(s, d).select("doc_id", text.sentiment_presence(F.col("text"), POSITIVE, NEGATIVE).alias("presence"), text.sentiment_counts(F.col("text"), POSITIVE, NEGATIVE).alias("by_count")))


def listed(df, *names):
    """Array columns as text, joined by |, so that any engine compares them alike."""
    return df.withColumns({n: F.concat_ws("|", n) for n in names})


def tagged(s, d):
    out = doc(s, d).select("doc_id", text.tags(F.col("text"), TAGS).alias("tags"), text.entities(F.col("text")).alias("entities"), text.tokens(F.col("text"), STOP).alias("tokens"))
    return listed(out, "tags", "entities", "tokens")




def ordered_distinct(e: str) -> str:
    return f"list_transform(list_filter(range(1, len({e}) + 1), lambda i: list_position({e}, ({e})[i]) = i), lambda i: ({e})[i])"


TAGGED = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Z]{{2,6}}') AS e, list_filter(regexp_extract_all(lower(t), '[a-z]{{2,}}'), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in STOP)})) AS w FROM d)
SELECT doc_id, concat_ws('|', {', '.join("CASE WHEN " + ' OR '.join(f"contains(t, '{k}')" for k in ks) + f" THEN '{n}' END" for n, ks in TAGS.items())}) AS tags,
  coalesce(array_to_string({ordered_distinct('e')}, '|'), '') AS entities, coalesce(array_to_string(({ordered_distinct('w')})[1:20], '|'), '') AS tokens FROM m"""


def chunked(s, d):
    return doc(s, d).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk_id", "chunk"))


CHUNKS = r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*'), lambda v: trim(v, ' ' || chr(10))), lambda v: v <> '') AS ss FROM documents),
p AS (SELECT doc_id, flatten(list_transform(ss, lambda v: list_transform(range(0, (length(v) - 1) // 320 + 1), lambda i: substr(v, i * 320 + 1, 320)))) AS ps FROM s),
w AS (SELECT doc_id, ps, 1 AS i, 0 AS chunk_id, ps[1] AS chunk FROM p WHERE len(ps) > 0
  UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(chunk) + 1 + length(ps[i + 1]) <= 320 THEN chunk_id ELSE chunk_id + 1 END,
    CASE WHEN length(chunk) + 1 + length(ps[i + 1]) <= 320 THEN chunk || ' ' || ps[i + 1] ELSE ps[i + 1] END FROM w WHERE i < len(ps))
SELECT doc_id, chunk_id::INT AS chunk_id, arg_max(chunk, i) AS chunk FROM w GROUP BY doc_id, chunk_id"""


def lexical(s, d):
    return rounded(text.lexical_top(doc(s, d), table(s, d, "benchmark")), 6)


LEX = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS token FROM documents),
u AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS token FROM benchmark),
tf AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM t WHERE length(token) > 1 GROUP BY ALL), uf AS (SELECT item_id, token, count(*)::DOUBLE AS tf FROM u WHERE length(token) > 1 GROUP BY ALL),
tw AS (SELECT doc_id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf), uw AS (SELECT item_id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY item_id)) AS w FROM uf),
s AS (SELECT item_id, doc_id, round(sum(tw.w * uw.w), 8) AS score FROM tw JOIN uw USING (token) GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5"""


def nearest(s, d):
    v = table(s, d, "embeddings")
    return vector.top_k(v, v.filter(F.col("vec_id") % 20 == 0))


NEAREST = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) + 0 AS score FROM q, v WHERE q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5"""


def guidance(s, d):
    return rounded(vector.centroid_similarity(table(s, d, "embeddings"), "label", "embedding").select("vec_id", "similarity"), 5)


GUIDANCE = """WITH f AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM f GROUP BY label, i) SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 5) + 0 AS similarity FROM f JOIN m USING (label, i) GROUP BY vec_id"""

DAILY = f"""WITH {TICKS_SQL}, r AS (SELECT *, price / nullif(lag(price) OVER (PARTITION BY symbol, date ORDER BY ts, event_id), 0) - 1 AS r FROM ticks)
SELECT symbol, date, round(stddev_samp(r) * sqrt(240), 6) AS intraday_vol, round(ln(arg_min(price, (ts, event_id)) / arg_max(price, (ts, event_id))), 6) + 0 AS open_gap,
  round(sum(CASE WHEN time >= '13:00' THEN volume ELSE 0 END) / sum(volume), 6) AS afternoon_share, round(coalesce(sum(CASE WHEN time >= '14:30' THEN r END), 0), 6) + 0 AS late_return,
  round(max(volume) / avg(volume), 6) AS volume_peak, count(*) AS n FROM r GROUP BY symbol, date"""

PROFILE = f"""WITH {TICKS_SQL}, r AS (SELECT *, lag(price, 1) OVER w AS l1, lag(price, 3) OVER w AS l3, lag(price, 5) OVER w AS l5, lag(price, 10) OVER w AS l10 FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))
SELECT symbol, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd, {', '.join(f'round(quantile_cont(price, {q / 100}), 6) AS q{q:02d}' for q in (5, 25, 50, 75, 95))},
  {', '.join(f'round(corr(price, l{k}), 6) + 0 AS acf{k}' for k in (1, 3, 5, 10))} FROM r GROUP BY symbol"""


def overnight(s, d):
    t = source.intraday(s, d)
    at = F.struct("ts", "event_id")
    days = t.groupBy("symbol", "date").agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"))
    return rounded(minute.overnight(days))


OVERNIGHT = f"""WITH {TICKS_SQL}, d AS (SELECT symbol, date, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY symbol, date)
SELECT symbol, date, round(ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 6) + 0 AS gap FROM d"""


def entries(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("ns"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"))


NOW = "2001-08-01 00:00:00"
ENTRIES = "e AS (SELECT o_orderpriority AS ns, o_custkey AS key, o_totalprice AS value, o_orderdate AS ts FROM orders)"


def bought(s, d):
    """Customers that ordered: c_custkey, note, score."""
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("note"), F.max("o_totalprice").alias("score"))


def customers(s, d):
    return table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("note"), F.col("c_acctbal").alias("score"))


BOUGHT = "b AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS note, max(o_totalprice) AS score FROM orders GROUP BY 1)"


def snapshots(s, d):
    """All customers, and those that ordered: what a second crawl finds changed."""
    key = lambda df: df.select("c_custkey", F.md5("note").alias("digest"))
    return key(customers(s, d)), key(bought(s, d))


DIFF = f"""WITH {BOUGHT} SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN 'added' WHEN note IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM customer FULL JOIN b USING (c_custkey) WHERE c_mktsegment IS DISTINCT FROM note"""


def upserted(s, d):
    return store.upsert(customers(s, d), bought(s, d), "c_custkey")


def runs(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("experiment"), F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"), F.col("o_totalprice").alias("metric"))


def records(s, d):
    return source.saved(s, d).filter("ret IS NOT NULL").select(F.col("symbol").alias("factor_name"), "date", F.col("ret").alias("ic"))


def tiers(s, d):
    label = lambda df, name: df.select("c_custkey", F.lit(name).alias("label"))
    rich = bought(s, d).filter("score > 300000")
    return store.tiered([label(rich, "user"), label(bought(s, d), "generated"), label(customers(s, d), "static")], "c_custkey")


def filled(s, d):
    """Scores from orders, or else from the customer table."""
    return store.coalesced("c_custkey", "score", bought(s, d), customers(s, d))


def conformed(s, d):
    b = source.saved(s, d)
    raw = b.select(F.col("date").cast("string").alias("Trade_Date"), F.col("symbol").alias("代码"), F.col("close").cast("string").alias("收盘"), F.col("volume").alias("VOL"))
    return rounded(source.conform(raw).select("symbol", "date", "open", "high", "low", "close", "volume", "amount", "pct_chg"), 6)


_ALL = {
    "bars_monthly": (lambda s, d: rounded(source.saved(s, d), 6), f"WITH {BARS} SELECT symbol, date, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'amount', 'ret', 'pct_chg'))} FROM bars"),
    "bars_weekly": (
        lambda s, d: rounded(source.saved(s, d, "week"), 6),
        f"WITH {bars_sql('week')} SELECT symbol, date, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'amount', 'ret', 'pct_chg'))} FROM bars",
    ),
    "panel_conform": (
        conformed,
        f"WITH {BARS} SELECT symbol, date, round(close, 6) AS open, round(close, 6) AS high, round(close, 6) AS low, round(close, 6) AS close, volume, round(close * volume, 6) AS amount, round((close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100, 6) + 0 AS pct_chg FROM bars",
    ),
    "dedup_keep_last": (
        lambda s, d: source.latest(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("l_quantity")), ["l_orderkey", "l_linenumber"], "l_partkey"),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC) = 1",
    ),
    "suspended_filter": (
        lambda s, d: source.without_suspended(source.saved(s, d).withColumn("volume", F.when(F.col("volume") < 160, 0.0).otherwise(F.col("volume"))), 0.4).select("symbol", "date", "volume"),
        f"WITH {BARS}, v AS (SELECT symbol, date, CASE WHEN volume < 160 THEN 0.0 ELSE volume END AS volume FROM bars) SELECT symbol, date, volume FROM v QUALIFY avg((volume = 0)::INT) OVER (PARTITION BY symbol) <= 0.4",
    ),
    "panel_limit": (
        lambda s, d: source.limited(source.saved(s, d), 12, 20).select("symbol", "date"),
        f"WITH {BARS}, t AS (SELECT symbol, date FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 12)) SELECT symbol, date FROM t WHERE symbol IN (SELECT symbol FROM t GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 20)",
    ),
    "sentiment": (sentiment, SENTIMENT),
    "tags_entities_tokens": (tagged, TAGGED),
    "sentence_chunks": (chunked, CHUNKS),
    "lexical_top": (lexical, LEX),
    "cosine_top": (nearest, NEAREST),
    "diversity_guidance": (guidance, GUIDANCE),
    "minute_to_daily": (lambda s, d: rounded(minute.daily(source.intraday(s, d))), DAILY),
    "latest_days": (
        lambda s, d: minute.latest_days(source.intraday(s, d), 3).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {TICKS_SQL} SELECT symbol, date, count(*) AS n FROM (SELECT * FROM ticks QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY date DESC) <= 3) GROUP BY ALL",
    ),
    "overnight_gap": (overnight, OVERNIGHT),
    "series_profile": (lambda s, d: rounded(minute.profile(source.intraday(s, d))), PROFILE),
    "kv_alive": (
        lambda s, d: store.alive(entries(s, d), NOW, 86400 * 400),
        f"WITH {ENTRIES}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, value DESC) = 1) SELECT ns, key, value, ts FROM l WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) <= 86400 * 400",
    ),
    "kv_stats": (lambda s, d: store.namespace_stats(entries(s, d)), f"WITH {ENTRIES} SELECT ns, count(*) AS n, max(ts) AS newest FROM e GROUP BY ns"),
    "module_counts": (lambda s, d: store.counts(table(s, d, "orders"), "o_orderstatus"), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "recent_operations": (lambda s, d: store.recent(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 10), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 10"),
    "chat_sessions": (
        lambda s, d: store.sessions(table(s, d, "conversations")),
        "SELECT conv_id, count(*) AS messages, sum((role = 'user')::INT)::BIGINT AS from_user, sum(length(text))::BIGINT AS characters, substr(arg_min(text, (turn, role, text)), 1, 40) AS title FROM conversations GROUP BY conv_id",
    ),
    "upsert_by_key": (upserted, f"WITH {BOUGHT} SELECT c_custkey, coalesce(note, c_mktsegment) AS note, coalesce(score, c_acctbal) AS score FROM customer FULL JOIN b USING (c_custkey)"),
    "snapshot_diff": (lambda s, d: store.diff(*snapshots(s, d), "c_custkey"), DIFF),
    "experiment_best": (
        lambda s, d: store.best_runs(runs(s, d), "metric"),
        "SELECT o_orderpriority AS experiment, 'run' || o_orderkey AS name, o_totalprice AS metric FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, 'run' || o_orderkey DESC) = 1",
    ),
    "decay_trend": (
        lambda s, d: rounded(store.decay_trend(records(s, d)), 8),
        f"WITH {BARS}, r AS (SELECT symbol AS factor_name, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars WHERE ret IS NOT NULL) SELECT factor_name, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(ret, i) END, 8) + 0 AS slope FROM r GROUP BY factor_name",
    ),
    "tiered_lookup": (tiers, f"WITH {BOUGHT} SELECT c_custkey, CASE WHEN score > 300000 THEN 'user' WHEN score IS NOT NULL THEN 'generated' ELSE 'static' END AS label FROM customer FULL JOIN b USING (c_custkey)"),
    "coalesced_sources": (filled, f"WITH {BOUGHT} SELECT c_custkey, coalesce(score, c_acctbal) AS score FROM customer FULL JOIN b USING (c_custkey)"),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
