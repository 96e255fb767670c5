"""Queries of sketches, grouping sets, frames, table functions, statements, quotes, replies and measured catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.functions import expr as x
from factorloom.operators import combine, factors, sketches, system, tables, text
from factorloom.operators import evaluate as ev
from factorloom.sources import bars as source
from factorloom.sources import fundamentals
from factorloom.sources.bars import table
from factorloom.sources.files import written

from .base import bars_sql, rounded
from .combine_queries import NAMES, THREE, wide
from .eval_queries import ic_sql, summary_sql

BARS = bars_sql()


def distinct_users(s, d):
    e = table(s, d, "events")
    both = sketches.exact_over_days(e, "event_type", "user_id", 7).join(sketches.over_days(sketches.daily(e, "event_type", "user_id"), "event_type", 7), ["event_type", "day"], "left")
    return both.select("event_type", "day", "n", F.coalesce(sketches.within_error(F.col("estimate"), F.col("n")), F.lit(False)).alias("close"))


USERS = """WITH e AS (SELECT DISTINCT event_type, user_id, ts::DATE AS day FROM events), d AS (SELECT DISTINCT event_type, day FROM e)
SELECT d.event_type, d.day, count(DISTINCT user_id) AS n, TRUE AS close FROM d JOIN e ON e.event_type = d.event_type AND e.day BETWEEN d.day - 6 AND d.day GROUP BY ALL"""


def sets(s, d):
    rows = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity")
    groups = [["l_returnflag", "l_linestatus", "year"], ["l_returnflag", "year"], ["l_linestatus"], []]
    return rounded(sketches.grouping_sets(rows, groups, n=F.count(F.lit(1)), quantity=F.sum("l_quantity")), 4)


SETS = """SELECT l_returnflag, l_linestatus, year, grouping(l_returnflag, l_linestatus, year)::INT AS level, count(*) AS n, round(sum(l_quantity), 4) + 0 AS quantity
FROM (SELECT *, year(l_shipdate)::INT AS year FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, year), (l_returnflag, year), (l_linestatus), ())"""

FRAMES = f"""WITH {BARS} SELECT symbol, date, round(avg(close) OVER near, 8) + 0 AS mean, count(close) OVER near AS n, round(first_value(close) OVER near, 8) + 0 AS "first",
  round(nth_value(close, 2) OVER whole, 8) + 0 AS second, round(cume_dist() OVER (PARTITION BY date ORDER BY close), 8) AS share FROM bars WHERE close IS NOT NULL
WINDOW near AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 120 DAY PRECEDING AND CURRENT ROW), whole AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def markdown(s, d):
    """Each part as a Markdown table of a header, a rule and two rows, read back by the table function."""
    tables.register(s)
    p = table(s, d, "part")
    page = F.concat(
        F.lit("notes | on\n| field | value |\n|:--|--:|\n| name | "), "p_name", F.lit(" |\n| size |"), F.col("p_size").cast("string"), F.lit(" |\n")
    )
    p.select("p_partkey", page.alias("page")).createOrReplaceTempView("factorloom_pages")
    return s.sql("SELECT p_partkey, t.row, t.name, t.cell FROM factorloom_pages, LATERAL markdown_cells(page) AS t")


MARKDOWN = """SELECT p_partkey, 0 AS row, 'field' AS name, 'name' AS cell FROM part UNION ALL SELECT p_partkey, 0, 'value', trim(p_name) FROM part
UNION ALL SELECT p_partkey, 1, 'field', 'size' FROM part UNION ALL SELECT p_partkey, 1, 'value', p_size::VARCHAR FROM part"""


def gaps(s, d):
    tables.register(s)
    table(s, d, "events").select(F.col("event_type").alias("key"), "value", "ts", "event_id").createOrReplaceTempView("factorloom_values")
    out = s.sql("SELECT * FROM gaps(TABLE(factorloom_values) PARTITION BY key ORDER BY (ts, event_id))")
    return rounded(out, 6)


GAPS = """SELECT event_type AS key, row_number() OVER w::INT AS number, round(value - lag(value) OVER w, 6) + 0 AS gap FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""

VALUED = f"""WITH {BARS}, q AS (SELECT l_suppkey::VARCHAR AS symbol, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period, l_extendedprice * (1 - l_discount) AS net, l_tax, l_quantity FROM lineitem),
g AS (SELECT symbol, period, sum(net * (0.3 - l_tax)) AS earnings, sum(net) AS sales, sum(l_quantity) AS sold FROM q GROUP BY ALL),
r AS (SELECT symbol, (period + {fundamentals.LAG})::DATE AS known, earnings, sum(sales) OVER w AS assets, sum(sold) OVER w AS shares FROM g WINDOW w AS (PARTITION BY symbol ORDER BY period))
SELECT b.symbol, b.date, round(earnings / shares / close, 8) + 0 AS ep, round(assets / shares / close, 8) + 0 AS bp, round(earnings / assets, 8) + 0 AS roa FROM bars b ASOF LEFT JOIN r ON b.symbol = r.symbol AND b.date >= r.known"""


def quotes(s, d):
    """Every part asked for: lines of the last year as the first source, all lines as the second."""
    wanted = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"))
    lines = table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("ts"), "l_returnflag")
    return rounded(fundamentals.quoted(wanted, ("open", lines.filter("l_returnflag = 'N'").drop("l_returnflag")), ("any", lines.drop("l_returnflag"))), 8)


QUOTES = """WITH q AS (SELECT l_partkey::VARCHAR AS symbol, l_extendedprice / l_quantity AS price, l_shipdate AS ts, l_returnflag = 'N' AS open FROM lineitem),
a AS (SELECT symbol, arg_max({'price': price, 'ts': ts}, (ts, price)) AS q FROM q WHERE open GROUP BY symbol), b AS (SELECT symbol, arg_max({'price': price, 'ts': ts}, (ts, price)) AS q FROM q GROUP BY symbol)
SELECT p_partkey::VARCHAR AS symbol, round(coalesce(a.q.price, b.q.price), 8) + 0 AS price, coalesce(a.q.ts, b.q.ts) AS ts, CASE WHEN a.symbol IS NOT NULL THEN 'open' WHEN b.symbol IS NOT NULL THEN 'any' END AS source
FROM part LEFT JOIN a ON a.symbol = p_partkey::VARCHAR LEFT JOIN b ON b.symbol = p_partkey::VARCHAR"""


def gateway(s, d):
    """Each user's events of a day as a gateway's reply, and its rows read back, with what their own JSON says."""
    e = table(s, d, "events")
    rows = F.collect_list(F.struct("event_id", "event_type", "value", "props"))
    replies = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(fundamentals.reply(rows).alias("reply"))
    out = fundamentals.gateway_rows(replies, "reply", "event_id:bigint,event_type:string,value:double,props:string", ["user_id"])
    return out.select("user_id", "event_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))


GATEWAY = "SELECT user_id, event_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events"


def parsers(s, d):
    """Feeds, dates in four forms and quote lines made of orders and parts, read back."""
    p = source.dealt(s, d, "part", "p_partkey")
    feed = F.concat(F.lit("<feed><entry><title>"), "p_name", F.lit("</title><author><name>"), "p_brand", F.lit("</name></author><published>2024-01-02</published></entry><entry><title>"), "p_type", F.lit("</title><author><name>B</name></author><published>2024-03-04</published></entry></feed>"))
    a = p.select("p_partkey", F.inline(text.atom_entries(feed))).toDF("id", "title", "author", "published").select("id", F.lit("atom").alias("kind"), F.concat_ws("|", "title", "author", "published").alias("value"))
    form = F.pmod(F.col("o_orderkey"), F.lit(5))
    stamp = lambda f: F.date_format("o_orderdate", f)
    written_date = F.when(form == 0, stamp("yyyy-MM-dd")).when(form == 1, stamp("yyyyMMdd")).when(form == 2, stamp("yyyy/MM/dd")).when(form == 3, stamp("yyyy.MM.dd")).otherwise("soon")
    t = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("date").alias("kind"), F.coalesce(text.parsed_date(written_date).cast("string"), F.lit("")).alias("value"))
    line = F.concat(F.lit('var hq_str_sh'), F.col("p_partkey").cast("string"), F.lit('="'), "p_name", F.lit(","), F.col("p_size").cast("string"), F.lit(",100,"), F.col("p_size").cast("string"), F.lit('";'))
    q = p.select(F.col("p_partkey").alias("id"), text.quote(line).alias("q")).select("id", F.lit("quote").alias("kind"), F.concat_ws("|", "q.code", "q.name", F.col("q.price").cast("int").cast("string"), F.round("q.percent").cast("int").cast("string")).alias("value"))
    k = p.select(F.col("p_partkey").alias("id"), F.lit("points").alias("kind"), F.concat_ws("|", text.key_points(F.lower("p_name"), {"a": "window", "e": "rank", "o": "lag"})).alias("value"))
    return a.unionByName(t).unionByName(q).unionByName(k)


PARSERS = """SELECT p_partkey AS id, 'atom' AS kind, p_name || '|' || p_brand || '|2024-01-02' AS value FROM part UNION ALL SELECT p_partkey, 'atom', p_type || '|B|2024-03-04' FROM part
UNION ALL SELECT o_orderkey, 'date', CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE o_orderdate::DATE::VARCHAR END FROM orders
UNION ALL SELECT p_partkey, 'quote', 'sh' || p_partkey || '|' || p_name || '|' || p_size || '|' || (p_size - 100) FROM part
UNION ALL SELECT p_partkey, 'points', array_to_string([v FOR v IN [CASE WHEN contains(lower(p_name), 'a') THEN 'window' END, CASE WHEN contains(lower(p_name), 'e') THEN 'rank' END, CASE WHEN contains(lower(p_name), 'o') THEN 'lag' END] IF v IS NOT NULL], '|') FROM part"""


def loose(s, d):
    """Numbers with units, fenced replies, weights and codes made of parts and orders, read back."""
    p = table(s, d, "part")
    unit = F.element_at(F.array(F.lit("万"), F.lit("亿"), F.lit("万亿"), F.lit("%"), F.lit("")), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    number = F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit)
    fence = F.concat(F.lit("as asked:\n```json\n{\"size\": "), F.col("p_size").cast("string"), F.lit("}\n```\nmore {x"))
    weights = F.concat(F.lit("a:"), F.col("p_size").cast("string"), F.lit(", "), F.col("p_brand"), F.lit(":0.5;b  c:1"))
    code = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    note = F.concat(F.lit("buy "), code, F.lit(", 600519 and "), code, F.lit("; not 1234567"))
    held = text.weight_map(weights)
    return p.select(
        "p_partkey",
        text.cn_number(number).alias("value"),
        F.regexp_replace(text.json_block(fence), r"\s", "").alias("json"),
        F.array_join(F.array_sort(F.map_keys(held)), "|").alias("members"),
        F.aggregate(F.map_values(held), F.lit(0.0), lambda a, v: a + v).alias("weight"),
        F.concat_ws("|", text.codes_in(note)).alias("codes"),
    )


LOOSE = """SELECT p_partkey, (p_size + 0.5::DOUBLE) * CASE p_partkey % 5 WHEN 0 THEN 1e4 WHEN 1 THEN 1e8 WHEN 2 THEN 1e12 ELSE 1 END AS value, '{"size":' || p_size || '}' AS json,
  array_to_string(list_sort(['a', p_brand, 'b', 'c']), '|') AS members, (p_size + 0.5 + 1 + 1)::DOUBLE AS weight, CASE WHEN p_partkey = 600519 THEN '600519' ELSE lpad(p_partkey::VARCHAR, 6, '0') || '|600519' END AS codes FROM part"""

# catalogues of measured factors

LISTED = [f for f in factors.LIBRARY.values() if f.category in ("trading", "price_volume")]


def measured(s, d):
    """The catalogue of two categories with what the panel says of each factor: ic, icir, and |ic| as quality."""
    b = source.saved(s, d)
    got = ev.batch(b, factors.compute(b, [f.name for f in LISTED]), [f.name for f in LISTED]).select(F.col("factor_name").alias("name"), "ic", "icir", "n_dates")
    rows = factors.catalog(s).filter(F.col("category").isin("trading", "price_volume")).drop("quality").join(F.broadcast(got), "name", "left")
    return rows.withColumn("quality", F.round(F.coalesce(F.abs("ic"), F.lit(0.0)), 8))


MEASURED = f"""{BARS}, w AS (WITH {x.sql('bars', {f.name: f.tree for f in LISTED})}),
fw AS (SELECT symbol, date, lead(ret, 1) OVER (PARTITION BY symbol ORDER BY date) AS fwd_ret FROM bars),
u AS ({' UNION ALL '.join(f"SELECT symbol, date, '{f.name}' AS factor_name, {f.name} AS factor FROM w" for f in LISTED)}),
panel AS (SELECT symbol, date, factor_name, factor, fwd_ret FROM u JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL),
got AS ({summary_sql(ic_sql('panel', 'factor_name, date'), 'factor_name')}),
cat AS (SELECT c.*, round(ic, 8) AS ic, round(icir, 8) AS icir, round(coalesce(abs(ic), 0), 8) AS quality FROM (VALUES {', '.join(f"('{f.name}', '{f.category}', '{f.direction}')" for f in LISTED)}) AS c(name, category, direction) LEFT JOIN got ON factor_name = name)"""

RAW = {"equal": "1.0", "quality": "greatest(quality, 0.01)", "ic": "abs(coalesce(ic, 0))", "icir": "abs(coalesce(icir, 0))", "dimension": "1.0 / count(*) OVER (PARTITION BY category)", "manual": "greatest(coalesce(ic, 0), 0)"}
WEIGHTS = f"WITH {MEASURED} " + " UNION ALL ".join(
    f"SELECT '{m}' AS mode, name, round(CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0 / count(*) OVER () END, 6) + 0 AS w FROM (SELECT name, ({r})::DOUBLE AS raw FROM cat)" for m, r in RAW.items()
)


def weighted(s, d):
    rows = written(measured(s, d), "measured").select("name", F.col("category").alias("dimension"), "quality", "ic", "icir", F.col("ic").alias("weight"))
    out = None
    for m in RAW:
        one = combine.resolve_weights(rows, m).select(F.lit(m).alias("mode"), "name", "w")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def few(df):
    """What catalogue queries return: six digits of quality."""
    return rounded(df.select([c for c in df.columns if c in ("name", "category", "direction", "quality", "rank")]))


FEW = "name, category, direction, round(quality, 6) + 0 AS quality"


def said(s, d):
    b, w = wide(s, d)
    return system.findings(b, written(w, "wide"), NAMES)


SAID = f"""WITH {BARS}, w AS (WITH {x.sql('bars', THREE)}),
fw AS (SELECT symbol, date, {', '.join(f'lead(ret, {h}) OVER (PARTITION BY symbol ORDER BY date) AS r{h}' for h in (1, 5))} FROM bars),
m AS (SELECT symbol, date, (coalesce(rev, 0) + coalesce(liq, 0) + coalesce(vol, 0)) / 3 AS mixed, * EXCLUDE (symbol, date) FROM w),
u AS ({' UNION ALL '.join(f"SELECT symbol, date, '{n}' AS factor_name, {n} AS factor FROM m" for n in (*NAMES, 'mixed'))}),
panel AS (SELECT symbol, date, factor_name, 1 AS horizon, factor, r1 AS fwd_ret FROM u JOIN fw USING (symbol, date) WHERE factor IS NOT NULL AND r1 IS NOT NULL
  UNION ALL SELECT symbol, date, factor_name, 5, factor, r5 FROM u JOIN fw USING (symbol, date) WHERE factor_name = 'mixed' AND factor IS NOT NULL AND r5 IS NOT NULL),
g AS (SELECT factor_name, horizon, avg(ic) AS ic, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS icir FROM {ic_sql('panel', 'factor_name, horizon, date')} GROUP BY ALL),
c AS (SELECT corr(rev, liq) AS a, corr(rev, vol) AS b, corr(liq, vol) AS c FROM w),
k AS (SELECT (abs(a) + abs(b) + abs(c)) / 3 AS mean FROM c),
s AS (SELECT * FROM g WHERE factor_name = 'mixed' AND horizon = 1),
b AS (SELECT arg_max(factor_name, abs(icir)) AS best, arg_min(factor_name, abs(icir)) AS worst FROM g WHERE factor_name <> 'mixed' AND horizon = 1),
t AS (SELECT abs(l.ic) / nullif(abs(s.ic), 0) AS keep FROM s, g AS l WHERE l.factor_name = 'mixed' AND l.horizon = 5)
SELECT 'signal' AS topic, CASE WHEN abs(ic) >= 0.03 AND abs(icir) >= 0.4 THEN 'ok' ELSE 'warn' END AS tone, printf('ic %.4f, icir %.2f', ic, icir) AS text FROM s
UNION ALL SELECT 'correlation', CASE WHEN mean >= 0.5 THEN 'warn' ELSE 'info' END, printf('mean absolute correlation %.2f of 3 factors', mean) FROM k
UNION ALL SELECT 'factors', 'info', 'strongest ' || best || ', weakest ' || worst FROM b
UNION ALL SELECT 'decay', CASE WHEN keep >= 0.5 THEN 'ok' ELSE 'warn' END, printf('%.0f percent of the ic left at horizon 5', keep * 100) FROM t WHERE keep IS NOT NULL"""

_ALL = {
    "distinct_users": (distinct_users, USERS),
    "grouping_sets": (sets, SETS),
    "frames_by_days": (lambda s, d: rounded(sketches.frames(source.saved(s, d), "close", 120), 8), FRAMES),
    "markdown_cells": (markdown, MARKDOWN),
    "partitioned_gaps": (gaps, GAPS),
    "fundamental_factors": (lambda s, d: rounded(fundamentals.valued(source.saved(s, d), fundamentals.statements(s, d)), 8), VALUED),
    "quote_lookup": (quotes, QUOTES),
    "gateway_rows": (gateway, GATEWAY),
    "parsers": (parsers, PARSERS),
    "loose_formats": (loose, LOOSE),
    "catalog_stats": (
        lambda s, d: rounded(factors.stats(measured(s, d))),
        f"WITH {MEASURED} SELECT category, count(*) AS n, round(round(avg(quality), 6), 6) AS mean_quality, round(max(quality), 6) AS max_quality, round(min(quality), 6) AS min_quality FROM cat GROUP BY category",
    ),
    "catalog_search": (
        lambda s, d: few(factors.search(measured(s, d), "vol", direction="negative", least=0.001)),
        f"WITH {MEASURED} SELECT {FEW} FROM cat WHERE contains(lower(name), 'vol') AND direction = 'negative' AND quality >= 0.001",
    ),
    "catalog_diverse": (
        lambda s, d: few(factors.diverse(measured(s, d), 3)),
        f"WITH {MEASURED} SELECT {FEW}, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY quality DESC, name)::INT AS rank FROM cat) WHERE rank <= 3",
    ),
    "truncate_top": (
        lambda s, d: rounded(combine.truncate(measured(s, d).select("name", F.col("quality").alias("score")))),
        f"WITH {MEASURED} SELECT name, round(quality, 6) + 0 AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY quality DESC, name)::INT AS rank, count(*) OVER () AS n FROM cat) WHERE rank <= greatest(5, ceil(n * 0.1))",
    ),
    "weights_all_modes": (weighted, WEIGHTS),
    "system_findings": (said, SAID),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items() if v[1] is not None}
