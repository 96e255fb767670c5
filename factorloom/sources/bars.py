"""Price-bar panels built from the star-schema tables, and the dimensions that go with them.

A bar is a line of (symbol, date): open and close are the prices of its first and last trade in the total order of ORDER, high
and low the extremes, volume and amount the sums. `ret` is the fractional close-to-close return, `pct_chg` the
same in percent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_returns(bars: DataFrame) -> DataFrame:
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1
    return bars.withColumn("ret", ret).withColumn("pct_chg", F.col("ret") * 100)


def files_of(spark: SparkSession, path: str) -> tuple:
    """Name, time and length of each file of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)))


#: Bytes of lineitem's files that a partition of bars is made from, and of part's files from which on its rows aren't sent to all executors.
PART_BYTES, LARGE_PART = 8 << 20, 4 << 20
#: Bytes of a table's files that a partition of `dealt` has.
DEALT_BYTES = 1 << 20


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """`table` dealt by a key, for work that costs much a row: a file of short rows is a few row groups, which are read by as many tasks."""
    size = sum(length for _, _, length in files_of(spark, f"{sf_dir}/{name}.parquet"))
    return table(spark, sf_dir, name).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT_BYTES)), key)


def bars(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Bars of suppliers by calendar month or week.

    A bar has a few lines, which lie in many files, so lines are dealt by symbol as they are: sums made before the shuffle would be wider than the lines and
    hardly fewer. One exchange and one sort then serve the bars and their returns. Partitions grow in number with the files, not in size.
    """
    size = {t: sum(length for _, _, length in files_of(spark, f"{sf_dir}/{t}.parquet")) for t in ("lineitem", "part")}
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    if size["part"] > LARGE_PART:
        part = part.hint("shuffle_hash")
    price = F.col("p_retailprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"), price.alias("price"), *ORDER)
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["lineitem"] // PART_BYTES)), "symbol")
    at = F.struct(*ORDER)
    made = rows.groupBy("symbol", "date").agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum(F.col("price") * F.col("l_quantity")).alias("amount"),
    )
    return with_returns(made)


#: Bars by application, folder and unit, with the state of the files that they were built from.
_SAVED: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def saved(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """`bars`, built once in an application and kept by its executors, dealt and sorted by symbol; what an executor loses is built again.

    They are built anew when a file of the tables is another than before, and let go by `forget`.
    """
    key = (spark.sparkContext.applicationId, sf_dir, unit)
    state = tuple(files_of(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    held = _SAVED.get(key)
    if held is None or held[0] != state:
        if held is not None:
            held[1].unpersist()
        _SAVED[key] = (state, bars(spark, sf_dir, unit).persist())
    return _SAVED[key][1]


def forget(spark: SparkSession) -> None:
    """Let go of all bars that this application keeps."""
    for key in [k for k in _SAVED if k[0] == spark.sparkContext.applicationId]:
        _SAVED.pop(key)[1].unpersist()


def intraday(spark: SparkSession, sf_dir: str, symbol: str = "event_type", floor: float = 0.01) -> DataFrame:
    """Ticks of events: symbol, date, time 'HH:mm', ts, price, volume; prices up to `floor` are dropped."""
    e = table(spark, sf_dir, "events").filter(F.col("value") > floor)
    return e.select(
        F.col(symbol).cast("string").alias("symbol"), F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("time"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume")
    )


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, industry (region of the supplier), mkt_cap (its balance)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("industry"), F.col("s_acctbal").alias("mkt_cap"))


def finite(x):
    """x with NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def latest(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Keep-last dedup: of rows with equal keys, the one with the greatest ordinal."""
    kept = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), ordinal).alias("kept"))
    return out.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in kept])


#: Standard column -> names it may have, first present wins (fixed values).
ALIASES = {
    "date": ("date", "trade_date", "trading_day", "time", "datetime", "timestamp", "日期", "交易日"),
    "symbol": ("symbol", "code", "ticker", "stock_code", "股票", "代码", "标的"),
    "close": ("close", "price", "收盘价", "收盘", "最新价"),
    "open": ("open", "开盘价", "开盘"),
    "high": ("high", "最高价", "最高"),
    "low": ("low", "最低价", "最低"),
    "volume": ("volume", "vol", "成交量", "量"),
    "amount": ("amount", "turnover", "成交额", "金额"),
    "pct_chg": ("pct_chg", "pct_change", "ret", "chg", "涨跌幅", "收益率"),
    "text": ("text", "content", "新闻", "公告", "研报", "body", "article", "description"),
    "factor": ("factor", "alpha", "signal", "score", "value", "因子", "信号", "评分"),
}


def canonical(df: DataFrame) -> DataFrame:
    """Renames the first alias present (whatever its case) of each standard column; other columns stay."""
    by_lower: dict[str, str] = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    renames = {}
    for standard, names in ALIASES.items():
        if standard not in df.columns:
            found = next((by_lower[n.lower()] for n in names if n.lower() in by_lower), None)
            if found is not None:
                renames[found] = standard
    return df.withColumnsRenamed(renames)


def conform(df: DataFrame) -> DataFrame:
    """A bar panel out of any table with date, symbol and close: numbers coerced, missing columns filled.

    open, high and low default to close, volume to 0, amount to close * volume, pct_chg to the percent change.
    """
    df = canonical(df)
    out = df.withColumn("date", F.to_date(F.col("date"))).withColumn("symbol", F.col("symbol").cast("string"))
    number = lambda c: finite(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    for c in ("close", "open", "high", "low", "volume", "amount", "pct_chg"):
        if c in df.columns:
            out = out.withColumn(c, number(c))
    for c in ("open", "high", "low"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col("close")) if c in df.columns else F.col("close"))
    out = out.withColumn("volume", F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in df.columns else F.lit(0.0))
    if "amount" not in df.columns:
        out = out.withColumn("amount", F.col("close") * F.col("volume"))
    if "pct_chg" not in df.columns:
        out = out.withColumn("pct_chg", (F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1) * 100)
    return out


def without_suspended(panel: DataFrame, most: float = 0.3) -> DataFrame:
    """Rows of symbols whose share of bars without volume is `most` at most."""
    share = panel.groupBy("symbol").agg(F.avg((F.col("volume") == 0).cast("double")).alias("share"))
    return panel.join(share.filter(F.col("share") <= most), "symbol", "left_semi")


def limited(panel: DataFrame, last_dates: int, symbols: int) -> DataFrame:
    """The last dates, and of those the symbols with most bars (ties by symbol)."""
    dates = panel.select("date").distinct().orderBy(F.desc("date")).limit(last_dates)
    recent = panel.join(dates, "date", "left_semi")
    top = recent.groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(symbols)
    return recent.join(top, "symbol", "left_semi")
