"""Text operators: sentiment by lexicon, tags, entities, chunks, lexical retrieval, and parsers of loose formats."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def sentiment_presence(text: Column, positive: list[str], negative: list[str]) -> Column:
    """tanh((p - n) / max(p + n + 1, 1)), 4 places, over distinct words present; 0 for null."""
    t = F.lower(F.coalesce(text, F.lit("")))
    p, n = hits(t, positive), hits(t, negative)
    return F.round(F.tanh((p - n) / (p + n + 1)), 4)


def occurrences(text: Column, words: list[str]) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))


def sentiment_counts(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(p - n) / (p + n) over all occurrences, 0 without any."""
    t = F.lower(F.coalesce(text, F.lit("")))
    p, n = occurrences(t, positive), occurrences(t, negative)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def tags(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the groups with a keyword in the text, in the given order."""
    t = F.coalesce(text, F.lit(""))
    cells = [F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(t, k)), F.lit(name)) for name, ks in keywords.items()]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def entities(text: Column, pattern: str = r"[A-Z]{2,6}") -> Column:
    """Distinct matches, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def tokens(text: Column, stop: list[str], top: int = 20) -> Column:
    """The first `top` distinct lower-case words of two letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{2,}"), F.lit(0))
    return F.slice(F.array_except(words, F.array(*[F.lit(s) for s in stop])), 1, top)


def chunks(text: Column, most: int = 320) -> Column:
    """Sentences packed greedily into chunks of up to `most` characters; longer sentences are split hard."""
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?\n]*"), F.lit(0))
    trimmed = F.filter(F.transform(sentences, lambda s: F.trim(s, F.lit(" \n"))), lambda s: s != "")
    pieces = F.flatten(F.transform(trimmed, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))))
    state = F.aggregate(
        pieces,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda a, s: F.when(a["open"] == "", F.struct(a["done"].alias("done"), s.alias("open")))
        .when(F.length(a["open"]) + 1 + F.length(s) <= most, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(" "), s).alias("open")))
        .otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), s.alias("open"))),
        lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))),
    )
    return state


#: Queries sent to executors at once.
BLOCK = 1024
#: A run of letters, digits and characters beyond ASCII.
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_weights(text: str | None) -> dict[str, float]:
    """Frequency of each lower-case token of over one character, scaled to length 1."""
    counts = Counter(t for t in TOKEN.findall((text or "").lower()) if len(t) > 1)
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {t: n / norm for t, n in counts.items()}


def lexical_top(docs: DataFrame, queries: DataFrame, k: int = 5, places: int = 8) -> DataFrame:
    """item_id, doc_id, score, rank: the k documents of highest cosine over term frequencies for each query, ties by doc_id.

    A block of queries meets every document once, through an index from token to the queries that have it; a task keeps its own k
    best for each query, so that documents aren't shuffled. Documents without a common token have no row.
    """
    spark = docs.sparkSession
    blocks = -(-queries.count() // BLOCK)
    out = None
    for b in range(blocks):
        # about BLOCK rows, whatever the number of queries
        rows = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").orderBy("item_id").collect()
        if not rows:
            continue
        index: dict[str, tuple[list[int], list[float]]] = {}
        for i, r in enumerate(rows):
            for t, w in term_weights(r["text"]).items():
                at = index.setdefault(t, ([], []))
                at[0].append(i)
                at[1].append(w)
        held = spark.sparkContext.broadcast(([r["item_id"] for r in rows], {t: (np.array(i), np.array(w)) for t, (i, w) in index.items()}))

        def run(it, held=held):
            names, index = held.value
            best = [(np.empty(0), np.empty(0, np.int64))] * len(names)
            for pdf in it:
                score = np.zeros((len(names), len(pdf)))
                for j, text in enumerate(pdf.text):
                    for t, w in term_weights(text).items():
                        at = index.get(t)
                        if at is not None:
                            score[at[0], j] += at[1] * w
                score = np.round(score, places)
                ids = pdf.doc_id.to_numpy()
                for i in range(len(names)):
                    some = np.flatnonzero(score[i] > 0)
                    if len(some) > k:
                        some = some[score[i][some] >= np.partition(score[i][some], -k)[-k]]
                    v, d = np.concatenate([best[i][0], score[i][some]]), np.concatenate([best[i][1], ids[some]])
                    keep = np.lexsort((d, -v))[:k]
                    best[i] = (v[keep], d[keep])
            for i, name in enumerate(names):
                yield pd.DataFrame({"item_id": np.full(len(best[i][0]), name, np.int64), "doc_id": best[i][1], "score": best[i][0]})

        one = docs.select("doc_id", "text").mapInPandas(run, "item_id long, doc_id long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "item_id long, doc_id long, score double, rank int")
    at = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", at).filter(F.col("rank") <= k)


def cn_number(text: Column) -> Column:
    """Numbers with Chinese units, percent signs and thousands commas; null if unreadable."""
    t = F.replace(F.trim(text), F.lit(","), F.lit(""))
    digits = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)", 1)
    value = F.when(digits != "", digits).try_cast("double")
    unit = F.when(t.contains("万亿"), 1e12).when(t.contains("亿"), 1e8).when(t.contains("万"), 1e4).otherwise(1.0)
    return value * unit


def quote_fields(line: Column) -> Column:
    """Fields of a `var hq_str_x="a,b,..."` line."""
    return F.split(F.regexp_extract(line, r'var hq_str_\w+="([^"]*)"', 1), ",")


def json_block(text: Column) -> Column:
    """The fenced JSON block of a reply, or else its outermost braces; null if neither parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(braces)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def weight_map(text: Column) -> Column:
    """map of "code:w, code:w; code" strings; a missing weight is 1."""
    parts = F.filter(F.split(text, r"[,\s;]+"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(F.element_at(F.split(x, ":"), 1).alias("k"), F.coalesce(F.get(F.split(x, ":"), 1).try_cast("double"), F.lit(1.0)).alias("v")))
    return F.map_from_entries(pairs)


def codes_in(text: Column) -> Column:
    """Distinct six-digit codes, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{6})\b"), F.lit(1)))


def table_rows(markdown: Column) -> Column:
    """Cells of the data rows of a Markdown table: rows after the rule line."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|"))
    body = F.filter(lines, lambda x, i: (i >= 1) & ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def atom_entries(xml: Column) -> Column:
    """array of (title, author, published) of an Atom feed."""
    at = lambda path: F.xpath(xml, F.lit(path))
    return F.arrays_zip(at("//entry/title/text()").alias("title"), at("//entry/author[1]/name/text()").alias("author"), at("//entry/published/text()").alias("published"))


def parsed_date(text: Column) -> Column:
    """The date in any of the usual forms; null if none fits."""
    forms = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy.MM.dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms]).cast("date")


def quote(line: Column) -> Column:
    """struct(code, name, price, change, percent) of a quote line: fields are name, open, previous close, price."""
    f = quote_fields(line)
    number = lambda i: F.get(f, i).try_cast("double")
    change = number(3) - number(2)
    return F.struct(F.regexp_extract(line, r"hq_str_(\w+)=", 1).alias("code"), F.get(f, 0).alias("name"), number(3).alias("price"), change.alias("change"), (F.try_divide(change, number(2)) * 100).alias("percent"))


def key_points(code: Column, points: dict[str, str]) -> Column:
    """Labels of the tokens that a piece of code has, in the given order."""
    return F.filter(F.array(*[F.when(F.contains(code, F.lit(k)), F.lit(v)) for k, v in points.items()]), lambda x: x.isNotNull())


def instructions(records: DataFrame) -> DataFrame:
    """instruction, input, output of the records that have code, for fine-tuning."""
    rows = records.filter(F.coalesce(F.trim("code"), F.lit("")) != "")
    return rows.select(F.concat(F.lit("Write the factor "), F.col("title")).alias("instruction"), F.coalesce("description", F.lit("")).alias("input"), F.col("code").alias("output"))


def daily_sentiment(news: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Mean sentiment of the texts of each (symbol, date)."""
    return news.groupBy("symbol", "date").agg(F.avg(sentiment_counts(F.col("text"), positive, negative)).alias("sentiment"), F.count(F.lit(1)).alias("n"))
