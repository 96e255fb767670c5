"""Quality rules as a short-circuit cascade.

Each rule is a condition that rejects a document. Its cost (seconds of repeated trials) and selectivity (share rejected)
are measured on a hash sample of the rows; the cascade tries rules in falling order of rejection per cost
inside one CASE expression, so that a document pays for no rule after the first that rejects it. The order
never changes which documents are kept.

Defined results: a null or empty text has no words, all counts 0, and fails the base rules; repeated rows are
judged alike; an empty table gives an empty result. The sample of `sample_rows` rows on average serves only
to order the rules.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

SYMBOLS = r"[#*$%&|<>]"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(common.WORD), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; hashes: one 64-bit hash a word.

    Windows are sorted with their places; those equal to a neighbour are repeats. In order of place, each
    covers three words less what the one before already covers.
    """

    def places(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        dup = F.filter(s, lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1)))
        return F.sort_array(F.transform(dup, lambda x: x["i"]))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i"))
    )
    covered = let(let(F.sort_array(windows), places), lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")))["n"])
    return F.when(F.size(hashes) >= 3, covered).otherwise(F.lit(0).cast("long"))


def repeated_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(lines, lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    t = F.coalesce(text, F.lit(""))

    def repeated_words_of(w: Column) -> Column:
        return let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words)

    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            repeated_lines(F.split(t, "\n", -1)).alias("n_dup_lines"),
            repeated_words_of(w).alias("n_repeat_words"),
        ),
    )


class Rule(NamedTuple):
    """reject: a condition over the row's columns; null counts as false."""

    name: str
    reject: Column


def default_rules() -> list[Rule]:
    """Rules over the columns of `measures` and the text itself."""
    c = F.col
    t = F.coalesce(c("text"), F.lit(""))
    return [
        Rule("symbols", c("n_symbols") * 10 > c("n_words")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        Rule("repeated_lines", c("n_dup_lines") * 2 > F.size(F.split(t, "\n", -1))),
        Rule("shouting", F.length(F.regexp_replace(t, r"[^!?]+", "")) * 5 > c("n_words")),
        Rule("capitals", F.length(F.regexp_replace(t, r"\P{Lu}+", "")) * 2 > c("word_chars")),
        Rule("letters", F.length(F.regexp_replace(t, r"\P{L}+", "")) * 2 < c("word_chars")),
    ]


def order_rules(docs: DataFrame, names: Sequence[str], rules: Sequence[Rule], sample_rows: int = 1000, repeats: int = 4) -> list[Rule]:
    """rules by falling rejection per second, both measured over a hash sample of about sample_rows rows.

    All shares rejected come from one job. A rule's cost is the lesser time of two jobs that try it `repeats` times on every row, less
    that of a job that only repeats the rows.
    """
    part = min(1_000_000, 1_000_000 * sample_rows // max(1, docs.count()) + 1)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < part).withColumn("__measures", measures(F.col("text")))
    held = common.materialize(sample.select("doc_id", "text", *[F.col(f"__measures.{x}").alias(x) for x in names]))
    total, *rejected = held.agg(F.count(F.lit(1)), *[F.count_if(rule.reject) for rule in rules]).first()
    often = held.coalesce(1).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(condition: Column) -> float:
        least = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            # the text is read in any case, and the number of the repetition keeps the trials apart
            often.agg(F.count_if(condition), F.max(F.length("text") + F.col("__again"))).first()
            least = min(least, time.perf_counter() - began)
        return least

    floor = seconds(F.lit(False))
    rate = {rule.name: (n / max(1, total)) / max(1e-3, seconds(rule.reject) - floor) for rule, n in zip(rules, rejected, strict=True)}
    common.release(held)
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects the row, in the given order; null if none does."""
    out = None
    for rule in rules:
        out = F.when(rule.reject, F.lit(rule.name)) if out is None else out.when(rule.reject, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """docs with the measures, base_failed, rejected_by (null if base_failed or kept) and kept.

    Columns of docs with the names of results are replaced.
    """
    rules = default_rules() if rules is None else list(rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.drop(*names, "base_failed", "rejected_by", "kept").withColumn("__measures", measures(F.col("text")))
    if len(rules) > 1:
        rules = order_rules(docs.select("doc_id", "text"), names, rules, sample_rows)
    out = rows.withColumns({x: F.col(f"__measures.{x}") for x in names}).drop("__measures")
    out = out.withColumn("base_failed", (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
