"""Encodings of series, attention between the factors of a key, memories of patterns, and the scores they give.

Matrices are fixed by a seed and small; rows meet them in Arrow batches, so none of these steps shuffles but for bringing a key's
factors together, which are as many as there are factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorloom.functions.cross import rank_pct

from . import encode, system

#: Width of encodings, heads, the seed of all matrices, and the guard of the softmax's sum.
WIDTH, HEADS, SEED, GUARD = 64, 4, 42, 1e-8
#: Width of sequence encodings, scale of their weights; the seeds of encodings and of scores are 0 and 1.
SEQUENCE, SCALE = 128, 0.1
#: Rows that meet a memory at a time; a matrix of them is 2 MB.
ASKED = 256


@cache
def projection() -> np.ndarray:
    n = len(encode.NAMES)
    return np.random.RandomState(SEED).randn(n, WIDTH) / np.sqrt(n)


@cache
def heads() -> np.ndarray:
    """(head, query key or value, WIDTH, WIDTH / HEADS), drawn in this order."""
    drawn = np.random.RandomState(SEED).randn(HEADS, 3, WIDTH, WIDTH // HEADS)
    return drawn / np.sqrt(WIDTH)


def encoded(features: DataFrame, *keys: str) -> DataFrame:
    """Rows of `encode.series_features` -> keys, encoding: their projection."""
    kinds = dict(features.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = f[list(encode.NAMES)].to_numpy(np.float64) @ projection()
            yield f[list(keys)].assign(encoding=list(made))

    return features.mapInPandas(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, encoding array<double>")


def attended(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(batch, n, WIDTH) -> mean over rows of the heads' outputs side by side, and attention averaged over heads (batch, n, n)."""
    out, weights = [], 0.0
    for q, k, v in heads():
        s = (x @ q) @ (x @ k).swapaxes(1, 2) / np.sqrt(q.shape[1])
        e = np.exp(s - s.max(2, keepdims=True))
        w = e / (e.sum(2, keepdims=True) + GUARD)
        out.append(w @ (x @ v))
        weights = weights + w
    return np.concatenate(out, 2).mean(1), weights / HEADS


def fused(encodings: DataFrame, key: str, name: str = "name") -> DataFrame:
    """key, names (sorted), fused encoding, importance (each name's mean attention over the sum) and received (mean attention that others give it).

    A key with one name has its own encoding and importance 1. As rows of a softmax sum to 1, importance is alike for all names; received tells them apart.
    """
    gathered = encodings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "encoding"))).alias("rows"))
    kind = dict(encodings.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = f["rows"].map(len)
            for n, part in f.groupby(sizes, sort=True):
                x = np.array([[r["encoding"] for r in rows] for rows in part["rows"]], np.float64)
                names = [[r["name"] for r in rows] for rows in part["rows"]]
                if n == 1:
                    mixed, importance, received = x[:, 0], np.ones((len(x), 1)), np.ones((len(x), 1))
                else:
                    mixed, w = attended(x)
                    importance, received = w.mean(2), w.mean(1)
                    importance = importance / (importance.sum(1, keepdims=True) + GUARD)
                yield pd.DataFrame({key: part[key].to_numpy(), "names": names, "fused": list(mixed), "importance": list(importance), "received": list(received)})

    return gathered.mapInPandas(run, f"{key} {kind[key]}, names array<string>, fused array<double>, importance array<double>, received array<double>")


def factor_series(wide: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """A wide table of factors -> key, name, series (key and name in one), date, value."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    rows = wide.select(key, "date", F.explode(each).alias("f")).select(key, "f.name", "date", "f.value")
    return rows.withColumn("series", F.concat_ws("\x1f", key, "name"))


def series_encodings(wide: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """key, name, encoding of each factor's series of each key."""
    made = encoded(encode.series_features(factor_series(wide, names, key), "series", "value"), "series")
    parts = F.split("series", "\x1f")
    return made.select(F.get(parts, 0).alias(key), F.get(parts, 1).alias("name"), "encoding")


def similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + GUARD)


def scores(wide: DataFrame, names: list[str], existing: DataFrame | None = None, key: str = "symbol") -> DataFrame:
    """key, name, attention, quality, diversity, score, of each factor of each key; existing: (key, encoding) of what is held already.

    Diversity is 1 less the mean |cosine| with what the key holds, 0.2 at least; 1 where it holds nothing.
    """
    own = series_encodings(wide, names, key)
    told = fused(own, key).select(key, F.explode(F.arrays_zip("names", "importance")).alias("a")).select(key, F.col("a.names").alias("name"), F.col("a.importance").alias("attention"))
    quality = system.statistical_quality(factor_series(wide, names, key), "series", "value")
    parts = F.split("series", "\x1f")
    out = told.join(quality.select(F.get(parts, 0).alias(key), F.get(parts, 1).alias("name"), "quality"), [key, "name"], "left")
    if existing is not None:
        near = own.join(existing.select(key, F.col("encoding").alias("held")), key).groupBy(key, "name").agg(F.avg(F.abs(similarity(F.col("encoding"), F.col("held")))).alias("near"))
        out = out.join(near, [key, "name"], "left").withColumn("diversity", F.coalesce(F.greatest(F.lit(0.2), 1 - F.col("near")), F.lit(1.0))).drop("near")
    else:
        out = out.withColumn("diversity", F.lit(1.0))
    out = out.withColumn("quality", F.coalesce("quality", F.lit(0.3)))
    return out.withColumn("score", 0.40 * F.col("attention") + 0.35 * F.col("quality") + 0.25 * F.col("diversity"))


# sequences of bars


@cache
def sequence_weights(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of encodings (features, SEQUENCE) and of scores (features)."""
    return np.random.default_rng(0).standard_normal((features, SEQUENCE)) * SCALE, np.random.default_rng(1).standard_normal(features) * SCALE


def sequence_encodings(panel: DataFrame, features: list[str]) -> DataFrame:
    """symbol, encoding: the mean over a symbol's bars of their features, nulls as 0, times fixed weights; linear, so the mean comes first."""
    means = panel.groupBy("symbol").agg(F.array(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in features]).alias("means"))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in column]) for column in sequence_weights(len(features))[0].T])
    return means.select("symbol", F.transform(rows, lambda w: F.aggregate(F.zip_with(w, F.col("means"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("encoding"))


def sequence_factor(panel: DataFrame, features: list[str]) -> DataFrame:
    """symbol, date, factor: each bar's features times fixed weights, as rank within the date, kept off 0 and 1."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w) for c, w in zip(features, sequence_weights(len(features))[1], strict=True)), F.lit(0.0))
    rows = panel.select("symbol", "date", score.alias("score"))
    return rows.select("symbol", "date", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rank_pct(F.col("score"), "date"))).alias("factor"))


# memories of patterns


def routed(results: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(name, encoding, ic, ts) -> the rows with quality winner (ic over the threshold) or loser (under its negative); others go."""
    quality = F.when(F.col("ic") > threshold, "winner").when(F.col("ic") < -threshold, "loser")
    return results.select("name", "encoding", "ic", "ts", quality.alias("quality")).filter("quality IS NOT NULL")


def remembered(memory: DataFrame | None, results: DataFrame, threshold: float = 0.02, most: int = 1000) -> DataFrame:
    """The memory after results: the newest entry of each name, wherever it was, and of winners and losers the `most` newest (ties by name)."""
    rows = routed(results, threshold)
    rows = rows if memory is None else memory.select(rows.columns).unionByName(rows)
    last = rows.groupBy("name").agg(F.max_by(F.struct("encoding", "ic", "ts", "quality"), F.struct("ts", "ic", "quality")).alias("r")).select("name", "r.*")
    at = F.row_number().over(W.partitionBy("quality").orderBy(F.desc("ts"), "name"))
    return last.withColumn("_at", at).filter(F.col("_at") <= most).drop("_at")


def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of frames, ASKED at a time."""
    return (f.iloc[i : i + ASKED] for f in frames for i in range(0, len(f), ASKED))


def recalled(memory: DataFrame, asked: DataFrame, k: int = 1, most: int = 1000, places: int = 6) -> DataFrame:
    """asked (name, encoding) -> name, and for winners and losers the k nearest other entries by cosine (ties by name) as arrays of name and similarity.

    memory has `most` winners and `most` losers at most, so that it goes to every task; ASKED rows meet it at a time, whatever the size of a batch.
    """
    rows = memory.select("name", "encoding", "quality").orderBy("name").limit(2 * most + 1).toPandas()
    if len(rows) > 2 * most:
        raise ValueError(f"a memory has at most {most} winners and {most} losers")
    sides = {q: (rows["name"][rows["quality"] == q].to_numpy(), np.array(rows["encoding"][rows["quality"] == q].tolist(), np.float64)) for q in ("winner", "loser")}
    shared = asked.sparkSession.sparkContext.broadcast(sides)
    kind = dict(asked.dtypes)["name"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in blocks(frames):
            x = np.array(f["encoding"].tolist(), np.float64)
            out = {"name": f["name"].to_numpy()}
            for side, (names, m) in shared.value.items():
                found = [[] for _ in range(len(f))]
                if len(names):
                    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :] + GUARD
                    s = np.round(x @ m.T / norm, places) + 0.0
                    s[out["name"][:, None] == names[None, :]] = -np.inf
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # names ascend, so ties go by name
                    found = [[{"name": names[j], "similarity": float(s[i, j])} for j in row if s[i, j] > -np.inf] for i, row in enumerate(order)]
                out[side] = found
            yield pd.DataFrame(out)

    one = f"array<struct<name:{kind},similarity:double>>"
    return asked.select("name", "encoding").mapInPandas(run, f"name {kind}, winner {one}, loser {one}")


def advised(recall: DataFrame, near: float = 0.3) -> DataFrame:
    """name, best similarity with winners and with losers, and advice: 'avoid' near a loser that is nearer than any winner, 'known' near a winner, else 'explore'."""
    win, lose = F.get("winner", 0)["similarity"], F.get("loser", 0)["similarity"]
    w, l = F.coalesce(win, F.lit(-1.0)), F.coalesce(lose, F.lit(-1.0))
    advice = F.when((l >= near) & (l > w), "avoid").when(w >= near, "known").otherwise("explore")
    return recall.select("name", F.get("winner", 0)["name"].alias("winner"), win.alias("to_winner"), F.get("loser", 0)["name"].alias("loser"), lose.alias("to_loser"), advice.alias("advice"))


def dispersion(memory: DataFrame) -> DataFrame:
    """dimension, mean, sd over the winners, and region: 'explored' for the most dispersed dimension, 'open' for the three least, else null."""
    flat = memory.filter("quality = 'winner'").select(F.posexplode("encoding").alias("dimension", "v"))
    stats = flat.groupBy("dimension").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    whole = W.partitionBy(F.lit(0))  # a row a dimension
    low, high = F.row_number().over(whole.orderBy("sd", "dimension")), F.row_number().over(whole.orderBy(F.desc("sd"), "dimension"))
    region = F.when(F.col("high") == 1, "explored").when(F.col("low") <= 3, "open")
    return stats.withColumns({"low": low, "high": high}).select("dimension", "mean", "sd", region.alias("region"))
