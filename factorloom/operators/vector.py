"""Vector search by exact cosine, in blocks of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries sent to executors at once.
BLOCK = 1024


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, places: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest other vectors by cosine, ties by id.

    Each block of queries meets every row once; a task keeps its own k best for each query, so that k rows a query and task are
    shuffled. Vectors of length 0 have cosine 0.
    """
    blocks = -(-queries.count() // BLOCK)
    out = None
    for b in range(blocks):
        # about BLOCK rows, whatever the number of queries
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").orderBy("vec_id").collect()
        if not rows:
            continue
        q = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), unit(np.array([r[1] for r in rows], np.float64))))

        def run(it, q=q):
            names, m = q.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(names)
            for pdf in it:
                x = unit(np.stack(pdf.embedding.to_numpy()).astype(np.float64))
                ident = pdf.vec_id.to_numpy()
                s = np.round(m @ x.T, places)
                for i in range(len(names)):
                    other = ident != names[i]
                    v, w = np.concatenate([best[i][1], s[i][other]]), np.concatenate([best[i][0], ident[other]])
                    keep = np.lexsort((w, -v))[:k]
                    best[i] = (w[keep], v[keep])
            for i in range(len(names)):
                yield pd.DataFrame({"query_id": np.full(len(best[i][0]), names[i]), "vec_id": best[i][0], "score": best[i][1]})

        one = vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", at).filter(F.col("rank") <= k)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def dot(a, b):
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def centroid_similarity(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's cosine with the mean vector of its group, as guidance towards diversity."""
    flat = vectors.select(key, F.posexplode(value).alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    return vectors.join(mean, key).withColumn("similarity", cosine(F.col(value), F.col("mean")))
