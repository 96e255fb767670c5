"""An inverted-file index of vectors: cells fitted on a bounded sample, every vector assigned, upserts, versions.

An index is a folder of generations. A generation holds the cells' centres, the rows (cell, vec_id, embedding) sorted by cell, and a
manifest, written last: a generation without one doesn't exist, so a crash leaves the one before in force. Rows are dealt to files by
(cell, vec_id) ranges; a large cell takes several files, and a search for some cells skips the others by the files' statistics.

A search sends each query to its nearest cells, by default to as many as hold RECALL of the true neighbours within the sample. Within a cell, rows and queries meet in blocks of bounded size, so that a
cell of any size is many small products, and a pair of blocks gives k rows a query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vector import unit

#: Rows that cells are fitted on, drawn by a hash of the id, and the most cells there are.
SAMPLE, MOST_CELLS = 16_384, 4_096
ROWS, QUERIES = 1_024, 256
#: Pairs of a query and a cell that a task makes at a time.
SPREAD = 8_192
#: Share of the sample's true neighbours that a search must reach by default, and on how many of its rows that is measured.
RECALL, MEASURED = 0.97, 512


@dataclass(frozen=True)
class Index:
    """One generation of an index."""

    path: str
    generation: int
    version: str
    cells: np.ndarray
    rows: DataFrame
    probes: int


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means from evenly spaced rows of the sample; an empty cell takes the row farthest from its own."""
    x = unit(sample.astype(np.float64))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        far = near[np.arange(len(x)), own].argsort(kind="stable")
        for k in range(cells):
            members = x[own == k]
            c[k] = members.mean(0) if len(members) else x[far[k % len(far)]]
        c = unit(c)
    return c


def probes_for(sample: np.ndarray, cells: np.ndarray, k: int = 5) -> int:
    """The least number of cells in which RECALL of the true neighbours are, of some rows among the sample."""
    x = unit(sample.astype(np.float64))
    q = x[: min(MEASURED, len(x))]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    # for each of them, how many cells are nearer to the query than its own
    turn = np.argsort(np.argsort(-(q @ cells.T), axis=1, kind="stable"), axis=1)
    own = (x @ cells.T).argmax(1)
    ranks = np.sort(np.take_along_axis(turn, own[best], 1).ravel())
    return 1 if not len(ranks) else int(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]) + 1


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete generations, ascending."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n.removeprefix("generation-")) for n in found if n.startswith("generation-")]
    return sorted(g for g in done if fs.exists(_files(spark, f"{path}/generation-{g}/manifest/_SUCCESS")[1]))


def opened(spark: SparkSession, path: str, generation: int | None = None) -> Index | None:
    """The newest complete generation, or the one named; None if there is none."""
    g = generation if generation is not None else max(generations(spark, path), default=None)
    if g is None:
        return None
    base = f"{path}/generation-{g}"
    said = json.loads(spark.read.text(f"{base}/manifest").first()[0])
    cells = spark.read.parquet(f"{base}/cells").orderBy("cell").toPandas()
    width = said["width"]
    return Index(path, g, said["version"], np.array(cells["centre"].tolist(), np.float64).reshape(-1, width), spark.read.parquet(f"{base}/rows"), said["probes"])


def assigned(vectors: DataFrame, cells: np.ndarray) -> DataFrame:
    """cell (the nearest one by cosine, ties to the smaller number), vec_id, embedding."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    kind = dict(vectors.dtypes)["vec_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[i : i + ROWS] for f in frames for i in range(0, len(f), ROWS)):
            x = unit(np.stack(f["embedding"].to_numpy()).astype(np.float64))
            yield pd.DataFrame({"cell": (x @ shared.value.T).argmax(1).astype(np.int32), "vec_id": f["vec_id"], "embedding": f["embedding"]})

    return vectors.select("vec_id", "embedding").mapInPandas(run, f"cell int, vec_id {kind}, embedding array<float>")


def _write(rows: DataFrame, path: str, cells: np.ndarray, version: str, probes: int) -> Index:
    spark = rows.sparkSession
    g = max(generations(spark, path), default=0) + 1
    base = f"{path}/generation-{g}"
    rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").parquet(f"{base}/rows")
    table = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(cells)], "cell int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{base}/cells")
    said = json.dumps({"version": version, "width": int(cells.shape[1]), "probes": probes})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/manifest")
    return opened(spark, path, g)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that have an id and a vector without nulls and values that aren't finite."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))


def build(vectors: DataFrame, path: str, version: str, cells: int | None = None) -> Index:
    """A new generation of all vectors; cells: the root of their number by default. Vectors have one length; ids are distinct."""
    kept = usable(vectors)
    n = kept.count()
    cells = min(cells or max(1, int(n**0.5)), MOST_CELLS, max(n, 1))
    # twice the bound's share of rows by hash, of which no more than the bound are taken
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    drawn = kept.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    if drawn.empty:
        return _write(kept.select(F.lit(0).alias("cell"), "vec_id", F.col("embedding").cast("array<float>")), path, np.zeros((1, 1)), version, 1)
    sample = np.stack(drawn["embedding"].to_numpy())
    centres = fit_cells(sample, min(cells, len(drawn)))
    return _write(assigned(kept, centres), path, centres, version, probes_for(sample, centres))


def upsert(index: Index, fresh: DataFrame) -> Index:
    """A new generation with fresh rows added, and rows of equal id replaced; the cells stay. Of fresh rows with one id, the greatest vector stays."""
    last = usable(fresh).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    new = assigned(last, index.cells)
    old = index.rows.join(last.select("vec_id"), "vec_id", "left_anti").select("cell", "vec_id", "embedding")
    return _write(old.unionByName(new), index.path, index.cells, index.version, index.probes)


def ensured(spark: SparkSession, path: str, version: str, vectors: Callable[[], DataFrame], cells: int | None = None) -> Index:
    """The index at path if it is of this version of the model; else a new generation of vectors(), made by the present model."""
    found = opened(spark, path)
    return found if found is not None and found.version == version else build(vectors(), path, version, cells)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """cell, and blocks of at most `size` ids and vectors each, in the order of rows; made within tasks, so a block never needs a shuffle of its own."""
    kind = dict(rows.dtypes)["vec_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, g in f.groupby("cell", sort=False):
                for i in range(0, len(g), size):
                    part = g.iloc[i : i + size]
                    flat = np.concatenate(part["embedding"].to_numpy()).astype(np.float32)
                    yield pd.DataFrame({"cell": [cell], f"{name}_ids": [part["vec_id"].to_numpy()], f"{name}_vectors": [flat.tobytes()]})

    return rows.select("cell", "vec_id", "embedding").mapInPandas(run, f"cell int, {name}_ids array<{kind}>, {name}_vectors binary")


def spread(cells: np.ndarray, many: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of queries (vec_id, embedding) -> frames of at most SPREAD pairs, or of one query: cell, vec_id, embedding, for the `many` nearest cells of each."""
    size = max(1, min(QUERIES, SPREAD // many))
    for f in (f.iloc[i : i + size] for f in frames for i in range(0, len(f), size)):
        x = unit(np.stack(f["embedding"].to_numpy()).astype(np.float64))
        near = np.argsort(-(x @ cells.T), axis=1, kind="stable")[:, :many].astype(np.int32)
        yield pd.DataFrame({"cell": near.ravel(), "vec_id": f["vec_id"].repeat(many), "embedding": f["embedding"].repeat(many)})


def top_k(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None, places: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest other vectors among those of the cells probed, by cosine, ties by id.

    Where all cells are probed, every block of queries meets every block of rows as it is; no query is copied for each cell.
    """
    many = min(probes or index.probes, len(index.cells))
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)
    width, kind = index.cells.shape[1], dict(index.rows.dtypes)["vec_id"]

    asked, blocks = usable(queries).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), _blocks(index.rows, ROWS, "row")
    if many == len(index.cells):
        pairs = blocks.drop("cell").crossJoin(_blocks(asked.select(F.lit(0).alias("cell"), "*"), QUERIES, "query").drop("cell"))
    else:
        asked = asked.mapInPandas(lambda frames: spread(shared.value, many, frames), f"cell int, vec_id {kind}, embedding array<float>")
        pairs = blocks.join(_blocks(asked.sortWithinPartitions("cell"), QUERIES, "query"), "cell")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, names = np.asarray(r.row_ids), np.asarray(r.query_ids)
                x = unit(np.frombuffer(r.row_vectors, np.float32).reshape(-1, width).astype(np.float64))
                q = unit(np.frombuffer(r.query_vectors, np.float32).reshape(-1, width).astype(np.float64))
                s = np.round(q @ x.T, places) + 0.0
                s[names[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                score = np.take_along_axis(s, order, 1)
                out = pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "vec_id": ids[order].ravel(), "score": score.ravel()})
                yield out[out["score"] > -np.inf]

    best = pairs.mapInPandas(meet, f"query_id {kind}, vec_id {kind}, score double")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", at).filter(F.col("rank") <= k)
