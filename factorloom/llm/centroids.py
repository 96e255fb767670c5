"""Centroid clustering: integer Lloyd rounds with Drake's adaptive bounds.

Each component x counts as floor(scale * x). Centroids start as vectors drawn by a hash of their ids. A round assigns every vector to the
nearest centroid (ties: smaller number) and moves every centroid to the floor of its vectors' mean. A vector keeps an upper bound on the
distance to its centroid, lower bounds on the distances to its few next centroids, and one lower bound on all the rest. When centroids
move, bounds give way by the drift of their own centroid, the last by the greatest drift. Where all lower bounds are above the upper
bound, the vector stays without any distance; where only the last one is, the stored centroids are measured and ordered anew; where
that order can't be certified either, all centroids are scanned. Distances are exact integers and bounds are rounded outwards, so
that ties are settled as integers. How many centroids are stored adapts: each round stores as many as the round before needed, between an
eighth and a quarter of all.

Vectors and bounds are a table in the shared folder, written anew by each round; sums come from the tasks, a row for each centroid in use.

* Vectors that are null, hold a null or a value that isn't finite, or have another length than dimensions are left out.
* The id null is drawn last; equal ids by vector. Repeated rows count each. Fewer vectors than centroids: as many centroids as vectors.
* An empty table gives an empty result. Columns other than id and vector are left out.
* Distances and sums beyond a long count as the greatest long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact
from .common import materialize, release


@dataclass
class Clusters:
    """Centroids (number, place) of integers, the sum of squared distances of each, and a table of vec_id, cluster, distance."""

    centroids: np.ndarray
    inertia: list[int]
    table: DataFrame


def layout(stored: int) -> np.dtype:
    """A vector's record: its centroid, the bound on it, the stored others and theirs, and the bound on the rest."""
    return np.dtype([("own", np.uint16), ("upper", np.float32), ("near", np.uint16, (stored,)), ("lower", np.float32, (stored,)), ("rest", np.float32)])


def scanned(x: np.ndarray, centroids: np.ndarray, record: np.dtype) -> np.ndarray:
    """Records from all distances, ties to the smaller number."""
    d = exact.squares(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    r = exact.roots(np.take_along_axis(d, order, 1))
    out = np.zeros(len(x), record)
    stored = out["near"].shape[1]
    out["own"], out["upper"] = order[:, 0], exact.up(r[:, 0])
    out["near"], out["lower"] = order[:, 1 : stored + 1], exact.down(r[:, 1 : stored + 1])
    out["rest"] = exact.down(r[:, stored + 1]) if stored + 1 < len(centroids) else np.inf
    return out


def adjusted(x: np.ndarray, centroids: np.ndarray, drift: np.ndarray, held: np.ndarray, record: np.dtype) -> tuple[np.ndarray, int]:
    """(records after centroids moved by drift, how many of the stored centroids were needed at most)."""
    out, depth = held.copy(), 0
    out["upper"] = exact.up(held["upper"].astype(np.float64) + drift[held["own"]])
    out["lower"] = exact.down(held["lower"].astype(np.float64) - drift[held["near"]])
    out["rest"] = exact.down(held["rest"].astype(np.float64) - drift.max())
    least = np.minimum(out["lower"].min(1, initial=np.inf), out["rest"])
    rows = np.flatnonzero(least <= out["upper"])
    own = exact.squares_of_pairs(x[rows], centroids[out["own"][rows]])
    out["upper"][rows] = exact.up(exact.roots(own))
    rows = rows[least[rows] <= out["upper"][rows]]
    certain = out["rest"][rows] > out["upper"][rows]
    some, all_ = rows[certain], rows[~certain]
    if len(some):
        # the rest is farther than the own centroid: only the stored ones can be nearer
        failed = out["lower"][some] <= out["upper"][some, None]
        depth = int((np.flatnonzero(failed.any(0))).max(initial=-1)) + 1
        known = np.column_stack([out["own"][some], out["near"][some]]).astype(np.int64)
        flat = exact.squares_of_pairs(np.repeat(x[some], known.shape[1], 0), centroids[known.ravel()])
        d = flat.reshape(known.shape)
        order = np.argsort(known, axis=1)  # by number first, so that the stable sort by distance settles ties
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1, kind="stable"), 1)
        known, r = np.take_along_axis(known, order, 1), exact.roots(np.take_along_axis(d, order, 1))
        fresh = out[some]
        fresh["own"], fresh["upper"], fresh["near"], fresh["lower"] = known[:, 0], exact.up(r[:, 0]), known[:, 1:], exact.down(r[:, 1:])
        out[some] = fresh
    if len(all_):
        out[all_] = scanned(x[all_], centroids, held.dtype)
    return refit(out, record), depth


def refit(held: np.ndarray, record: np.dtype) -> np.ndarray:
    """Records that store as many centroids as record does: what goes is covered by the bound on the rest."""
    stored = record["near"].shape[0]
    if held["near"].shape[1] == stored:
        return held
    out = np.zeros(len(held), record)
    order = np.argsort(held["lower"], axis=1, kind="stable")
    near, lower = np.take_along_axis(held["near"], order, 1), np.take_along_axis(held["lower"], order, 1)
    out["own"], out["upper"], out["near"], out["lower"] = held["own"], held["upper"], near[:, :stored], lower[:, :stored]
    out["rest"] = np.minimum(held["rest"], lower[:, stored:].min(1, initial=np.inf))
    return out


def one_pass(vectors: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, stored: tuple[int, int], scale: float) -> DataFrame:
    """One assignment; drift is None in the first. stored: how many centroids the records hold, before and after."""
    k, width = centroids.shape
    before, after = layout(stored[0]), layout(stored[1])

    def of_batch(b: pa.RecordBatch, totals: exact.Totals) -> dict[str, pa.Array]:
        x = exact.integers(b.column("vector"), width, scale)
        depth = 0
        if drift is None:
            state = scanned(x, centroids, after)
        else:
            state, depth = adjusted(x, centroids, drift, exact.unpacked(b.column("bounds"), before), after)
        own = state["own"].astype(np.int64)
        totals.add(x, own, 0, k)
        distance = exact.longs(exact.squares_of_pairs(x, centroids[own]))
        return {"bounds": exact.packed(state), "cluster": pa.array(own, pa.int32()), "distance": distance, "depth": pa.array(np.full(len(b), depth), pa.int32())}

    held = vectors if drift is None else vectors.filter("members IS NULL").drop("slot", "totals", "members")
    return exact.assigned(held, of_batch, {"bounds": "binary", "cluster": "int", "distance": "long", "depth": "int"}, k, width)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, centroids: int = 16, rounds: int = 3, scale: float = 64.0, seed: int = 1) -> Clusters:
    """Clusters of all usable vectors; centroids is 65,536 at most."""
    kept = vectors.filter(exact.usable(F.col(vector_col)) & (F.size(vector_col) == dimensions)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(drawn.asc_nulls_last(), "vector").limit(centroids).select("vector").toArrow()["vector"].combine_chunks()
    first = first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first
    at = exact.integers(first, dimensions, scale)
    if not len(at):
        empty = kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        return Clusters(at, [], vectors.sparkSession.createDataFrame([], empty.schema))
    k = len(at)
    least, most = min(max(1, -(-k // 8)), k - 1), min(max(1, -(-k // 4)), k - 1)
    held, drift, stored = kept, None, (most, most)
    for turn in range(rounds + 1):
        table = materialize(one_pass(held, at, drift, stored, scale))
        if held is not kept:
            release(held)
        held = table
        if turn == rounds:
            break
        new = exact.moved(table, at)
        drift, at = exact.drifts(at, new), new
        if turn:
            needed = table.agg(F.max("depth")).first()[0] or 0
            stored = (stored[1], min(max(least, needed), stored[1]))
    out = held.filter("members IS NULL").select("vec_id", "cluster", "distance")
    sums = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    return Clusters(at, [sums.get(i, 0) for i in range(k)], out)


def digest(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    per = F.array(*[F.struct(F.lit(min(v, exact.LONG)).cast("long").alias("inertia"), F.lit(hashlib.sha256(exact.digest_text(c).encode()).hexdigest()).alias("sha256")) for v, c in zip(found.inertia, found.centroids, strict=True)])
    if not found.inertia:
        per = F.array().cast("array<struct<inertia:bigint,sha256:string>>")
    own = F.get(per, F.col("cluster"))
    total = F.lit(min(sum(found.inertia), exact.LONG)).cast("long")
    return found.table.select("vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), total.alias("inertia"), own["sha256"].alias("centroid_sha256"))
