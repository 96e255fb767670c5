"""Vector code compression: product quantisation by integer Lloyd rounds with Yinyang bounds.

Each component x counts as floor(scale * x). Vectors are cut into equal parts; each part position has a codebook, which starts as that part
of the vectors of least id. A round assigns every part to the nearest entry (ties: lower index) and moves every entry to the floor of its
parts' mean. Entries of a codebook are clustered into a few groups once. Each part keeps an upper bound on the distance to its entry and
one lower bound a group on the distance to the group's other entries. When entries move, the upper bound grows by the entry's drift and
each lower bound falls by its group's greatest drift; only groups whose lower bound isn't above the upper bound are scanned, by
exact integer distances, so that ties are settled as integers. Bounds are rounded outwards, so they never certify a tie.

Vectors and bounds are a table in the shared folder, written anew by each round; a round's sums come from the tasks, a row for each entry
in use. What reaches the driver is as large as the codebooks.

* Rows whose vector is null, or holds a null or a value that isn't finite, are left out. Null ids come last among the first vectors;
  equal ids by vector. Repeated rows count each. Fewer vectors than entries: as many entries as there are vectors.
* Vectors of less than the greatest length in the table, or of a length that the parts don't divide, are filled up with zeros.
* An empty table gives an empty result. Columns other than id, vector and label are left out.
* Sums and distances beyond a long count as the greatest long.
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

#: Labels up to this many are broadcast with their sums; beyond it they are joined by shuffles.
BROADCAST_LABELS = 100_000


@dataclass
class Codes:
    """Codebooks (part, entry, place) of integers and a table of vec_id, label, code (an entry's index a part), error."""

    codebooks: np.ndarray
    table: DataFrame

    def sha256(self) -> str:
        return hashlib.sha256(exact.digest_text(self.codebooks).encode()).hexdigest()


def grouped(entries: np.ndarray, most: int = 4) -> np.ndarray:
    """The group of each entry: a few rounds of clustering around entries far apart."""
    n = len(entries)
    chosen = [0]
    far = exact.roots(exact.squares(entries, entries))
    while len(chosen) < min(most, n):
        chosen.append(int(far[:, chosen].min(1).argmax()))
    centres = entries[chosen]
    for _ in range(5):
        group = ((entries[:, None, :] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([entries[group == g].mean(0) if (group == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(group, return_inverse=True)[1]


def layout(parts: int, groups: int) -> np.dtype:
    """A vector's record: entry, upper bound and lower bounds of each part."""
    return np.dtype([("entry", np.uint16, (parts,)), ("upper", np.float32, (parts,)), ("lower", np.float32, (parts, groups))])


def first_assignment(x: np.ndarray, entries: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) by all distances."""
    d = exact.squares(x, entries)
    entry = d.argmin(1)
    upper = exact.up(exact.roots(d[np.arange(len(x)), entry]))
    return entry, upper, lower_bounds(d, entry, group, groups)


def lower_bounds(d: np.ndarray, entry: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group, the least distance to an entry of it other than the part's own."""
    r = exact.roots(d)
    r[np.arange(len(r)), entry] = np.inf
    out = np.full((len(r), groups), np.inf)
    for g in range(groups):
        if (members := group == g).any():
            out[:, g] = r[:, members].min(1)
    return exact.down(out)


def next_assignment(x, entries, group, groups, drift, entry, upper, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) after entries moved by drift: groups that the bounds don't exclude are scanned."""
    fall = np.array([drift[group == g].max(initial=0.0) for g in range(groups)])
    upper = exact.up(upper.astype(np.float64) + drift[entry])
    lower = exact.down(lower.astype(np.float64) - fall)
    entry = entry.copy()
    rows = np.flatnonzero(lower.min(1) <= upper)
    if not len(rows):
        return entry, upper, lower
    own = exact.squares_of_pairs(x[rows], entries[entry[rows]])
    upper[rows] = exact.up(exact.roots(own))
    scan = lower[rows] <= upper[rows, None]
    some = scan.any(1)
    rows, own, scan = rows[some], own[some], scan[some]
    at = np.arange(len(rows))
    d = np.full((len(rows), len(entries)), np.inf, own.dtype if own.dtype == object else np.float64)
    for g in range(groups):
        members = np.flatnonzero(group == g)
        if len(members) and (those := np.flatnonzero(scan[:, g])).size:
            found = exact.squares(x[rows[those]], entries[members])
            d = d.astype(object) if found.dtype == object else d
            d[np.ix_(those, members)] = found
    d[at, entry[rows]] = own
    best = d.argmin(1)
    # a group that wasn't scanned keeps its bound, but for the entry that was the part's own
    bound = lower_bounds(d, best, group, groups)
    lower[rows] = np.where(scan, bound, np.minimum(bound, lower[rows]))
    upper[rows] = exact.up(exact.roots(d[at, best]))
    entry[rows] = best
    return entry, upper, lower


def one_pass(vectors: DataFrame, codebooks: np.ndarray, groups: list[np.ndarray], drift: np.ndarray | None, scale: float, last: bool) -> DataFrame:
    """One assignment of all vectors; drift is None in the first. The last gives code and error in place of bounds."""
    parts, entries, width = codebooks.shape
    n_groups = max(int(g.max()) + 1 for g in groups)
    record = layout(parts, n_groups)

    def of_batch(b: pa.RecordBatch, totals: exact.Totals) -> dict[str, pa.Array]:
        x = exact.integers(b.column("vector"), parts * width, scale)
        state = np.zeros(len(b), record) if drift is None else exact.unpacked(b.column("bounds"), record).copy()
        error: list[np.ndarray] = []
        for p in range(parts):
            own = x[:, p * width : (p + 1) * width]
            if drift is None:
                entry, upper, lower = first_assignment(own, codebooks[p], groups[p], n_groups)
            else:
                bounds = state["entry"][:, p].astype(np.int64), state["upper"][:, p], state["lower"][:, p]
                entry, upper, lower = next_assignment(own, codebooks[p], groups[p], n_groups, drift[p], *bounds)
            state["entry"][:, p], state["upper"][:, p], state["lower"][:, p] = entry, upper, lower
            if last:
                error.append(exact.squares_of_pairs(own, codebooks[p][entry]))
            else:
                totals.add(own, entry, p * entries, entries)
        if not last:
            return {"bounds": exact.packed(state)}
        total = sum((e if e.dtype == object else e.astype(np.int64)) for e in error)
        flat = pa.array(state["entry"].astype(np.int32).ravel())
        return {"code": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, parts, dtype=np.int32), flat), "error": exact.longs(total)}

    held = vectors if drift is None else vectors.filter("members IS NULL").drop("slot", "totals", "members")
    if last:
        return exact.assigned(held, of_batch, {"code": "array<int>", "error": "long"}, 0, width).select("vec_id", "label", "code", "error")
    return exact.assigned(held, of_batch, {"bounds": "binary"}, parts * entries, width)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> Codes:
    """Codebooks and codes of all vectors; entries is 65,536 at most."""
    kept = vectors.filter(exact.usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(-(-longest // parts), 1)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().combine_chunks()["vector"]
    first = exact.integers(first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first, parts * width, scale)
    if not len(first):
        spark = vectors.sparkSession
        fields = kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(np.zeros((parts, 0, width)), spark.createDataFrame([], fields.schema))
    codebooks = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))
    groups = [grouped(c) for c in codebooks]
    held, drift = kept, None
    for _ in range(rounds):
        table = materialize(one_pass(held, codebooks, groups, drift, scale, False))
        new = exact.moved(table, codebooks.reshape(-1, width)).reshape(codebooks.shape)
        drift = np.array([exact.drifts(a, b) for a, b in zip(codebooks, new, strict=True)])
        if held is not kept:
            release(held)
        held, codebooks = table, new
    out = materialize(one_pass(held, codebooks, groups, drift, scale, True))
    if held is not kept:
        release(held)
    return Codes(codebooks, out)


def digest(codes: Codes) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (the label's sum), codebooks_sha256."""
    sums = materialize(codes.table.groupBy("label").agg(exact.saturated(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "of_label")
    out = codes.table.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of_label")))
    code = F.concat_ws("", F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
