"""Vectors as integers: exact distances and sums, and bounds on distances that rounding never breaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers up to here are exact in a double, and so are sums of them that stay below.
EXACT = 2.0**53
#: A component beyond this counts as this; squares of such components are beyond a long anyway.
LARGEST = 2.0**62
LONG = (1 << 63) - 1

#: Columns that a pass adds: packed bounds of each vector; in rows of their own, a task's sums (those rows have members).
SUMS = "slot int, totals array<decimal(38,0)>, members long"


def usable(vector: Column) -> Column:
    """A vector that isn't null and holds neither nulls nor values that aren't finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & finite


def integers(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, a row a vector; vectors shorter than width are filled up with zeros."""
    n = len(vectors)
    lengths = np.diff(np.asarray(vectors.offsets))
    values = np.asarray(vectors.flatten(), np.float64)
    whole = np.clip(np.floor(values * scale), -LARGEST, LARGEST)
    if (lengths == width).all():
        return whole.reshape(n, width)
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def _large(*arrays: np.ndarray) -> float:
    return max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)


def _ints(a: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact: whole doubles where those suffice, else Python's integers."""
    if 4 * max(x.shape[1], 1) * _large(x, c) ** 2 < EXACT:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return ((_ints(x)[:, None, :] - _ints(c)[None, :, :]) ** 2).sum(2)


def squares_of_pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the same row of c, exact."""
    if 4 * max(x.shape[1], 1) * _large(x, c) ** 2 < EXACT:
        return ((x - c) ** 2).sum(1)
    return ((_ints(x) - _ints(c)) ** 2).sum(1)


def longs(d: np.ndarray) -> pa.Array:
    """Exact distances as a column of longs; one beyond a long counts as the greatest."""
    return pa.array([min(v, LONG) for v in d.tolist()] if d.dtype == object else d.astype(np.int64), pa.int64())


def up(x: np.ndarray) -> np.ndarray:
    """Singles that are no less than the distances x."""
    return (x * (1 + 1e-6)).astype(np.float32)


def down(x: np.ndarray) -> np.ndarray:
    """Singles that are no more than the distances x, which may be less than 0 by a bound's decay."""
    return (np.maximum(x, 0.0) * (1 - 1e-6)).astype(np.float32)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centre has moved, no less."""
    return roots(squares_of_pairs(old, new)) * (1 + 1e-9)


class Totals:
    """Sums and counts of vectors by slot, for one task; exact."""

    def __init__(self, slots: int, width: int):
        self.sums, self.counts = np.zeros((slots, width), object), np.zeros(slots, np.int64)

    def add(self, x: np.ndarray, slot: np.ndarray, first: int, slots: int) -> None:
        """Add rows of x, whose slots are first + slot, slot < slots."""
        counts = np.bincount(slot, minlength=slots)
        if len(x) * _large(x) < EXACT:
            chosen = np.zeros((slots, len(x)))
            chosen[slot, np.arange(len(x))] = 1.0
            sums = _ints(chosen @ x)
        else:
            sums = np.zeros((slots, x.shape[1]), object)
            for k in np.flatnonzero(counts):
                sums[k] = _ints(x[slot == k]).sum(0)
        self.sums[first : first + slots] += sums
        self.counts[first : first + slots] += counts

    def columns(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        used = np.flatnonzero(self.counts)
        totals = [[Decimal(int(v)) for v in self.sums[i]] for i in used]
        return pa.array(used, pa.int32()), pa.array(totals, pa.list_(pa.decimal128(38, 0))), pa.array(self.counts[used], pa.int64())


def packed(rows: np.ndarray) -> pa.Array:
    """Records of fixed size as an Arrow column of binaries."""
    size, n = rows.dtype.itemsize, len(rows)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def assigned(vectors: DataFrame, of_batch: Callable, columns: dict[str, str], slots: int, width: int) -> DataFrame:
    """vectors with columns (name: type) that of_batch(batch, totals) gives as a dict of arrays, and rows of each task's sums."""
    kept = vectors.columns
    added = ", ".join([*(f"{k} {v}" for k, v in columns.items() if k not in kept), SUMS])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*vectors.schema.fields, *T.StructType.fromDDL(added).fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, totals = to_arrow_schema(schema), Totals(slots, width)
        for b in batches:
            if not len(b):
                continue
            made = of_batch(b, totals)
            cells = [made[f.name] if f.name in made else b.column(f.name) if f.name in kept else pa.nulls(len(b), f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)
        slot, sums, members = totals.columns()
        if len(slot):
            said = {"slot": slot, "totals": sums, "members": members}
            yield pa.RecordBatch.from_arrays([said.get(f.name, pa.nulls(len(slot), f.type)).cast(f.type) for f in arrow], schema=arrow)

    return vectors.mapInArrow(run, schema)


def moved(table: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres after a pass: the floor of the mean of each slot's vectors; unused ones stay. What is collected is as large as centres."""
    sums = (
        table.filter("members IS NOT NULL").select("slot", "members", F.posexplode("totals").alias("place", "total"))
        .groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
    )
    out = centres.copy()
    for r in sums:
        out[r.slot, r.place] = float(int(r.total) // r.members)
    return out


def saturated(total: Column) -> Column:
    """A sum of integers as a long; one beyond a long counts as the greatest."""
    return F.least(total, F.lit(Decimal(LONG))).cast("long")


def digest_text(centres: np.ndarray) -> str:
    return ",".join(str(int(v)) for v in centres.ravel())
