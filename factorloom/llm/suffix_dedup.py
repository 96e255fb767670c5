"""Exact substring dedup by external induced sorting of suffixes.

Every byte is removed that a string of LENGTH bytes covers which also starts elsewhere, in any document.

Which suffixes need sorting. Each window of LENGTH bytes has an anchor, the least hashed 32-gram within it, and
equal windows have equal anchors in equal places. Windows in a row with one anchor form a stretch. A stretch whose
anchor occurs once holds no repeat; equal stretches are repeats throughout; only where an anchor has several different
stretches does their text go on, one copy of each.

How they are sorted. Stretches of an anchor are aligned at it, so that suffixes that can match stand in
one column. From the last column to the first, a suffix is its first byte and the rank of the suffix after it, which has
just been sorted: ordering those tuples by (group, byte, rank) induces the column's order from the one to its right. The
common prefix with the neighbour above is carried along: one more than the least over the ranks between. A
window is repeated where that reaches LENGTH. Text reaches the sort as pieces of PIECE columns, in falling order,
through Spark's disk-backed external sort by (shard, column, anchor); a shard keeps in memory only one piece, the rank and the prefix
of each stretch.

Hot anchors. An anchor with many different stretches would be one large group in one task. Its windows are parted by where they start
into classes, and all windows of a class have most of their columns in common: only stretches whose bytes there are equal can match, so a
class and the hash of those bytes make a group of their own, dealt to any shard. Equal windows stand in one class and one such group.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; matches never cross documents; rows
that repeat doc_id and text are documents of their own, so that what they share is removed from both; a null doc_id is
allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

LENGTH = 400
PIECE = 64
#: Stretches in a shard, on average; more of one group stay together.
SHARD = 4096
#: An anchor with more different stretches than HOT is split; its windows go to CLASSES by where they start.
HOT, CLASSES = 32768, 8
#: Bytes that anchors are sought in at once.
PART = 1 << 22


def stretches(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, stretch, first, last, at): hashes, the first and last window's start, and the anchor's place."""
    found = []
    for start in range(0, max(1, len(b) - length + 1), PART):
        h, s, first, last, at = anchors.anchored(b[start : start + PART + length - 1], length)
        found.append((h, s, first + start, last + start, at + start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def as_bytes(text) -> np.ndarray:
    """UTF-8 bytes of an Arrow string."""
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.empty(0, np.uint8)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def find_stretches(docs: DataFrame, length: int) -> DataFrame:
    """(doc, part, text) -> a row for each stretch: doc, part, anchor, stretch, first, last, at."""
    kind = dict(docs.dtypes)["doc"]

    def run(batches):
        for b in batches:
            rows, made = [], []
            for i, t in enumerate(b.column("text")):
                x = as_bytes(t)
                if len(x) >= length:
                    made.append(stretches(x, length))
                    rows.append(np.full(len(made[-1][0]), i))
            if not made:
                continue
            at = pa.array(np.concatenate(rows))
            h, s, first, last, place = (np.concatenate(x) for x in zip(*made, strict=True))
            columns = [b.column("doc").take(at), b.column("part").take(at), pa.array(signed(h)), pa.array(signed(s)), *[pa.array(x.astype(np.int32)) for x in (first, last, place)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "part", "anchor", "stretch", "first", "last", "at"])

    return docs.select("doc", "part", "text").transform(common.small_batches).mapInArrow(run, f"doc {kind}, part long, anchor long, stretch long, first int, last int, at int")


def parted(x: np.ndarray, w: dict, length: int) -> list[tuple[int, int, int]]:
    """(group, low, high): the groups that a stretch of text x is sorted in, and its columns there, counted from its anchor.

    A stretch that isn't hot is in its anchor's group. Of a hot one, the windows that start in each class's columns are in the group of the anchor
    and the bytes that all windows of the class cover.
    """
    low, last = w["first"] - w["at"], w["last"] - w["at"]
    if not w["hot"]:
        return [(w["anchor"], low, last + length)]
    out = []
    wide = -(-length // CLASSES)
    # classes of starts (first, end) from 0 down; windows in one all cover first + wide - 1 up to first + length
    for k in range(low // wide, last // wide + 1):
        first, end = k * wide, (k + 1) * wide - 1
        a, z = max(low, first), min(last, end)
        # a window that starts at a covers a to a + length: columns from end to first + length are in all of the class
        common_bytes = x[w["at"] + end : w["at"] + first + length]
        key = hashlib.blake2b(common_bytes.tobytes(), digest_size=8, key=int(w["anchor"] & (2**64 - 1)).to_bytes(8, "little") + (k & 0xFFFF).to_bytes(2, "little"))
        out.append((int.from_bytes(key.digest(), "little", signed=True), a, z + length))
    return out


def pieces(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """(text, wanted: anchor, stretch, first, last, at, hot of each) -> shard, piece, group, anchor, stretch, low, high, data.

    low and high bound the stretch's columns in the group, counted from its anchor; data is its text within the piece's columns.
    """
    kinds = {"shard": pa.int64(), "piece": pa.int32(), "group": pa.int64(), "anchor": pa.int64(), "stretch": pa.int64(), "low": pa.int32(), "high": pa.int32(), "data": pa.binary()}

    def run(batches):
        for b in batches:
            out = {k: [] for k in kinds}
            for t, wanted in zip(b.column("text"), b.column("wanted"), strict=True):
                x = as_bytes(t)
                for w in wanted.as_py():
                    for group, low, high in parted(x, w, length):
                        for p in range(low // PIECE, (high - 1) // PIECE + 1):
                            a, z = max(low, p * PIECE), min(high, (p + 1) * PIECE)
                            for k, v in zip(kinds, (group % shards, p, group, w["anchor"], w["stretch"], low, high, x[w["at"] + a : w["at"] + z].tobytes()), strict=True):
                                out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return rows.select("text", "wanted").transform(common.small_batches).mapInArrow(run, "shard long, piece int, group long, anchor long, stretch long, low int, high int, data binary")


class Shard:
    """Induced sorting of the stretches of some groups, column by column from the right."""

    def __init__(self, length: int):
        self.length = length
        #: Stretches by (group, anchor, stretch).
        self.known: dict[tuple[int, int, int], int] = {}
        self.names: list[tuple[int, int, int]] = []
        self.group = np.empty(0, np.int64)
        self.groups: dict[int, int] = {}
        #: Stretches by (group, suffix), and the common prefix of each with the one before.
        self.order = np.empty(0, np.int64)
        self.prefix = np.empty(0, np.int64)
        self.hits: list[tuple[int, np.ndarray]] = []

    def add(self, piece: int, keys: list[tuple[int, int, int]], low: np.ndarray, high: np.ndarray, data: list[bytes]) -> None:
        """The next piece to the left: its text of every stretch that reaches into it."""
        item = np.empty(len(keys), np.int64)
        fresh = []
        for i, k in enumerate(keys):
            j = self.known.get(k)
            if j is None:
                j = self.known[k] = len(self.names)
                self.names.append(k)
                fresh.append(self.groups.setdefault(k[0], len(self.groups)))
            item[i] = j
        if fresh:
            self.group = np.concatenate([self.group, np.array(fresh, np.int64)])
        n = len(self.names)
        ends, begins = np.full(n, -(1 << 30)), np.full(n, 1 << 30)
        ends[item], begins[item] = high, low
        start = piece * PIECE
        text = np.zeros((n, PIECE), np.uint8)
        begin, size = np.maximum(low, start) - start, np.array([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        first = np.cumsum(size) - size
        inside = np.arange(len(flat)) - np.repeat(first, size)
        text[np.repeat(item, size), inside + np.repeat(begin, size)] = flat
        by_end: dict[int, np.ndarray] = {}
        local = np.minimum(high, start + PIECE)
        entering = high <= start + PIECE
        order = np.argsort(local[entering], kind="stable")
        ids, at = item[entering][order], local[entering][order]
        for x in np.unique(at).tolist():
            by_end[x] = ids[at == x]
        columns = np.ascontiguousarray(text.T)
        for x in range(start + PIECE - 1, start - 1, -1):
            self.step(x, columns[x - start], begins, by_end.get(x + 1))

    def step(self, x: int, bytes_at: np.ndarray, begins: np.ndarray, entering: np.ndarray | None) -> None:
        """Induces the order of the suffixes at column x from that at x + 1."""
        order, prefix = self.order, self.prefix
        gone = begins[order] > x
        if gone.any():
            # what stays next to one that leaves shares with its new neighbour the least of the prefixes between
            stay = np.flatnonzero(~gone)
            prefix = np.minimum.reduceat(prefix[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else prefix[:0]
            order = order[stay]
        if entering is not None:
            order = np.concatenate([entering, order])
            prefix = np.concatenate([np.zeros(len(entering), np.int64), prefix])
        n = len(order)
        if not n:
            self.order, self.prefix = order, prefix
            return
        key = self.group[order] * 256 + bytes_at[order]
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        alike = sorted_key[1:] == sorted_key[:-1]
        p, q = by[:-1][alike], by[1:][alike]
        least = prefix[q]
        far = np.flatnonzero(q != p + 1)
        if len(far):
            pairs = np.empty(2 * len(far), np.int64)
            pairs[::2], pairs[1::2] = p[far] + 1, q[far] + 1
            least[far] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2]
        new = np.zeros(n, np.int64)
        new[1:][alike] = least + 1
        self.order, self.prefix = order[by], new
        same = new >= self.length
        if same.any():
            same[:-1] |= same[1:]
            self.hits.append((x, self.order[same]))

    def repeats(self):
        """(anchor, stretch, runs): columns first, last, first, last, ... at which repeated windows start."""
        if not self.hits:
            return
        item = np.concatenate([v for _, v in self.hits])
        x = np.concatenate([np.full(len(v), k) for k, v in self.hits])
        by = np.lexsort((x, item))
        item, x = item[by], x[by]
        cut = np.flatnonzero((item[1:] != item[:-1]) | (x[1:] != x[:-1] + 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(x) - 1]])
        runs: dict[int, list[int]] = {}
        for i, a, z in zip(item[first].tolist(), x[first].tolist(), x[last].tolist(), strict=True):
            runs.setdefault(i, []).extend((a, z))
        for i, v in runs.items():
            yield *self.names[i][1:], v


def sort_shards(sorted_pieces: DataFrame, length: int) -> DataFrame:
    """Pieces in the order (shard, falling piece) -> anchor, stretch, runs."""

    def run(batches):
        def emit(shard):
            found = list(shard.repeats())
            if found:
                a, s, r = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(r, pa.list_(pa.int32()))], ["anchor", "stretch", "runs"])

        shard, number, piece, held = None, None, None, []

        def close():
            if held:
                keys, low, high, data = zip(*held, strict=True)
                shard.add(piece, list(keys), np.array(low), np.array(high), list(data))
                held.clear()

        for b in batches:
            columns = [b.column(k).to_pylist() for k in ("shard", "piece", "group", "anchor", "stretch", "low", "high", "data")]
            for n, p, g, a, s, low, high, data in zip(*columns, strict=True):
                if n != number or p != piece:
                    close()
                    if n != number:
                        if shard is not None:
                            yield from emit(shard)
                        shard, number = Shard(length), n
                    piece = p
                held.append(((g, a, s), low, high, data))
        close()
        if shard is not None:
            yield from emit(shard)

    return sorted_pieces.transform(common.small_batches).mapInArrow(run, "anchor long, stretch long, runs array<int>")


def repeated_ranges(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(doc, part, text) -> doc, part, ranges: first, end, first, end, ... of repeated bytes, not merged."""
    found = common.materialize(find_stretches(docs, length))
    kinds = found.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "part", "first", "last", "at")).alias("one"))
    kinds = common.materialize(kinds.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).filter("n > 1").join(kinds.withColumnRenamed("n", "copies"), "anchor"))
    several = kinds.filter("different > 1")
    shards = max(1, several.count() // SHARD)
    wanted = several.groupBy(F.col("one.doc").alias("wanted_doc"), F.col("one.part").alias("wanted_part")).agg(F.collect_list(F.struct("anchor", "stretch", "one.first", "one.last", "one.at", (F.col("different") > hot).alias("hot"))).alias("wanted"))
    rows = docs.join(wanted, docs.doc.eqNullSafe(F.col("wanted_doc")) & (docs.part == F.col("wanted_part")))
    rows = rows.dropDuplicates(["wanted_doc", "wanted_part"]).select("text", "wanted")
    made = pieces(rows, length, shards).repartition(common.partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", F.desc("piece"), "group", "anchor", "stretch")
    sorted_out = common.materialize(sort_shards(made, length))
    whole = kinds.filter("copies > 1").select("anchor", "stretch", F.lit(None).cast("array<int>").alias("runs"))
    partial = sorted_out.join(kinds.filter("copies > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_anti")
    hit = found.join(whole.unionByName(partial), ["anchor", "stretch"])
    ranges = F.when(F.col("runs").isNull(), F.array(F.col("first"), F.col("last") + length)).otherwise(F.transform("runs", lambda x, i: x + F.col("at") + (i % 2) * length))
    return hit.select("doc", "part", ranges.alias("ranges")).groupBy("doc", "part").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def merged(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint (firsts, ends) in order; ranges that touch are one."""
    first, end = ranges[::2], ranges[1::2]
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(end[by])
    cut = np.flatnonzero(first[1:] > end[:-1]) + 1
    return first[np.concatenate([[0], cut])], end[np.concatenate([cut - 1, [len(end) - 1]])]


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("part"), "text")
    hit = common.materialize(repeated_ranges(rows, length, hot)).withColumnsRenamed({"doc": "hit_doc", "part": "hit_part"})
    both = rows.join(hit, rows.doc.eqNullSafe(F.col("hit_doc")) & (rows.part == F.col("hit_part")), "left").select("doc", "text", "ranges")

    def run(batches):
        for b in batches:
            size, gone, spans, kept = [], [], [], []
            for t, r in zip(b.column("text"), b.column("ranges"), strict=True):
                x = as_bytes(t)
                size.append(len(x))
                if r.is_valid and len(r):
                    first, end = merged(np.array(r.as_py(), np.int64))
                    out, at = [], 0
                    for a, z in zip(first.tolist(), end.tolist(), strict=True):
                        out.append(x[at:a].tobytes())
                        at = z
                    out.append(x[at:].tobytes())
                    kept.append(b"".join(out))
                    gone.append(int((end - first).sum()))
                    spans.append(len(first))
                else:
                    kept.append(x.tobytes())
                    gone.append(0)
                    spans.append(0)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """kept -> kept_sha256."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
