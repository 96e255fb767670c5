"""Benchmark decontamination: windows of benchmark items found in documents by a prefix-filtered set join.

Words are runs of characters other than ASCII's non-alphanumerics, with A-Z lowered. A window is `window` consecutive words of an item; a
shorter item is one window. As a set of shingles of SHINGLE words (or the whole window, where it has fewer words) a window occurs
only where all its shingles do, so a threshold of full containment makes one shingle the necessary prefix: the rarest.

1. Items give windows, each distinct one once, and the shingles of windows as a bitmap of fixed size.
2. Documents are read once. Places whose shingle is in the bitmap form segments; the length bound drops those with fewer such
   places in a row than any window has shingles. Segments are the only text that leaves a document; equal ones are looked at once.
3. Shingles are counted over segments times copies; each window is joined by its rarest shingle only, and by none if one of its
   shingles occurs nowhere.
4. A joined place must leave room for the window before and after (positional and length bound); then the window's words are compared
   with the words there, exactly.
5. Windows with the same items share a list of items, and documents with the same lists share its digest, so that neither copies of an item
   nor copies of a document are multiplied with each other.

* A null text has no word; nor has one without letters, digits or characters beyond ASCII. Such documents have zeros and the digest of an
  empty string. Items without words have no window.
* Rows with the same item_id are one item for counting. A null item_id counts as one item and is written as an empty string.
* Each row of documents gives a row, repeated ones too. Empty tables: no rows, or documents without hits.
* Texts are read whole whatever their length; other columns of either table are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .common import materialize, small_batches

SHINGLE = 5
#: Bits of the bitmap that goes to all tasks, whatever the number of items; more items only mean more segments to look at.
BITMAP_BITS = 1 << 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with A-Z lowered, where each text begins and the last ends); nulls are empty."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    b = _LOWER[whole[ends[0] : ends[-1]]]
    edges = ends - ends[0]
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_null()), 0, np.diff(edges))
        if lengths.sum() != len(b):  # a null may stand over bytes
            texts = texts.fill_null("")
            return buffers(pa.array(texts.to_pylist(), pa.large_string()))
    return b, edges


def words_of(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text number) of every word; words don't cross from one text to the next."""
    inside = _IN_WORD[b]
    begins, ends = np.zeros(len(b) + 1, bool), np.zeros(len(b) + 1, bool)
    begins[edges] = ends[edges] = True
    begins[1:-1] |= ~inside[:-1]
    ends[1:-1] |= ~inside[1:]
    start = np.flatnonzero(begins[:-1] & inside)
    length = np.flatnonzero(ends[1:] & inside) + 1 - start
    return start, length, np.searchsorted(edges, start, side="right") - 1


def word_hashes(b: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of every word, in blocks of about a million bytes; very long words by a digest."""
    out = np.empty(len(start), np.uint64)
    block = (np.cumsum(length) - length) >> 20
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(start)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        some = slice(lo, hi)
        if hi - lo == 1 and length[lo] > 1 << 20:
            word = b[start[lo] : start[lo] + length[lo]].tobytes()
            out[lo] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        elif hi > lo:
            out[some] = codes.run_hashes(b, start[some], length[some])
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size words, given the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return codes.mix64(out)


def bit_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, words of a window as one string, its number of words, hashes of its shingles; a row a distinct window of an item's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, edges = buffers(batch.column("text"))
            start, length, owner = words_of(b, edges)
            h = word_hashes(b, start, length)
            first = np.searchsorted(owner, np.arange(len(batch) + 1))
            ids = batch.column("item_id")
            for i in range(len(batch)):
                lo, hi = int(first[i]), int(first[i + 1])
                n = min(window, hi - lo)
                if not n:
                    continue
                size = min(SHINGLE, n)
                grams = shingle_hashes(h[lo:hi], size).view(np.int64)
                words = [b[s : s + k].tobytes().decode() for s, k in zip(start[lo:hi].tolist(), length[lo:hi].tolist(), strict=True)]
                found = {}
                for j in range(hi - lo - n + 1):
                    found.setdefault(" ".join(words[j : j + n]), j)
                for part in range(0, len(found), 4096):
                    some = list(found.items())[part : part + 4096]
                    cells = [pa.array([ids[i].as_py()] * len(some), ids.type), pa.array([w for w, _ in some]), pa.array([n] * len(some), pa.int32()), pa.array([grams[j : j + n - size + 1] for _, j in some], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cells, names=["item_id", "words", "n", "shingles"])

    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["item_id"]
    return small_batches(source).mapInArrow(run, f"item_id {kind}, words string, n int, shingles array<long>")


def bitmap(windows: DataFrame) -> bytes:
    """Bits of all shingles of windows; what reaches the driver is at most one bitmap a group of tasks, of fixed size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        any_ = False
        for f in frames:
            for h in f["h"]:
                at = bit_of(np.asarray(h, np.int64).view(np.uint64))
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
                any_ = True
        if any_:
            used = np.flatnonzero(bits)
            yield pd.DataFrame({"place": used, "bits": bits[used].astype(np.int32)})

    each = windows.select(F.col("shingles").alias("h")).mapInPandas(run, "place long, bits int")
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    table = each.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[table["place"].to_numpy()] = table["bits"].to_numpy().astype(np.uint8)
    return out.tobytes()


def segments(docs: DataFrame, id_col: str, text_col: str, shortest: dict[int, int], bits: bytes) -> DataFrame:
    """row, doc_id, n_words and an array of segments (words, joined by a space; hashes with their sizes and places).

    shortest: for each size of shingle, the least number of places in a row that a window takes. Places of a segment count its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def hits(h: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
        """Places whose shingle of size words is in the bitmap, in runs that are long enough. left: words to the end of the text."""
        held = np.frombuffer(shared.value, np.uint8)
        g = shingle_hashes(h, size)
        at = bit_of(g)
        ok = ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (left[: len(g)] >= size)
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= shortest[size]
        first, last = first[long], last[long]
        n = last - first
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.stack([place, np.full(len(place), size), g[place].view(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        item = pa.struct([("words", pa.string()), ("marks", pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("h", pa.int64())])))])
        for batch in batches:
            m = len(batch)
            b, edges = buffers(batch.column("text"))
            start, length, owner = words_of(b, edges)
            h = word_hashes(b, start, length)
            n_words = np.bincount(owner, minlength=m)
            left = np.cumsum(n_words)[owner] - np.arange(len(owner)) if len(owner) else np.empty(0, np.int64)
            found = np.concatenate([hits(h, left, size) for size in shortest], axis=1) if len(h) and shortest else np.empty((3, 0), np.int64)
            found = found[:, np.lexsort((found[1], found[0]))]
            made: list[list[dict]] = [[] for _ in range(m)]
            if found.shape[1]:
                place, size, g = found
                reach = np.maximum.accumulate(place + size)
                # a new segment where no word is shared with the ones before, or another text begins
                turn = np.flatnonzero((place[1:] >= reach[:-1]) | (owner[place[1:]] != owner[place[:-1]])) + 1
                cut = np.concatenate([[0], turn, [len(place)]])
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    first, last = int(place[lo]), int(reach[hi - 1])
                    words = b" ".join(b[s : s + k].tobytes() for s, k in zip(start[first:last].tolist(), length[first:last].tolist(), strict=True))
                    marks = [{"place": p - first, "size": z, "h": x} for p, z, x in zip(place[lo:hi].tolist(), size[lo:hi].tolist(), g[lo:hi].tolist(), strict=True)]
                    made[int(owner[first])].append({"words": words.decode(), "marks": marks})
            cells = [pa.array(np.arange(row, row + m)), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(made, pa.list_(item))]
            row += m
            yield pa.RecordBatch.from_arrays(cells, names=["row", "doc_id", "n_words", "segments"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return small_batches(source).mapInArrow(run, f"row long, doc_id {kind}, n_words long, segments array<struct<words:string,marks:array<struct<place:int,size:int,h:long>>>>")


def shortest_runs(windows: DataFrame) -> dict[int, int]:
    """For each size of shingle in use, the least number of shingles of a window; there are SHINGLE sizes at most."""
    size = F.least(F.lit(SHINGLE), "n")
    return {r.size: r.least for r in windows.groupBy(size.alias("size")).agg(F.min(F.col("n") - size + 1).alias("least")).collect()}


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest shingle (ties: lesser hash) and where that stands; windows with a shingle that never occurs are gone."""
    each = windows.select("window", "n", F.posexplode("shingles").alias("at", "h"))
    known = each.join(counts, "h", "left").groupBy("window", "n")
    rarest = F.min(F.struct(F.coalesce("copies", F.lit(0)).alias("copies"), "h", "at"))
    return known.agg(rarest.alias("r")).filter("r.copies > 0").select("window", "n", F.col("r.h").alias("h"), F.col("r.at").alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids as strings, sorted), for every row of docs."""
    owned = materialize(item_windows(items, item_col, item_text_col, window))
    shortest = shortest_runs(owned)
    read = materialize(segments(docs, id_col, text_col, shortest, bitmap(owned)))

    listed = owned.groupBy("words", "n").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"), F.any_value("shingles").alias("shingles"))
    listed = materialize(listed.select("words", "n", "shingles", "items", F.sha2(F.to_json("items"), 256).alias("list")))
    lists = listed.groupBy("list").agg(F.any_value("items").alias("items"))
    windows = listed.select(F.col("words").alias("window"), "n", "shingles")

    # tables that a join can be split over come from storage, not straight from an aggregation
    # equal segments once, with their number of copies
    held = read.select("row", F.explode("segments").alias("s")).select("row", F.sha2("s.words", 256).alias("segment"), "s.words", "s.marks")
    distinct = materialize(held.groupBy("segment").agg(F.any_value("words").alias("words"), F.any_value("marks").alias("marks"), F.count("*").alias("copies")))
    marks = distinct.select("copies", F.explode("marks").alias("m"))
    counts = materialize(marks.groupBy(F.col("m.h").alias("h")).agg(F.sum("copies").alias("copies")))

    # around every marked place, as many words as a window can take to either side
    text = F.split("words", " ")
    around = F.transform("marks", lambda m: F.struct(m["place"].alias("place"), m["h"].alias("h"), F.greatest(m["place"] - (window - 1), F.lit(0)).alias("from")))
    places = distinct.select("segment", text.alias("w"), F.explode(around).alias("p")).select("segment", F.size("w").alias("total"), "p.place", "p.h", "p.from", F.slice("w", F.col("p.from") + 1, F.lit(2 * window)).alias("near"))
    start = F.col("place") - F.col("at")
    joined = places.join(prefixes(windows, counts), "h").filter((start >= 0) & (start + F.col("n") <= F.col("total")))
    true = joined.filter(F.array_join(F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("n")), " ") == F.col("window"))
    true = true.select("segment", start.alias("start"), (start + F.col("n")).alias("stop"), F.col("window")).join(listed.select(F.col("words").alias("window"), "list"), "window")
    found = true.groupBy("segment").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.collect_set("list").alias("lists"))
    # spans in order: each adds what lies beyond the ones before
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("hit"), F.greatest(a["end"], s["stop"]).alias("end")),
        lambda a: a["hit"],
    )
    found = materialize(found.select("segment", covered.cast("long").alias("hit"), "lists"))

    hit = held.select("row", "segment").join(found, "segment").groupBy("row").agg(F.sum("hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"))
    hit = materialize(hit.withColumn("combination", F.sha2(F.array_join("lists", ","), 256)))
    combined = hit.groupBy("combination").agg(F.any_value("lists").alias("lists")).select("combination", F.explode("lists").alias("list")).join(lists, "list")
    combined = materialize(combined.groupBy("combination").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    out = hit.select("row", "n_hit", "combination").join(combined, "combination")
    out = read.select("row", "doc_id", "n_words").join(out, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
