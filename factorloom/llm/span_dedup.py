"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after marks that end one, at line ends, and in sentences of over LONGEST words
after words chosen by their hash (after MOST words if none is), so that equal passages are cut alike wherever they stand. A span starts at a
sentence and takes sentences until it has SENTENCES of them and MIN_WORDS words. Spans are hashed by their words
(lower-cased, without punctuation) and joined globally; a sentence is removed if any span that covers it
occurs earlier: in a document of lesser doc_id, or before in the same document.

Defined results: a null text stays null and an empty one empty; a text without words is never changed; rows of equal doc_id are ordered by a
hash of the text, and rows equal in both are one document, changed alike; a null doc_id comes last; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes, common

SENTENCES = 3
MIN_WORDS = 20
LONGEST = 12
#: In a long sentence, one word in CUT ends a piece.
CUT = 6
#: Words after which a piece ends if no word's hash ends it.
MOST = 24
#: Bits of the map that tells spans which may be repeated.
MARK_BITS = 25
ENDS = np.array([ord(c) for c in ".!?\n\r…。！？"], np.uint32)


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, words, hashes): first character of each sentence, its number of words, and a hash of them.

    White space after a sentence belongs to it; the first starts at 0.
    """
    c = codes.points(text)
    low = codes.points(text.lower())
    if len(low) != len(c):
        low = codes.points("".join(x if len(x.lower()) != 1 else x.lower() for x in text))
    kind = codes.class_of(low)
    inside = (kind == codes.LETTER) | (kind == codes.DIGIT)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64)
    h = codes.run_hashes(low, first, last - first)
    # a sentence mark between this word and the next ends the sentence, unless it stands between digits
    marks = np.flatnonzero(np.isin(c, ENDS))
    at = np.searchsorted(first, marks, side="right") - 1
    ends = np.zeros(len(first), bool)
    ends[at[at >= 0]] = True
    glued = np.zeros(len(first), bool)
    glued[:-1] = (first[1:] - last[:-1] == 1) & (c[last[:-1]] != 10)
    ends &= ~glued
    ends[-1] = True
    # pieces of long sentences
    stop = np.flatnonzero(ends)
    begin = np.concatenate([[0], stop[:-1] + 1])
    size = stop - begin + 1
    long = np.repeat(size > LONGEST, size)
    ends |= long & (h % np.uint64(CUT) == 0)
    stop = np.flatnonzero(ends)
    begin = np.concatenate([[0], stop[:-1] + 1])
    place = np.arange(len(h)) - np.repeat(begin, stop - begin + 1)
    ends |= place % MOST == MOST - 1
    stop = np.flatnonzero(ends)
    begin = np.concatenate([[0], stop[:-1] + 1])
    size = stop - begin + 1
    spread = h.copy()
    place = np.arange(len(h)) - np.repeat(begin, size)
    spread *= codes.powers(1 << 12)[place & 0xFFF]
    hashes = codes.mix64(np.add.reduceat(spread, begin) + size.astype(np.uint64))
    starts = first[begin].astype(np.int64)
    # marks before a sentence's first word, such as quotes, go with it from the last white space on
    back = np.flatnonzero(kind == codes.SPACE)
    if len(back):
        k = np.searchsorted(back, starts, side="left") - 1
        starts = np.where(k >= 0, back[np.maximum(k, 0)] + 1, 0)
    starts[0] = 0
    return starts, size.astype(np.int64), hashes


def spans(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes) of the span that starts at each sentence; end is exclusive, 0 where too few sentences or words are left."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    by_words = np.searchsorted(total, total[:-1] + MIN_WORDS, side="left")
    end = np.maximum(by_words, np.arange(n) + SENTENCES)
    fits = end <= n
    end = np.where(fits, end, 0)
    # a hash of hashes[i:end] from prefix sums with position-free weights: sum of h[k] * q^k, divided by q^i
    q, q_inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up, down = _powers(q, n + 1), _powers(q_inverse, n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    made = (sums[end] - sums[:-1]) * down[:n]
    made = codes.mix64(made + (end - np.arange(n)).astype(np.uint64))
    return end, np.where(fits, made, 0)


_HELD: dict[int, np.ndarray] = {}


def _powers(q: int, n: int) -> np.ndarray:
    held = _HELD.get(q)
    if held is None or len(held) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            held = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, q, np.uint64), dtype=np.uint64)])
        _HELD[q] = held
    return held[:n]


def span_hashes(text: str | None) -> np.ndarray:
    """Hash of the span at each sentence, as signed 64-bit numbers; 0 for none."""
    if not text:
        return np.empty(0, np.int64)
    _, words, hashes = sentences(text)
    return spans(words, hashes)[1].view(np.int64)


def without(text: str, repeated: np.ndarray) -> tuple[str, int, int]:
    """(text without the sentences that the spans starting at `repeated` cover, sentences, sentences removed)."""
    starts, words, hashes = sentences(text)
    end, _ = spans(words, hashes)
    cover = np.zeros(len(starts) + 1, np.int64)
    ok = repeated[(repeated < len(starts))]
    ok = ok[end[ok] > 0]
    np.add.at(cover, ok, 1)
    np.add.at(cover, end[ok], -1)
    gone = np.cumsum(cover)[:-1] > 0
    if not gone.any():
        return text, len(starts), 0
    edges = [*starts.tolist(), len(text)]
    kept = "".join(text[edges[i] : edges[i + 1]] for i in np.flatnonzero(~gone).tolist())
    return kept, len(starts), int(gone.sum())


#: Stands for a null doc_id, so that those documents come last.
NONE = (1 << 63) - 1


def place(text, doc_id):
    """A document's place in the order: doc (nulls last), then part, a hash of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(NONE)).alias("doc"), F.xxhash64(text).alias("part")


def marked(made: DataFrame, seen: DataFrame) -> DataFrame:
    """doc, part, position, span of the spans in `seen` and of few others, so that few rows go to the join.

    What is broadcast is a bitmap of 2 ** MARK_BITS bits, whatever the number of spans.
    """
    bit = F.col("span").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = seen.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(span & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MARK_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = made.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        for b in batches:
            spans = b.column("spans")
            flat = spans.flatten().to_numpy(zero_copy_only=False)
            sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            low = flat & ((1 << MARK_BITS) - 1)
            hit = np.flatnonzero(((held.value[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (flat != 0))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            position = hit - (np.cumsum(sizes) - sizes)[row]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("part").take(at), pa.array(position.astype(np.int32)), pa.array(flat[hit])], ["doc", "part", "position", "span"])

    return made.transform(common.small_batches).mapInArrow(run, "doc long, part long, position int, span long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc, part, positions: the first sentences of every span that occurs earlier; written out."""

    def run(batches):
        for b in batches:
            made = [span_hashes(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), pa.array(made, pa.list_(pa.int64()))], ["doc", "part", "spans"])

    made = docs.select("text", *place(F.col("text"), F.col("doc_id"))).transform(common.small_batches).mapInArrow(run, "doc long, part long, spans array<long>")
    made = common.materialize(made)
    rows = made.select("doc", "part", F.posexplode("spans").alias("position", "span")).filter("span != 0")
    at = F.struct("doc", "part", "position")
    # written out, so that the join below reads both sides from exchanges and a very common span can be split
    seen = common.materialize(rows.groupBy("span").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("span", "first"))
    again = marked(made, seen).join(seen, "span").filter(at != F.col("first"))
    out = common.materialize(again.groupBy("doc", "part").agg(F.collect_set("position").alias("positions")))
    common.release(made)
    common.release(seen)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with text shortened, and sentences and removed_sentences counted; columns of those names are replaced."""
    docs = docs.drop("sentences", "removed_sentences")
    hit = repeated_spans(docs.select("doc_id", "text"))
    hit = hit.select(F.col("doc").alias("__doc"), F.col("part").alias("__part"), F.col("positions").alias("__positions"))
    doc, part = place(docs.text, docs.doc_id)
    rows = docs.join(hit, (doc == hit["__doc"]) & (part == hit["__part"]), "left")
    names = docs.columns
    rows = rows.select(*[F.col(f"`{c}`") for c in names], "__positions")
    at = names.index("text")

    def run(batches):
        for b in batches:
            text, count, gone = [], [], []
            for t, p in zip(b.column(at), b.column(len(names)), strict=True):
                t = t.as_py()
                if not t:
                    done = (t, 0, 0)
                elif not p.is_valid:
                    done = (t, len(sentences(t)[0]), 0)
                else:
                    done = without(t, np.sort(np.array(p.as_py(), np.int64)))
                for out, v in zip((text, count, gone), done, strict=True):
                    out.append(v)
            columns = [*b.columns[:-1], pa.array(count, pa.int64()), pa.array(gone, pa.int64())]
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, "sentences", "removed_sentences"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("sentences", T.LongType()), T.StructField("removed_sentences", T.LongType())])
    return rows.transform(common.small_batches).mapInArrow(run, schema)
