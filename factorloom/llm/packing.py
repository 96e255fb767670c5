"""Packing documents into token sequences along a Hilbert curve.

A document's token ids are hashed to fixed random vectors whose mean, in three dimensions, places it in a
cube; the cube's Hilbert curve orders documents so that neighbours are alike. Documents are range-sorted by
curve key and packed one after another, cut wherever a sequence is full. Each knows where its partition's tokens before it end;
with the sums of the partitions before, a table of one row a partition, sequences run over partition
borders, and only the very last one is not full, however many partitions there are.

Token ids travel as 16-bit numbers (32-bit where the vocabulary is larger), so texts are tokenized once.

Defined results: a null text is empty and has just the end id; equal keys are ordered by doc_id and content;
repeated rows are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codes, common

LENGTH = 2048
END = 1
BITS = 10
DIMS = 3
#: How byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of that pattern; runs of so many characters are taken out before it is matched, and texts are cut after so many.
LONG_RUN, STRETCH = 1 << 16, 1 << 20
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = re.compile(f"(?<![{BLANK}])[{BLANK}]{{{LONG_RUN},}}")
#: A single space between other characters always begins a piece.
BETWEEN = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_of() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def vocabulary(path: str) -> int:
    """One more than the greatest id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])


def encoder(path: str):
    """(text -> array of ids as the tokenizers file gives them without special tokens added, size of the vocabulary).

    Strings of added tokens are cut out first, as that library does; what lies between goes to a faster implementation of the same
    merges, in stretches that end where the vocabulary's pattern always splits. A very long run of white space, which that pattern can't
    be matched on, is merged as the one piece that it is.
    """
    return _encoder(path)


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t for t in spec.get("added_tokens", [])}
    chars = byte_of()
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    split = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added.values())
    tokens = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) or r"(?!)")

    def ids(how: tiktoken.Encoding, text: str) -> np.ndarray:
        # a list is made faster, but takes many times the memory
        return np.array(how.encode_ordinary(text), np.uint32) if len(text) < LONG_RUN else np.asarray(how.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def stretch(text: str, out: list[np.ndarray]) -> None:
        if len(text) < LONG_RUN:
            out.append(ids(split, text))
            return
        at = 0
        for m in BLANKS.finditer(text):
            # the run but for its last character is a piece, unless the text ends here
            end = m.end() - (m.end() < len(text))
            pieces(text, at, m.start(), out)
            out.append(ids(whole, text[m.start() : end]))
            at = end
        pieces(text, at, len(text), out)

    def pieces(text: str, at: int, end: int, out: list[np.ndarray]) -> None:
        while at < end:
            m = BETWEEN.search(text, at + STRETCH, end) if end - at > STRETCH else None
            to = m.start() if m else end
            out.append(ids(split, text[at:to]))
            at = to

    def encode(text: str) -> np.ndarray:
        out: list[np.ndarray] = [np.empty(0, np.uint32)]
        if len(text) < LONG_RUN and not any(t in text for t in added):
            return ids(split, text)
        if any(t in text for t in added):
            if not plain:
                return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
            at = 0
            for m in tokens.finditer(text):
                stretch(text[at : m.start()], out)
                out.append(np.array([added[m[0]]["id"]], np.uint32))
                at = m.end()
            text = text[at:]
        stretch(text, out)
        return np.concatenate(out)

    return encode, vocabulary(path)


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def directions(size: int) -> np.ndarray:
    """A fixed random vector for each id: sums of hashed uniform numbers, near normal."""
    h = codes.mix64(np.arange(size * DIMS * 4, dtype=np.uint64) + np.uint64(0x51ED27)) >> np.uint64(11)
    u = h.astype(np.float64) / (1 << 53) - 0.5
    return (u.reshape(size, DIMS, 4).sum(axis=2) * np.sqrt(3)).astype(np.float32)


def place(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cell of a document in the cube: its ids' vectors summed over the root of their number, through a sigmoid."""
    if not len(ids):
        return np.full(DIMS, 1 << (BITS - 1), np.int64)
    x = np.zeros(DIMS)
    for i in range(0, len(ids), 1 << 16):
        x += table.take(ids[i : i + (1 << 16)], axis=0).sum(axis=0)
    x = x / len(ids) * 6
    return np.minimum((1 / (1 + np.exp(-np.clip(x, -30, 30))) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of cell numbers; the curve visits every cell once, by unit steps.

    From the highest bit down, each axis with its bit set inverts the lower bits of the first axis, and each
    without exchanges them with the first axis's; the Gray code of the result, bits interleaved, is the index.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, key, digest, size, ids (little-endian, end id included)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode, size = encoder(path)
        table = directions(size)
        width = np.uint16 if size <= 1 << 16 else np.uint32
        for b in batches:
            packed, cells, digests, sizes = [], [], [], []
            for t in b.column("text"):
                ids = np.append(encode(t.as_py() or ""), END).astype(width)
                cells.append(place(ids[:-1], table))
                sizes.append(len(ids))
                packed.append(ids.tobytes())
                digests.append(zlib.crc32(packed[-1]))
            keys = hilbert(np.stack(cells)) if cells else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.int64()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "key", "digest", "size", "ids"])

    return docs.select("doc_id", "text").transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, key long, digest long, size long, ids binary")


def lay_out(made: DataFrame) -> DataFrame:
    """Rows of `tokenize` in curve order -> doc_id, ids, part (partition), begin (the partition's tokens before the document), n (its tokens)."""
    ordered = made.repartitionByRange(common.partitions(made.sparkSession), "key", "doc_id", "digest").sortWithinPartitions("key", "doc_id", "digest")
    kind = dict(made.dtypes)["doc_id"]

    def run(batches):
        part, begin = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = np.array(b.column("size").to_pylist(), np.int64)
            begins = begin + np.cumsum(sizes) - sizes
            begin += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(begins), pa.array(sizes)], ["doc_id", "ids", "part", "begin", "n"])

    return ordered.select("doc_id", "ids", "size").transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, ids binary, part int, begin long, n long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    made = common.materialize(tokenize(docs, path))
    laid = common.materialize(lay_out(made))
    common.release(made)
    # one row a partition
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = laid.groupBy("part").agg(F.sum("n").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    placed = laid.join(F.broadcast(ends), "part").select("doc_id", "ids", (F.col("before") + F.col("begin")).alias("at"))

    def run(batches):
        width = np.uint16 if vocabulary(path) <= 1 << 16 else np.uint32
        for b in batches:
            rows = {k: [] for k in ("row", "start", "length", "crc", "tokens", "sequence", "offset")}
            for i, (raw, at) in enumerate(zip(b.column("ids"), b.column("at").to_pylist(), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), width).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    n = min(length - offset, len(ids) - start)
                    for k, v in zip(rows, (i, start, n, zlib.crc32(ids[start : start + n]), len(ids), sequence, offset), strict=True):
                        rows[k].append(v)
                    start += n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows["row"], pa.int64())), *[pa.array(rows[k], pa.int64()) for k in list(rows)[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return placed.transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
