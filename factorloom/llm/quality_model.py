"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every token has a sparse ternary index vector, drawn from its hash. Its word vector is the sum of the index
vectors of its neighbours in the texts fitted on. A document is the mean and the spread of its tokens' word
vectors and the mean of their index vectors; a two-layer numpy network scores it, and a temperature fitted on rows kept out of training
calibrates the probability.

Tokens are runs of letters (lower-cased), of digits, or of other characters, plus one token for the case of a
word and one for a word that equals the one before.

The model is fitted on at most about `max_rows` labelled rows, drawn by hash, in halves for the two classes
where there are enough (documented bound). Tasks sum the neighbours' vectors of those rows' tokens and pool their documents; the driver
adds up the PARTS tables of sums and trains the small network. Scoring covers every whole text.

Defined results: a null or empty text is pooled as zeros and scored; repeated rows score alike; repeated
labels of a document count once, as the greatest; with fewer than two classes to learn from, every score is
the class's share (1 if there are no labels); a null doc_id is held out; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codes, common

DIM = 32
TABLE_BITS = 16
TABLE = 1 << TABLE_BITS
NONZERO = 4
#: Tables of sums that reach the driver, of TABLE x DIM numbers of 4 bytes (8 MB) at most.
PARTS = 8
WINDOW = 2
HIDDEN = 32
THRESHOLD = 0.7
CASE_TOKENS = (1, 2, 3)
SAME_TOKEN = 4


def tokens(text: str | None) -> np.ndarray:
    """Token numbers, in [0, TABLE); the first few numbers stand for case and repetition."""
    if not text:
        return np.empty(0, np.int64)
    raw, c = codes.points(text), codes.points(text.lower())
    if len(c) != len(raw):
        c = codes.points("".join(x if len(x.lower()) != 1 else x.lower() for x in text))
    kind = codes.class_of(c)
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate([[0], edge])
    lengths = np.diff(np.concatenate([starts, [len(c)]]))
    full = kind[starts] != codes.SPACE
    starts, lengths = starts[full], lengths[full]
    if not len(starts):
        return np.empty(0, np.int64)
    h = codes.run_hashes(c, starts, lengths)
    ids = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    word = kind[starts] == codes.LETTER
    upper = np.add.reduceat((raw != c).astype(np.int64), starts)[word] if word.any() else np.empty(0, np.int64)
    size = lengths[word]
    shape = np.where(upper == 0, CASE_TOKENS[0], np.where((upper >= size) & (size > 1), CASE_TOKENS[2], CASE_TOKENS[1]))
    w = h[word]
    same = np.concatenate([[False], w[1:] == w[:-1]]) if len(w) else np.empty(0, bool)
    out = np.empty(len(ids) + len(shape) + int(same.sum()), np.int64)
    # a word is followed by its case, then by the mark of repetition
    step = np.ones(len(ids), np.int64)
    step[word] += 1 + same
    at = np.cumsum(step) - step
    out[at] = ids
    out[at[word] + 1] = shape
    out[at[word][same] + 2] = SAME_TOKEN
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each TABLE x NONZERO."""
    h = codes.mix64(np.arange(TABLE * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(TABLE, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def index_table() -> np.ndarray:
    places, signs = index_vectors()
    flat = (np.arange(TABLE)[:, None] * DIM + places).ravel()
    return np.bincount(flat, signs.ravel(), TABLE * DIM).reshape(TABLE, DIM).astype(np.float32)


def neighbour_sums(texts: list[np.ndarray], chunk: int = 1 << 18) -> np.ndarray:
    """TABLE x DIM: for every token, the sum of the index vectors of its neighbours within WINDOW."""
    places, signs = index_vectors()
    # texts follow one another, apart by WINDOW tokens of a number that has no index vector
    places, signs = np.vstack([places, places[:1]]), np.vstack([signs, np.zeros((1, NONZERO))])
    gap = np.full(WINDOW, TABLE, np.int64)
    t = np.concatenate([x for text in texts for x in (text, gap)]) if texts else gap
    out = np.zeros((TABLE + 1) * DIM)
    for k in range(1, WINDOW + 1):
        for i in range(0, len(t) - k, chunk):
            a, b = t[i : min(i + chunk, len(t) - k)], t[i + k : i + k + chunk]
            for x, y in ((a, b), (b, a)):
                out += np.bincount((x[:, None] * DIM + places[y]).ravel(), signs[y].ravel(), len(out))
    return out.reshape(-1, DIM)[:TABLE]


def scaled(sums: np.ndarray) -> np.ndarray:
    """Word vectors: sums scaled to length 1; zero for tokens not seen."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(t: np.ndarray, vectors: np.ndarray, index: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Means of the word vectors, of their squares and of the index vectors of a document's tokens."""
    if not len(t):
        return np.zeros(3 * DIM)
    total, square, raw = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for i in range(0, len(t), chunk):
        part = t[i : i + chunk]
        v = vectors.take(part, axis=0)
        total += v.sum(axis=0)
        square += np.einsum("ij,ij->j", v, v)
        raw += index.take(part, axis=0).sum(axis=0)
    return np.concatenate([total, square, raw]) / len(t)


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def logits(m: Model, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - m.mean) / m.scale) @ m.w1 + m.b1) @ m.w2 + m.b2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, epochs: int, rate: float, decay: float) -> Model:
    """Adam over the whole sample; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(7)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    kept = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    z, t, w = ((x - mean) / scale)[~kept], y[~kept], weight[~kept] / weight[~kept].sum()
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for e in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (sigmoid(h @ p[2] + p[3]) - t) * w
        back = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((z.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**e)) / (np.sqrt(v[i] / (1 - 0.999**e)) + 1e-8)
    out = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    hold = kept if kept.any() else ~kept
    s, t, w = logits(out, x[hold]), y[hold], weight[hold]
    tries = np.exp(np.linspace(np.log(0.3), np.log(5), 60))
    loss = [-(w * (t * np.log(sigmoid(s / k) + 1e-12) + (1 - t) * np.log(1 - sigmoid(s / k) + 1e-12))).sum() for k in tries]
    return out._replace(temperature=float(tries[int(np.argmin(loss))]))


def draw(labels: DataFrame, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of about max_rows labelled documents, half of each class if it has so many; and the classes' counts."""
    n = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    most = F.lit(0).cast("long")
    for k, c in n.items():
        most = F.when(F.col("label") == k, F.lit(min(1 << 30, int((1 << 30) * (max_rows / 2) / c) + 1))).otherwise(most)
    return labels.filter(unit < most), n


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 400, rate: float = 0.01, decay: float = 5e-3) -> Model | float:
    """docs (doc_id, text), labels (doc_id, label 0/1, without the held-out rows) -> the model, or a constant score."""
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    few, n = draw(labels, max_rows)
    if len(n) < 2:
        return float(next(iter(n), 1))
    ids = common.materialize(few)  # about max_rows rows of two numbers: what is broadcast doesn't grow with the data
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def encode(batches):
        for b in batches:
            made = [tokens(t.as_py()).astype(np.uint16).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(made, pa.binary())], ["doc_id", "label", "tokens"])

    def read(b):
        return [np.frombuffer(t.as_buffer(), np.uint16).astype(np.int64) for t in b.column("tokens")]

    def sums(batches):
        total = np.zeros((TABLE, DIM))
        for b in batches:
            total += neighbour_sums(read(b))
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([x.tobytes() for x in total[seen].astype(np.int32)], pa.binary())], ["token", "sums"])

    def pooled(batches):
        index = index_table()
        for b in batches:
            made = [pool(t, held.value, index).tobytes() for t in read(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(made, pa.binary())], ["doc_id", "label", "pooled"])

    kind = dict(docs.dtypes)["doc_id"]
    coded = rows.transform(common.small_batches).mapInArrow(encode, f"doc_id {kind}, label int, tokens binary")
    coded = common.materialize(coded.repartition(PARTS, "doc_id"))
    common.release(ids)
    total = np.zeros((TABLE, DIM))
    table = coded.transform(common.small_batches).mapInArrow(sums, "token int, sums binary").toArrow()
    np.add.at(total, table.column("token").to_numpy(), np.frombuffer(b"".join(table.column("sums").to_pylist()), np.int32).reshape(-1, DIM))
    vectors = scaled(total)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    got = coded.transform(common.small_batches).mapInArrow(pooled, f"doc_id {kind}, label int, pooled binary").collect()
    common.release(coded)
    if len({r["label"] for r in got}) < 2:
        return float(got[0]["label"]) if got else 1.0
    got.sort(key=lambda r: (r["doc_id"], bytes(r["pooled"])))
    order = np.random.default_rng(11).permutation(len(got))
    y = np.array([got[i]["label"] for i in order], float)
    x = np.stack([np.frombuffer(got[i]["pooled"], np.float64) for i in order])
    # rows weigh as the classes do among all labels, but no class less than a third
    share = min(2 / 3, max(1 / 3, n[1] / (n[0] + n[1])))
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    return train(x, y, weight, vectors, epochs, rate, decay)


def score(rows: DataFrame, model: Model | float) -> DataFrame:
    """rows with text -> rows with score double and predicted int; columns of those names are replaced."""
    rows = rows.drop("score", "predicted")
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m, index = held.value, index_table()
        for b in batches:
            texts = b.column("text")
            if isinstance(m, float):
                s = np.full(len(texts), m)
            else:
                x = np.stack([pool(tokens(t.as_py()), m.vectors, index) for t in texts]) if len(texts) else np.zeros((0, 3 * DIM))
                s = sigmoid(logits(m, x) / m.temperature)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return rows.transform(common.small_batches).mapInArrow(run, schema)


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Rows that no label is learned from: crc32 of doc_id as text is `fold` modulo `folds`, or doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> docs with held_out, score and predicted."""
    learn = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, learn, **params)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
