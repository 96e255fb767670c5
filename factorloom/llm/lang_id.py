"""Language identification by string kernels.

The kernel of two texts is the number of n-grams of letters (n = 1, 2, 3, blended) that are present in both,
over the square root of the numbers in each; n-grams are hashed to DIM bits. Nyström landmarks stand in for
the training rows, and one-versus-rest kernel ridge regression gives a score a language. Texts are scored in
batches: presence rows times landmark rows is the kernel, kernel times coefficients the scores.

The model is fitted on about `max_rows` rows, as many of each language, drawn by hash, and on LEAST_ROWS of a language where there are
very many (documented bound; no language is left out). `landmarks` of them, or two a language if that is more, are gathered; tasks compute the
kernel of the drawn rows with them, and the driver solves for the coefficients. Prediction covers every whole text.

Defined results: a null text, or one with no letter (of any plane; digits, signs and emoji are none), is `und` with score 0; equal scores go
to the language that sorts first; rows that repeat doc_id and text are predicted alike; with no row to learn from, all is `und`; a null
doc_id is held out; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codes, common

DIM_BITS = 16
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Temperature of the softmax that turns ridge scores into a confidence.
TEMPERATURE = 0.2
#: Rows of a language that are drawn at least, on average.
LEAST_ROWS = 8


def presence(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of the lower-cased text with every run of other characters as one space; None if it has no letter."""
    if not text:
        return None
    c = codes.points(text.lower())
    letter = codes.class_of(c) == codes.LETTER
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, np.uint32(32))[keep]
    end = np.array([32], np.uint32)
    c = np.concatenate([end, c, end if letter[-1] else end[:0]])
    out = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h += c[k : len(c) - n + 1 + k]
            out.append(codes.mix32(h) >> np.uint32(32 - DIM_BITS))
    return np.concatenate(out)


def bits(text: str | None) -> bytes | None:
    grams = presence(text)
    if grams is None:
        return None
    row = np.zeros(DIM, np.bool_)
    row[grams] = True
    return np.packbits(row).tobytes()


class Model(NamedTuple):
    langs: list[str]
    active: np.ndarray
    landmarks: bytes
    sizes: np.ndarray
    coef: np.ndarray


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)


def choose(langs: list[str], rows: list[bytes]) -> Model:
    """The model without coefficients: landmark rows and the n-grams that they hold."""
    x = unpacked(rows)
    active = np.flatnonzero(x.any(axis=0))
    return Model(sorted(set(langs)), active, np.packbits(x[:, active], axis=1).tobytes(), np.sqrt(x.sum(axis=1, dtype=np.float64)), np.zeros((len(rows), 0), np.float32))


def kernel(model: Model, batch: int = 64):
    """texts -> (numbers of the texts that have a letter, their kernel with the landmarks)."""
    p = unpacked_landmarks(model)
    x = np.zeros((batch, DIM), np.bool_)

    def of(texts: list[str | None]):
        for start in range(0, len(texts), batch):
            rows = []
            for i, t in enumerate(texts[start : start + batch]):
                grams = presence(t)
                if grams is not None:
                    x[len(rows)] = False
                    x[len(rows), grams] = True
                    rows.append(start + i)
            if rows:
                held = x[: len(rows)]
                k = held[:, model.active].astype(np.float32) @ p
                k /= np.sqrt(np.count_nonzero(held, axis=1).astype(np.float32))[:, None]
                yield rows, k

    return of


def unpacked_landmarks(model: Model) -> np.ndarray:
    p = np.unpackbits(np.frombuffer(model.landmarks, np.uint8).reshape(len(model.sizes), -1), axis=1)[:, : len(model.active)].astype(np.float32)
    return np.ascontiguousarray((p / model.sizes[:, None].astype(np.float32)).T)


def solve(model: Model, langs: list[str], k_nm: np.ndarray, ridge: float) -> Model:
    """Kernel ridge regression, one language against the rest, on the landmarks; every language weighs the same."""
    y = np.array([model.langs.index(v) for v in langs])
    k_mm = (unpacked_landmarks(model).T @ unpacked_landmarks(model)).astype(np.float64)
    t = np.where(y[:, None] == np.arange(len(model.langs))[None, :], 1.0, -1.0)
    weighted = k_nm * (1.0 / np.bincount(y, minlength=len(model.langs))[y])[:, None]
    left = weighted.T @ k_nm + ridge * k_mm + 1e-8 * np.eye(len(k_mm))
    return model._replace(coef=np.linalg.lstsq(left, weighted.T @ t, rcond=None)[0].astype(np.float32))


def scorer(model: Model):
    """texts -> (languages, scores)."""
    of = kernel(model)

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for rows, k in of(texts):
            s = (k @ model.coef).astype(np.float64) / TEMPERATURE
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            best = s.argmax(axis=1)
            for r, b, v in zip(rows, best, s[np.arange(len(rows)), best], strict=True):
                langs[r], scores[r] = model.langs[b], float(v)
        return langs, scores

    return score


def fit(train: DataFrame, max_rows: int = 2000, landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """Fits on about max_rows of the rows (text, lang, key), drawn by hashes of key."""
    rows = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # one row a language
    counts = {r["lang"]: r["n"] for r in train.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(LEAST_ROWS, max_rows // len(counts))
    unit = F.pmod(F.xxhash64("key", F.lit("landmarks")), F.lit(1 << 30))
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1 << 30, int((1 << 30) * each / n) + 1))])
    few = rows.select("lang", "text", unit.alias("unit")).filter(F.col("unit") < F.try_element_at(rate, F.col("lang")))

    def encode(batches):
        for b in batches:
            made = [bits(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("unit"), b.column("text"), pa.array(made, pa.binary())], ["lang", "unit", "text", "bits"])

    drawn = common.materialize(few.transform(common.small_batches).mapInArrow(encode, "lang string, unit long, text string, bits binary").filter("bits IS NOT NULL"))
    turn = W.partitionBy("lang").orderBy("unit", "bits")
    share = -(-max(landmarks, 2 * len(counts)) // len(counts))
    chosen = drawn.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= share).select("lang", "bits").orderBy("lang", "turn").collect()
    if not chosen:
        common.release(drawn)
        return None
    model = choose([r["lang"] for r in chosen], [bytes(r["bits"]) for r in chosen])
    held = drawn.sparkSession.sparkContext.broadcast(model)

    def rows_of_kernel(batches):
        of = kernel(held.value)
        for b in batches:
            for at, k in of(b.column("text").to_pylist()):
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("lang").take(take), b.column("unit").take(take), pa.array([x.tobytes() for x in k], pa.binary())], ["lang", "unit", "kernel"])

    got = drawn.transform(common.small_batches).mapInArrow(rows_of_kernel, "lang string, unit long, kernel binary").collect()
    common.release(drawn)
    got.sort(key=lambda r: (r["unit"], r["lang"], r["kernel"]))
    return solve(model, [r["lang"] for r in got], np.stack([np.frombuffer(r["kernel"], np.float32) for r in got]).astype(np.float64), ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text, held_out) -> doc_id, held_out, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(held.value) if held.value else lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
        for b in batches:
            langs, scores = score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "held_out").transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held_fold: int = 0, **params) -> DataFrame:
    """Fits on the documents whose crc32 of doc_id is not held_fold modulo folds, and predicts all."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "text", "lang", key.alias("key"), (F.crc32(key.cast("binary")) % folds == held_fold).alias("held_out"))
    rows = rows.withColumn("held_out", F.col("held_out") | F.col("doc_id").isNull())
    return predict(rows, fit(rows.filter(~F.col("held_out")), **params))
