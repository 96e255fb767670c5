"""Vector codes, clusters and decontamination against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factorloom.llm import centroids, decontamination, exact, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, bounds int, slot int"


def vectors(rng, n=300, width=64, spread=1.0):
    """Rows with copies, ties, nulls, values that aren't finite, null ids and labels, repeated rows and equal ids."""
    out = []
    for i in range(n):
        v = [round(rng.uniform(-spread, spread), 2) for _ in range(width)]
        if i % 9 == 0:
            v = out[i // 2][1] if i else v  # a copy
        if i % 11 == 0:
            v = [float(round(x)) for x in v]  # ties
        out.append((i * 3 % 1000, v, None if i % 13 == 0 else i % 4, "x", 1, 2))
    out += [(None, out[5][1], 1, "x", 1, 2), (7001, None, 1, "x", 1, 2), (7002, [None] + [0.0] * (width - 1), 1, "x", 1, 2)]
    out += [(7003, [math.nan] * width, 1, "x", 1, 2), (7004, [math.inf] + [0.0] * (width - 1), 2, "x", 1, 2), out[8], (out[9][0], [0.5] * width, 3, "x", 1, 2)]
    rng.shuffle(out)
    return out


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def kept_rows(rows, scale):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], whole(r[1], scale), r[2]) for r in fine]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, centres, rounds):
    """(nearest, centres) by all distances, in Python's integers."""
    centres = [list(c) for c in centres]
    for turn in range(rounds + 1):
        near = [min(range(len(centres)), key=lambda k, p=p: (distance(p, centres[k]), k)) for p in points]
        if turn == rounds:
            return near, centres
        for k in range(len(centres)):
            if own := [p for p, n in zip(points, near, strict=True) if n == k]:
                centres[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]


def id_first(r):
    return (r[0] is None, r[0] or 0, r[1])


@pytest.mark.parametrize(("width", "spread", "seed"), [(64, 1.0, 1), (16, 0.004, 2), (8, 3e5, 3), (24, 2.0, 4)])
def test_codes_equal_brute_force(spark, width, spread, seed):
    rows = vectors(random.Random(seed), 160, width, spread)
    points = kept_rows(rows, 4096)
    part = width // 8
    first = sorted(points, key=id_first)[:16]
    code, error, books = defaultdict(list), defaultdict(int), []
    for p in range(8):
        cut = [r[1][p * part : (p + 1) * part] for r in points]
        near, centres = lloyd(cut, [r[1][p * part : (p + 1) * part] for r in first], 6)
        books += [str(v) for c in centres for v in c]
        for i, k in enumerate(near):
            code[i].append(f"{k:02x}")
            error[i] += distance(cut[i], centres[k])
    label = defaultdict(int)
    for i, r in enumerate(points):
        label[r[2]] += error[i]
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    want = sorted((r[0] or -1, "".join(code[i]), error[i], min(label[r[2]], exact.LONG), sha) for i, r in enumerate(points))
    got = vector_codes.digest(vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == want


@pytest.mark.parametrize(("spread", "seed"), [(1.0, 1), (0.05, 2), (4e4, 3)])
def test_clusters_equal_brute_force(spark, spread, seed):
    rows = vectors(random.Random(seed), 240, 64, spread) + [(8001, [0.25] * 63, 1, "x", 1, 2), (8002, [], 1, "x", 1, 2), (8003, [0.1] * 65, 1, "x", 1, 2)]
    points = [r for r in kept_rows(rows, 64) if len(r[1]) == 64]
    drawn = sorted(points, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:16]
    near, centres = lloyd([r[1] for r in points], [r[1] for r in drawn], 3)
    far = [distance(r[1], centres[k]) for r, k in zip(points, near, strict=True)]
    per = defaultdict(int)
    for d, k in zip(far, near, strict=True):
        per[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = sorted((r[0] or -1, k, d, per[k], sum(far), sha[k]) for r, k, d in zip(points, near, far, strict=True))
    got = centroids.digest(centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3)))
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == want


def test_few_or_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.digest(vector_codes.compress(none)).count() == 0 and centroids.digest(centroids.cluster(none)).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 64, None, "x", 1, 2)], VECTORS)
    assert [(r.code, r.error, r.label_error) for r in vector_codes.digest(vector_codes.compress(one)).collect()] == [("00" * 8, 0, 0)]
    assert [(r.cluster, r.distance, r.inertia) for r in centroids.digest(centroids.cluster(one)).collect()] == [(0, 0, 0)]
    # other lengths: filled up with zeros for codes, left out of clusters
    odd = spark.createDataFrame([(1, [1.0] * 10, 1, "x", 1, 2), (2, [1.0] * 3, 1, "x", 1, 2), (3, [], 1, "x", 1, 2)], VECTORS)
    assert [r.error for r in vector_codes.digest(vector_codes.compress(odd)).collect()] == [0, 0, 0] and centroids.cluster(odd).table.count() == 0
    huge = spark.createDataFrame([(i, [3e38 if i else -3e38] * 64, 1, "x", 1, 2) for i in range(20)], VECTORS)
    assert vector_codes.digest(vector_codes.compress(huge)).count() == centroids.digest(centroids.cluster(huge)).count() == 20


@pytest.mark.parametrize("seed", range(12))
def test_bounds_never_lose_a_centre(seed):
    """Both kinds of bounds give the nearest centre, ties to the lower number, after any moves of centres."""
    rng = np.random.default_rng(seed)
    n, k, width, high = int(rng.integers(1, 300)), int(rng.integers(1, 40)), int(rng.integers(1, 9)), int(rng.choice([2, 6, 4000]))
    x = rng.integers(-high, high, (n, width)).astype(float) * (2.0**40 if seed % 4 == 0 else 1.0)
    c = x[rng.integers(0, n, k)].copy()
    group = vector_codes.grouped(c)
    groups = int(group.max()) + 1
    entry, upper, lower = vector_codes.first_assignment(x, c, group, groups)
    stored = min(max(1, k // 4), k - 1)
    state = centroids.scanned(x, c, centroids.layout(stored))
    for _ in range(6):
        new = c + rng.integers(-2, 3, c.shape) * (rng.random((k, 1)) < 0.4) * max(1, high // 8)
        drift, c = exact.drifts(c, new), new
        near = exact.squares(x, c).argmin(1)
        entry, upper, lower = vector_codes.next_assignment(x, c, group, groups, drift, entry, upper, lower)
        after = min(stored, max(1, int(rng.integers(0, stored + 1)))) if stored else 0
        state, depth = centroids.adjusted(x, c, drift, state, centroids.layout(after))
        assert (entry == near).all() and (state["own"] == near).all() and 0 <= depth <= stored
        stored = after


# decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(docs, items, window=10):
    held = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            held[tuple(w[j : j + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in held}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (x := held.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= x
        text = ",".join(sorted(found, key=lambda s: s.encode()))
        out.append((-1 if d is None else d, len(w), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run_leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, segments string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int").repartition(2)
    got = decontamination.digest(decontamination.decontaminate(d, b))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect())


@pytest.mark.parametrize("short", [False, True])
def test_decontamination_equals_brute_force(spark, short):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "日本", "Ünï", "A1"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", " -- ", "_"]) for _ in range(n))
    items = [(i, text(rng.randint(10, 60))) for i in range(30)]
    items += [(4, items[4][1]), (100, items[4][1]), (101, items[4][1] + " " + text(5)), (None, items[6][1]), (102, None), (103, ""), (104, "... --"), (105, "z " * 40)]
    if short:
        items += [(200, "w1"), (201, "w2 w3"), (202, text(4)), (203, text(5)), (204, text(7)), (205, text(9)), (206, "w2, W3!")]
    docs = []
    for i in range(120):
        t = text(rng.randint(0, 200)).split(" ")
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(len(w))
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[a : a + rng.randint(5, 40)]
        docs.append((i, (" " if i % 2 else "\n").join(t)))
    docs += [(500, None), (501, ""), (502, "?!"), (3, docs[3][1]), (3, "another"), (None, items[0][1]), (503, items[1][1].upper()), (504, "z " * 25), (505, "z " * 9)]
    docs += [(600 + i, items[2][1]) for i in range(50)] + [(700, " ".join(x[1] for x in items[:20]) * 30), (701, "ab" * 1_200_000 + " " + items[3][1])]
    assert run_leaks(spark, docs, items) == leaks(docs, items)


def test_decontamination_of_empty_tables(spark):
    items, docs = [(1, "a b c d e f g h i j k")], [(1, "x a b c d e f g h i j"), (2, "a b c d e f g h i x")]
    assert run_leaks(spark, [], items) == []
    assert run_leaks(spark, docs, []) == leaks(docs, [])
    assert run_leaks(spark, docs, [(None, None)]) == leaks(docs, [])
    assert [r[2] for r in run_leaks(spark, docs, items)] == [10, 0]
