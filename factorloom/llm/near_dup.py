"""Near-duplicate documents by Order MinHash and banded alignment.

A text is its sequence of five-word shingles (words lower-cased, punctuation dropped), each labelled with its
occurrence number so that all are distinct. For each of SKETCHES hash functions the LEAST smallest labelled
shingles are kept in text order; documents that agree on one such tuple are candidates, which favours texts
that share shingles in the same order. Two texts are linked if an alignment of their shingles within a band
of diagonals matches m of a and b shingles with m / (a + b - m) >= 0.8.

Equal texts are one node from the start, known by the digest of the text. In a bucket (texts with an equal tuple) not all
pairs are compared: every text is compared with the most typical one that it shares a bucket with, the one with the
largest buckets, which of a family of copies is the text they were made from; the links found are a forest. In further
rounds, texts of buckets that still hold several classes are compared with the most typical and with a drawn text of other classes, as long as
that finds a link for one in PAYS pairs. What is left is settled exactly: in a bucket with few pairs across classes all
of them are aligned; the texts of others are dealt anew by their rarest shingles, of which two texts of SIMILARITY must
share one, and where many pairs meet there, classes are compared by drawn texts first. Outlines (parities of hashed shingles) bound from below
how many shingles only one of two texts has, so that most pairs that can't align are never made. So any two candidates end in one class, or were aligned, or can't align. Candidates that agree on fewer than
AGREE tuples are not aligned. Classes are the components of all links.

Defined results: a null text counts as empty; texts of under five words have one shingle of all their words;
texts with no word are copies only of equal texts; rows that repeat doc_id and text are one document; a null
doc_id has a class but never names one unless the class has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes, common

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 12
LEAST = 2
#: Tuples that a pair must agree on before its texts are aligned: at similarity 0.8 a pair agrees on 7.7 of 12 on average, and on
#: fewer than 2 once in ten thousand.
AGREE = 2
#: Drawing from buckets goes on while one in so many pairs is a link.
PAYS = 8
#: Texts that stand for a class under a key in a round, if it has so many.
DRAWN = 4
#: Rounds go on while one saves this share of the pairs ahead, and more than it aligns.
WORTH = 0.2
#: Pairs across classes up to which a bucket is aligned as it is, without a look at its rarest shingles.
FEW_PAIRS = 16
#: Links up to which components and roots are found in one partition.
FEW_LINKS = 65536
#: Pairs ahead for each text, on average and once for each key they meet under, up to which all are compared at once: a round of draws costs more there.
PER_TEXT = 64
#: Sizes of texts that meet by rarest shingles are dealt in bands of this ratio.
BAND = 1.04
#: 64-bit words of a text's outline. It excludes most pairs of less than 0.7 up to about 400 shingles, and few of texts of over 1,000.
WORDS = 8
SEEDS = codes.mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every lower-cased run of letters and digits."""
    c = codes.points(text.lower())
    kind = codes.class_of(c)
    inside = (kind == codes.LETTER) | (kind == codes.DIGIT)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return codes.run_hashes(c, edge[::2], edge[1::2] - edge[::2])


def shingles(text: str | None) -> np.ndarray:
    """Occurrence-labelled shingles in text order; all distinct."""
    w = word_hashes(text or "")
    n = len(w)
    if n == 0:
        return w
    if n < SHINGLE:
        s = codes.mix64(np.array([int((w * codes.powers(SHINGLE)[:n]).sum()) & (2**64 - 1)], np.uint64) + np.uint64(n))
    else:
        s = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s += w[k : n - SHINGLE + 1 + k]
        codes.mix64(s)
    order = np.argsort(s, kind="stable")
    r = s[order]
    again = np.concatenate([[False], r[1:] == r[:-1]])
    if not again.any():
        return s
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(r))))
    label = np.empty(len(s), np.uint64)
    label[order] = (np.arange(len(r)) - first).astype(np.uint64)
    return codes.mix64(s + label * np.uint64(0xC2B2AE3D27D4EB4F))


def tuples(s: np.ndarray) -> list[int]:
    """One 64-bit key for each hash function: its LEAST smallest shingles in text order."""
    if not len(s):
        return []
    out = np.empty(SKETCHES, np.uint64)
    for j in range(SKETCHES):
        v = (s ^ SEEDS[j]) * np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(29)
        at = np.sort(np.argpartition(v, LEAST - 1)[:LEAST]) if len(s) > LEAST else np.arange(len(s))
        key = np.uint64(j + 1)
        for x in s[at]:
            key = np.uint64((int(key) * 0x100000001B3 + int(x)) & (2**64 - 1))
        out[j] = key
    return codes.mix64(out).view(np.int64).tolist()


def outline(s: np.ndarray) -> list[int]:
    """WORDS 64-bit words: the parity of the number of shingles at each of their bits. Two outlines differ in no more bits than shingles that only one text has."""
    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (len(a) + len(b) - m), m shingles matched in order within the band that a similarity of `least` leaves.

    As all shingles of a text are distinct, the alignment is the longest rising chain of places in b over the places
    in a; a path that leaves the band has more unmatched shingles than `least` allows.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    most = int(np.ceil((n + m) * (1 - least) / (1 + least))) + 1
    inside = np.abs(i - j) <= most
    i, j = i[inside], j[inside]
    if len(i) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        chain = len(j)
    else:
        from bisect import bisect_left

        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        chain = len(tails)
    return chain / (n + m - chain)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, keys."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            made = [tuples(shingles(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    return docs.select("doc_id", "text", digest().alias("digest")).transform(common.small_batches).mapInArrow(run, f"doc_id {kind}, digest string, keys array<long>")


def digest():
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ...) distinct pairs of digests, texts (digest, text, keys) -> those rows of pairs that are candidates and align."""
    names = pairs.columns

    def run(batches):
        held: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(key, text):
            s = held.get(key)
            if s is None:
                s = held[key] = shingles(text)
                if len(held) > 64:
                    held.popitem(last=False)
            return s

        for b in batches:
            ok = [aligned(of(x.as_py(), s.as_py()), of(y.as_py(), t.as_py())) >= SIMILARITY - 1e-12 for x, y, s, t in zip(b.column("a"), b.column("b"), b.column("text_a"), b.column("text_b"), strict=True)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    # a row for each text of a pair, so that only the texts that a pair needs are brought together
    wanted = pairs.withColumn("digest", F.explode(F.array("a", "b")))
    of_side = lambda c, x: F.first(F.when(F.col("digest") == F.col(x), F.col(c)), ignorenulls=True).alias(f"{c}_{x}")
    met = texts.join(wanted, "digest").groupBy(*names).agg(*[of_side(c, x) for c in ("text", "keys") for x in ("a", "b")])
    met = met.filter(alike("keys_a", "keys_b")).select(*names, "text_a", "text_b")
    return met.transform(common.small_batches).mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in pairs.dtypes))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, label: the least node of its component. Labels spread to neighbours and jump to their label's label until none changes.

    Up to FEW_LINKS links are read as one partition, which is grouped and joined where it is, without an exchange.
    """
    few = links.count() <= FEW_LINKS
    read = lambda df: df.coalesce(1) if few else df
    both = common.materialize(read(links.select("a", "b").union(links.select("b", "a"))).distinct())
    held = common.materialize(read(both).groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        labels = read(held.select("node", "label"))
        near = read(both).join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = common.materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = read(spread.select(F.col("node").alias("label"), F.col("label").alias("far")))
        after = common.materialize(read(spread).join(jump, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")))
        common.release(spread)
        common.release(held)
        held = after
        if after.filter("moved").isEmpty():
            common.release(both)
            labels = after.select("node", "label")
            labels._factorloom_path = after._factorloom_path
            return labels


def forest(parents: DataFrame) -> DataFrame:
    """(node, parent), each node at most once and no cycle -> node, label: the root above each node. Every pass doubles the reach."""
    up = common.materialize(parents)
    few = up.count() <= FEW_LINKS
    read = lambda df: df.coalesce(1) if few else df
    while True:
        above = read(up).select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        after = common.materialize(read(up).join(above, "parent", "left").select("node", F.coalesce("far", "parent").alias("parent"), F.col("far").isNotNull().alias("moved")))
        common.release(up)
        path = after._factorloom_path
        up = after.select("node", "parent")
        up._factorloom_path = path
        if after.filter("moved").isEmpty():
            return up.withColumnRenamed("parent", "label")


def alike(a: str, b: str):
    """Whether two key lists agree on AGREE tuples, or on all of a shorter list."""
    return F.size(F.array_intersect(a, b)) >= F.least(F.lit(AGREE), F.size(a), F.size(b))


def place(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the label of each; a text without a link is a class of its own."""
    return common.materialize(members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "weight", "keys", F.coalesce("label", "digest").alias("label")))


def joined(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame | None, int]:
    """Aligns pairs (a, b, label_a, label_b): (label, joined) of the classes that links join, or None if there is none, and the number of pairs."""
    tried = pairs.count()
    links = common.materialize(verify(pairs, texts).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))) if tried else None
    if links is None or links.isEmpty():
        return None, tried
    out = components(links).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    common.release(links)
    return out, tried


def linked(placed: DataFrame, pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, int, int]:
    """placed with the classes joined that links between pairs join, the number of pairs, the number of classes joined."""
    changed, tried = joined(pairs, texts)
    if changed is None:
        return placed, tried, 0
    after = placed.join(changed, "label", "left").select("digest", "weight", "keys", F.coalesce("joined", "label").alias("label"))
    return common.materialize(after), tried, changed.count()


def shingled(texts: DataFrame) -> DataFrame:
    """(digest, label, text) -> digest, label, marks (shingles), outline."""

    def run(batches):
        for b in batches:
            made = [shingles(t.as_py()) for t in b.column("text")]
            marks, lines = pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64())), pa.array([outline(s) for s in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("label"), marks, lines], ["digest", "label", "marks", "outline"])

    return common.materialize(texts.select("digest", "label", "text").transform(common.small_batches).mapInArrow(run, "digest string, label string, marks array<long>, outline array<long>"))


def rarest(texts: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(digest, label, text), or held by `shingled` -> digest, label, n (shingles), key, at: the shingles of which any two of these texts that align must share one, and their places.

    With all shingles in one order, texts that share a part s of each's shingles share one of the first n - ceil(s n) + 1.
    The order is by the number of these texts that hold a shingle, so that a passage in many of them comes last;
    shingles that only texts of one label hold take their places, but are not returned.
    """
    held = shingled(texts) if held is None else held
    marks = held.select("digest", F.xxhash64("label").alias("label"), F.size("marks").alias("n"), F.explode("marks").alias("key"))
    # shingles of one label's texts only, which bring no classes together, count like those of one text: they come first, uncounted
    counts = marks.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("low"), F.max("label").alias("high"))
    counts = common.materialize(counts.filter("low != high").select("key", "held"))
    shared = marks.select("digest", "n", "key").join(counts, "key").groupBy("digest").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "key"))).alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-6)) + 1
    left = F.greatest(F.lit(0), first - (F.col("n") - F.size("shared"))).cast("int")
    shared = shared.filter(left > 0).join(held.select("digest", "label"), "digest")
    return shared.select("digest", "label", "n", (F.col("n") - F.size("shared")).alias("alone"), F.posexplode(F.slice("shared", F.lit(1), left)).alias("i", "mark")).select("digest", "label", "n", F.col("mark.key").alias("key"), (F.col("alone") + F.col("i")).alias("at"))


def by_size(marks: DataFrame) -> DataFrame:
    """Rows of `rarest` -> with large (whether the text is the larger one of a pair) and key also of the bands of both sizes.

    With the first common shingle at place `at` of n, at most n - at are common, which bounds the size of the other text.
    """
    n, step = F.col("n"), float(np.log(BAND))
    band = lambda x: F.floor(F.log(x.cast("double")) / F.lit(step)).cast("int")
    most = F.floor((n - F.col("at")) * F.lit((1 + SIMILARITY) / SIMILARITY) - n + F.lit(1e-6))
    least = F.greatest(F.lit(1), F.ceil(n * F.lit(SIMILARITY) - F.lit(1e-6)))
    over = F.least(most, F.floor(n / F.lit(SIMILARITY) + F.lit(1e-6)))
    none = F.array().cast("array<int>")
    rows = marks.withColumns({"as_small": F.when(most >= n, F.sequence(band(n), band(over))).otherwise(none), "as_large": F.when(most >= least, F.sequence(band(least), band(F.least(most, n)))).otherwise(none)})
    small = rows.withColumn("other", F.explode("as_small")).withColumn("large", F.lit(False)).withColumn("key", F.xxhash64("key", band(n), "other"))
    large = rows.withColumn("other", F.explode("as_large")).withColumn("large", F.lit(True)).withColumn("key", F.xxhash64("key", "other", band(n)))
    return small.unionByName(large).select("key", "digest", "label", "large", "n", "at")


def meeting(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, keys, label) -> key, digest, label, large, n, most, outline: any two texts of different classes that are candidates and can align have a key in common.

    Those of a bucket with few pairs have its key; those of others are dealt by their rarest shingles. most is the size up to which another text
    can align with this one. Keys under which no two classes meet are left out; texts that have the key of a bucket have no outline.
    """
    rows = placed.select("digest", "label", "keys", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    many = F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))
    mixed = common.materialize(sizes.groupBy("key").agg((many / 2).alias("pairs")).filter("pairs > 0"))
    near = rows.join(mixed.filter(F.col("pairs") <= FEW_PAIRS), "key", "left_semi")
    near = near.select("key", "digest", "label", F.explode(F.array(F.lit(False), F.lit(True))).alias("large"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    hot = rows.join(mixed.filter(F.col("pairs") > FEW_PAIRS), "key", "left_semi").select("digest", "label").distinct()
    held = shingled(texts.join(hot, "digest"))
    far = by_size(rarest(texts, held))
    rows = near.unionByName(far.select("key", "digest", "label", "large", "n", "at"))
    most = (F.col("n") - F.col("at")) * F.lit((1 + SIMILARITY) / SIMILARITY) - F.col("n") + F.lit(1e-5)
    dealt = common.materialize(rows.select("key", "digest", "label", "large", "n", most.alias("most")))
    meet = dealt.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("large").alias("all"), F.max("large").alias("some"))
    rows = dealt.join(meet.filter("low != high AND some AND NOT all"), "key", "left_semi")
    lines = held.select(F.col("digest").alias("of"), "outline")
    out = common.materialize(rows.join(lines, (F.col("digest") == F.col("of")) & (F.col("n") > 0), "left").drop("of"))
    for df in (mixed, dealt, held):
        common.release(df)
    return out


def sides(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of smaller texts with names and label ending in _a, and those of larger texts ending in _b; key stays."""
    return tuple(rows.filter(side).select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("label", *names)]) for x, side in (("a", "NOT large"), ("b", "large")))


def outlined(a: str, b: str, n_a: str, n_b: str):
    """Whether two texts of so many shingles can align by their outlines: m shingles matched of a and b leave a + b - 2m that only one has. True where one has no outline."""
    only = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return F.coalesce(only <= (F.col(n_a) + F.col(n_b)) * F.lit((1 - SIMILARITY) / (1 + SIMILARITY)) + F.lit(1e-6), F.lit(True))


def fitting(a: str, b: str):
    """Whether the texts in two columns struct(digest, n, most, outline) can align by their sizes and outlines; each pair in one order only."""
    once = (F.col(f"{a}.n") < F.col(f"{b}.n")) | ((F.col(f"{a}.n") == F.col(f"{b}.n")) & (F.col(f"{a}.digest") < F.col(f"{b}.digest")))
    return once & (F.col(f"{a}.n") <= F.col(f"{b}.most")) & (F.col(f"{b}.n") <= F.col(f"{a}.most")) & outlined(f"{a}.outline", f"{b}.outline", f"{a}.n", f"{b}.n")


def settle(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, keys, label) -> node, label, with all links between candidates of different classes; only pairs that can't align aren't aligned.

    While more than PER_TEXT pairs a text are ahead, classes that meet under a key are compared by drawn texts, in rounds. A link joins two classes,
    whose other texts then needn't meet; rounds go on while they can save and do save a good share of the pairs ahead. Then all texts of the classes that still meet are compared: each text of the class
    with fewer under the key finds those of the other that it can align with. Tables of a round are deleted with it.
    """
    base = meeting(placed, texts)
    names = placed.select(F.col("label").alias("old"), "label").distinct()  # a class's label before and after
    one = F.struct("digest", "n", "most", "outline")
    renamed = False

    def after(changed):
        return common.materialize(names.join(changed, "label", "left").select("old", F.coalesce("joined", "label").alias("label")))

    def compared(pairs):
        """Links between those of pairs (a, b structs, label_a, label_b) that are candidates, by their keys."""
        pairs = pairs.filter(fitting("a", "b")).select(F.col("a.digest").alias("a"), F.col("b.digest").alias("b"), "label_a", "label_b").distinct()
        keys_a, keys_b = (placed.select(F.col("digest").alias(x), F.col("keys").alias(f"keys_{x}")) for x in "ab")
        pairs = common.materialize(pairs.join(keys_a, "a").join(keys_b, "b").filter(alike("keys_a", "keys_b")).select("a", "b", "label_a", "label_b"))
        changed, tried = joined(pairs, texts)
        common.release(pairs)
        return changed, tried

    enough = PER_TEXT * placed.count()
    before = tried = 0
    for k in count(1):
        rows = base
        if renamed:
            rows = base.join(names.filter("old != label").withColumnRenamed("label", "new"), base.label == F.col("old"), "left").select("key", "digest", F.coalesce("new", "label").alias("label"), "large", "n", "most", "outline")
        # by pairs of classes, so that texts of one class never meet; a class stands for its smallest text and its farthest reach, a single text also for its outline
        alone = F.when(F.count(F.lit(1)) == 1, F.first("outline")).alias("outline")
        kinds = common.materialize(rows.groupBy("key", "label", "large").agg(F.min("n").alias("least"), F.max("most").alias("reach"), F.count(F.lit(1)).alias("held"), alone))
        left, right = sides(kinds, ["least", "reach", "held", "outline"])
        near = left.join(right, "key").filter(F.expr("label_a != label_b AND least_a <= reach_b AND least_b <= reach_a") & outlined("outline_a", "outline_b", "least_a", "least_b"))
        apart = common.materialize(near.drop("outline_a", "outline_b"))
        common.release(kinds)
        few = F.least("held_a", F.lit(DRAWN)) * F.least("held_b", F.lit(DRAWN))
        ahead, drawn = apart.agg(F.sum(F.col("held_a") * F.col("held_b")), F.sum(few)).first()
        if not ahead or ahead <= enough or ahead - drawn < WORTH * ahead or (k > 1 and before - ahead < max(tried, WORTH * before)):
            break
        some = F.array_distinct(F.array(*[F.min_by(one, F.xxhash64("digest", "key", F.lit(DRAWN * k + i))) for i in range(DRAWN)]))
        left, right = sides(rows.join(apart.select("key").distinct(), "key", "left_semi").groupBy("key", "label", "large").agg(some.alias("some")), ["some"])
        stood = apart.select("key", "label_a", "label_b").join(left, ["key", "label_a"]).join(right, ["key", "label_b"])
        changed, tried = compared(stood.select("label_a", "label_b", F.explode("some_a").alias("a"), "some_b").select("label_a", "label_b", "a", F.explode("some_b").alias("b")))
        common.release(apart)
        if changed is not None:
            names, renamed = after(changed), True
        before = ahead
    if ahead:
        # from the class with fewer texts under the key to the one with more, so that the first join makes the fewer rows
        pick = lambda c, x, y, out: F.when(F.col("turned"), F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(out)
        order = apart.withColumn("turned", F.col("held_a") > F.col("held_b"))
        order = order.select("key", "turned", pick("label", "a", "b", "label_x"), *[pick(c, "b", "a", f"{c}_y") for c in ("label", "least", "reach")])
        of_x, of_y = (rows.select("key", F.col("label").alias(f"label_{z}"), side.alias("turned"), one.alias(f"one_{z}")) for z, side in (("x", F.col("large")), ("y", ~F.col("large"))))
        near = order.join(of_x, ["key", "label_x", "turned"]).filter("one_x.n <= reach_y AND least_y <= one_x.most").drop("least_y", "reach_y")
        pairs = near.join(of_y, ["key", "label_y", "turned"]).filter((F.col("turned") & fitting("one_y", "one_x")) | (~F.col("turned") & fitting("one_x", "one_y")))
        changed, _ = compared(pairs.select(*[pick(c, x, y, out) for c, a, b in (("label", "label_a", "label_b"), ("one", "a", "b")) for x, y, out in (("x", "y", a), ("y", "x", b))]))
        if changed is not None:
            names, renamed = after(changed), True
    common.release(apart)
    common.release(base)
    if not renamed:
        return placed.select(F.col("digest").alias("node"), "label")
    return common.materialize(placed.select("digest", "label").join(names.withColumnRenamed("label", "new"), F.col("label") == F.col("old")).select(F.col("digest").alias("node"), F.col("new").alias("label")))


def labelled(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """node, label for every text (digest) that has a near copy; texts of one class have one label."""
    nodes = sketched.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    buckets = nodes.select("digest", "doc_id", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a member of buckets; of a family of copies, the text nearest to all others is in the largest ones
    shared = buckets.join(sizes, "key").groupBy("digest").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("weight"), F.collect_set("key").alias("keys"))
    members = common.materialize(shared)
    wanted = members.select(F.col("digest").alias("wanted"), "doc_id", "keys")
    held = docs.select("doc_id", "text", digest().alias("digest"))
    texts = common.materialize(held.join(wanted, held.doc_id.eqNullSafe(wanted.doc_id) & (F.col("digest") == F.col("wanted"))).select("digest", "text", "keys").dropDuplicates(["digest"]))
    # every text with the most typical that it shares a bucket with, as far as that is more typical than itself
    rows = members.select("digest", "weight", "keys", F.explode("keys").alias("key"))
    # written out, as below, so that joins read both sides from exchanges and a hot key can be split
    centres = common.materialize(rows.groupBy("key").agg(F.max(F.struct("weight", "digest", "keys")).alias("centre")))
    best = rows.join(centres, "key").filter("digest != centre.digest").groupBy("digest").agg(F.first("keys").alias("keys"), F.max("centre").alias("centre"))
    pairs = best.filter(alike("keys", "centre.keys")).select(F.col("digest").alias("a"), F.col("centre.digest").alias("b"))
    labels = forest(verify(pairs, texts).select(F.col("a").alias("node"), F.col("b").alias("parent")))
    placed = place(members, labels)
    for k in count(1):
        rows = placed.select("digest", "label", "keys", F.explode("keys").alias("key"), "weight")
        # a bucket with several classes: every text is compared with drawn texts of classes not its own
        one = F.struct("digest", "label", "keys")
        some = F.array(F.max_by(one, F.struct("weight", "digest")), F.min_by(one, F.xxhash64("digest", "key", F.lit(k))))
        drawn = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), some.alias("some"))
        drawn = common.materialize(drawn.filter("low != high").select("key", F.explode(F.array_distinct("some")).alias("centre")))
        pairs = rows.join(drawn, "key").filter((F.col("label") != F.col("centre.label")) & alike("keys", "centre.keys"))
        pairs = pairs.select(F.col("digest").alias("a"), F.col("centre.digest").alias("b"), F.col("label").alias("label_a"), F.col("centre.label").alias("label_b")).distinct()
        pairs = common.materialize(pairs)
        placed, tried, found = linked(placed, pairs, texts)
        common.release(drawn)
        common.release(pairs)
        if found * PAYS <= tried:
            break
    return settle(placed, texts)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, class_id (least doc_id of the class), class_size, keep (true for one document of each class)."""
    sketched = common.materialize(sketch(docs))
    labels = labelled(docs, sketched)
    rows = sketched.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    placed = common.materialize(rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("doc_id", "digest", "copies", F.coalesce("label", "digest").alias("label")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    groups = common.materialize(placed.groupBy("label").agg(first.alias("first"), F.sum("copies").alias("class_size")))
    out = placed.join(groups, "label")
    keep = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    out = out.select("doc_id", "digest", F.col("first.doc_id").alias("class_id"), "class_size", keep.alias("keep"), "copies")
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> a row for each document: doc_id, class_id, class_size."""
    out = classes(docs)
    return out.select("doc_id", "class_id", "class_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one with the least doc_id; columns as in docs."""
    kept = classes(docs).filter("keep").select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest"))
    rows = docs.withColumn("__digest", digest())
    out = rows.join(kept, rows.doc_id.eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest")), "left_semi")
    return out.dropDuplicates(["doc_id", "__digest"]).select(docs.columns)
