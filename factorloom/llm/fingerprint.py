"""Document fingerprints: a Merkle tree over paragraphs and sections, with leaves below.

Paragraphs are lines. A section ends after a paragraph whose hash is 0 modulo SECTION, and leaves (about a word each) end after
white space, marks and a few other characters, so that an insertion moves no other end. A section's digest is of its
paragraphs' digests, the root's of the sections'. Equal roots mean equal texts; where roots differ, only
sections whose digests differ are looked into, and their differing paragraphs locate the edits.

The fingerprint string is the root and a piece for each section, `root;digest:leaves:hashes;...`: the section's digest, its number of
distinct leaf hashes, and the SKETCH least of them, 8 hexadecimal digits each. A leaf's hash is of it and the leaf after
it. Likeness of two fingerprints is the Dice share of leaf hashes: sections that both have count in full, and only the others' hashes are
compared, exactly if no section among them has more than SKETCH, else by those under the least bound up to which all of these sections
are complete (standard error about 0.06 for one section a side, less for more).

Defined results: a null text is empty; the empty text has one empty paragraph and no leaf, and is like nothing but itself; a section that a text
repeats counts once; rows of equal doc_id are ordered by a hash of the text, and rows equal in both count as one document when neighbours are
sought but are all returned; a null doc_id (for which the least long stands) sorts first; a single document is its own next; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import let

#: Characters after which a leaf ends; a run without any is cut every 16.
ENDS = r"\s\p{Z}\p{P}\p{S}07jqx"
LEAF = rf"[^{ENDS}]{{1,16}}[{ENDS}]*|[{ENDS}]+"
#: Paragraphs in a section, on average.
SECTION = 8
SKETCH = 64


def sections_of(text: Column) -> Column:
    """Arrays of paragraphs: the sections of a text, in order."""

    def cut(p: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == F.size(p) - 1) | (F.pmod(F.xxhash64(F.get(p, i)), F.lit(SECTION)) == 0))
        return let(ends, lambda e: F.transform(e, lambda x, k: let(F.when(k > 0, F.get(e, k - 1) + 1).otherwise(0), lambda first: F.slice(p, first + 1, x - first + 1))))

    return let(F.split(text, "\n", -1), cut)


def section_digest(paragraphs: Column) -> Column:
    return F.md5(F.concat_ws(",", F.transform(paragraphs, lambda p: F.md5(p))))


def leaf_hashes(paragraphs: Column) -> Column:
    """Distinct 32-bit hashes of a section's leaves as 8 hexadecimal digits each, ascending."""
    leaves = F.regexp_extract_all(F.concat_ws("\n", paragraphs), F.lit(LEAF), F.lit(0))
    hashes = let(leaves, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.sort_array(F.array_distinct(hashes))


def piece(paragraphs: Column) -> Column:
    """A section's part of the fingerprint."""
    digits = lambda h: F.concat_ws("", F.transform(F.slice(h, 1, SKETCH), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))
    return let(leaf_hashes(paragraphs), lambda h: F.concat_ws(":", F.substring(section_digest(paragraphs), 1, 16), F.size(h).cast("string"), digits(h)))


def parts(text: Column) -> Column:
    """struct(root, pieces): what the fingerprint string is made of."""
    return let(sections_of(text), lambda s: F.struct(F.md5(F.concat_ws(",", F.transform(s, section_digest))).alias("root"), F.transform(s, piece).alias("pieces")))


def written(p: Column) -> Column:
    return F.concat_ws(";", p["root"], p["pieces"])


def read(written_form: Column) -> Column:
    """The `parts` of a fingerprint string."""
    return let(F.split(written_form, ";"), lambda s: F.struct(F.get(s, 0).alias("root"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("pieces")))


def fingerprint(text: Column) -> Column:
    return written(parts(F.coalesce(text, F.lit(""))))


def _count(p: Column) -> Column:
    return F.split_part(p, F.lit(":"), F.lit(2)).cast("long")


def _total(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + _count(p))


def _hashes(pieces: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(F.split_part(p, F.lit(":"), F.lit(3)), F.lit("[0-9a-f]{8}"), F.lit(0)))))


def _complete_to(pieces: Column) -> Column:
    """The hash up to which all these sections are complete; null if they are throughout."""
    return F.array_min(F.transform(F.filter(pieces, lambda p: _count(p) > SKETCH), lambda p: F.right(p, F.lit(8))))


def _dice(a: Column, b: Column) -> Column:
    """Dice share of the leaf hashes of two lists of differing sections, or 0 if neither has any."""
    bound = F.coalesce(F.least(_complete_to(a), _complete_to(b)), F.lit("g"))
    within = lambda pieces, most: F.filter(_hashes(pieces), lambda h: h <= most)
    both = let(bound, lambda most: F.struct(within(a, most).alias("a"), within(b, most).alias("b")))
    return let(both, lambda x: F.coalesce(F.lit(2.0) * F.size(F.array_intersect(x["a"], x["b"])) / F.nullif(F.size(x["a"]) + F.size(x["b"]), F.lit(0)), F.lit(0.0)))


def likeness_of(a: Column, b: Column) -> Column:
    """Dice share of the leaf hashes of two `parts`."""

    def descend(d: Column) -> Column:
        same = 2 * d["same"]
        rest = _total(d["a"]) + _total(d["b"])
        return F.coalesce((same + _dice(d["a"], d["b"]) * rest) / F.nullif(same + rest, F.lit(0)), F.lit(0.0))

    differing = F.struct(
        _total(F.array_intersect(a["pieces"], b["pieces"])).alias("same"), F.array_except(a["pieces"], b["pieces"]).alias("a"), F.array_except(b["pieces"], a["pieces"]).alias("b")
    )
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(let(differing, descend))


def likeness(a: Column, b: Column) -> Column:
    """Likeness, 0 to 1, of two fingerprint strings."""
    return let(read(a), lambda x: let(read(b), lambda y: likeness_of(x, y)))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of fingerprint string a that b hasn't: where a was edited."""
    pieces = let(F.struct(read(a)["pieces"].alias("a"), read(b)["pieces"].alias("b")), lambda x: let(F.array_except(x["a"], x["b"]), lambda new: F.transform(x["a"], lambda p, i: F.when(F.array_contains(new, p), i))))
    return F.array_compact(pieces)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs of text a that b's differing sections haven't; equal sections aren't looked into."""

    def numbered(s: Column) -> Column:
        sizes = F.transform(s, lambda x: F.size(x))
        first = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda n, x: n + x)
        return F.transform(s, lambda x, i: F.struct(section_digest(x).alias("digest"), first(i).alias("first"), F.transform(x, lambda p: F.md5(p)).alias("paragraphs")))

    def where(x: Column, y: Column) -> Column:
        digests = lambda s: F.transform(s, lambda z: z["digest"])
        inside = F.filter(x, lambda s: ~F.array_contains(digests(y), s["digest"]))
        other = F.flatten(F.transform(F.filter(y, lambda s: ~F.array_contains(digests(x), s["digest"])), lambda s: s["paragraphs"]))
        return F.array_compact(F.flatten(F.transform(inside, lambda s: F.transform(s["paragraphs"], lambda p, i: F.when(~F.array_contains(other, p), s["first"] + i)))))

    return let(numbered(sections_of(a)), lambda x: let(numbered(sections_of(b)), lambda y: where(x, y)))


def followers(docs: DataFrame) -> DataFrame:
    """(k, h, n) distinct -> each with the next (nk, nh) in ascending order of k, h; the first follows the last.

    A range sort deals the rows to partitions; within each the next row follows, and a table of one row a
    partition joins their ends.
    """
    spark = docs.sparkSession
    ranged = common.materialize(docs.repartitionByRange(common.partitions(spark), "k", "h").withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy("k", "h")
    rows = ranged.withColumn("next", F.lead(F.struct("k", "h")).over(inside))
    ends = ranged.groupBy("part").agg(F.min(F.struct("k", "h")).alias("first"))
    # one row a partition
    chain = W.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("first").over(chain), F.first("first").over(chain)).alias("after"))
    out = rows.join(F.broadcast(ends), "part").select("k", "h", "n", F.coalesce("next", "after").alias("next"))
    return out.select("k", "h", "n", F.col("next.k").alias("nk"), F.col("next.h").alias("nh"))


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = dict(docs.dtypes)["doc_id"]
    none = F.lit(-(1 << 63))  # stands for a null doc_id
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("k"), text.alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    order = base.select("k", "h", F.length("text").alias("n")).distinct()
    nexts = common.materialize(followers(order))
    # both joins below read the same columns of this exchange, so that texts are shuffled once, and without what is made of them
    own = base.repartition(common.partitions(docs.sparkSession), "k", "h")
    wanted = nexts.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.struct(F.col("k"), F.col("h")).alias("before"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    given = own.join(wanted, ["k", "h"]).select(F.col("before.k").alias("k"), F.col("before.h").alias("h"), F.struct(F.expr("substring(text, 1, need)").alias("head"), parts(F.col("text")).alias("p")).alias("given"))
    given = given.groupBy("k", "h").agg(F.first("given").alias("given"))
    both = own.join(given, ["k", "h"]).withColumn("n", F.length("text")).withColumn("p", parts(F.col("text")))
    edited = F.concat(F.expr("substring(text, 1, n - cast(floor(n / 4) AS int))"), F.col("given.head"))
    both = both.select(F.when(F.col("k") != none, F.col("k")).cast(kind).alias("doc_id"), "n", "p", F.col("given.p").alias("q"), F.transform(F.array(edited), lambda e: F.struct(F.sha2(e, 256).alias("sha"), parts(e).alias("parts")))[0].alias("e"))
    return both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.col("e.sha").alias("edited_sha256"),
        written(F.col("p")).alias("fingerprint"),
        written(F.col("e.parts")).alias("edited_fingerprint"),
        likeness_of(F.col("p"), F.col("e.parts")).alias("near_edited"),
        likeness_of(F.col("p"), F.col("q")).alias("near_next"),
    )
