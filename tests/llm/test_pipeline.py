"""The pipeline's stages, each against what it was given."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from factorloom.llm import common, mixing, near_dup, packing, quality_model  # noqa: E402

from .test_operators import brute_spans  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_spans", "source_mix", "pack"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, before, data))
        ids = {r.doc_id for r in before.select("doc_id").distinct().collect()}
        assert {r.doc_id for r in after.select("doc_id").distinct().collect()} <= ids
        if name != "pack":
            assert after.columns == docs.columns and after.schema == docs.schema
        if name == "quality":
            good = common.table(spark, data, "labels").filter("quality = 1").join(docs, "doc_id")
            assert good.join(after, "doc_id", "left_anti").count() <= 0.1 * good.count()
        if name == "near_duplicates":
            assert after.select("text").distinct().count() == after.count()
        if name == "pack":
            sizes = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
            assert all(r[1] <= 2048 for r in sizes)
        before = after


def keyed(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def given(docs):
    """The fixture with columns that are called as the stages' own."""
    return docs.withColumns({c: F.lit(c) for c in ("score", "predicted", "held_out", "keep", "digest", "class_id", "position", "bin", "copies", "key", "ids", "sentences", "removed_sentences")})


def test_quality_keeps_what_the_classifier_accepts(spark, given, data):
    out = STAGES["quality"](spark, given, data)
    assert out.columns == corpus_pipeline.COLUMNS
    scored = quality_model.classify(given.select("doc_id", "text"), common.table(spark, data, "labels"))
    assert keyed(out) == Counter((r.doc_id, r.text) for r in scored.collect() if r.score >= 0.7)


def test_near_duplicates_keep_the_least_of_every_class(spark, given, data):
    got = keyed(STAGES["near_duplicates"](spark, given, data))
    rows = sorted({(r.doc_id, r.text) for r in given.collect()}, key=lambda r: (r[0] is None, r[0] or 0, near_dup.shingles(r[1]).sum() if r[1] else 0))
    s = [near_dup.shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dup.aligned(s[i], s[j]) >= near_dup.SIMILARITY:
                group[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[root(i)].append(r)
    assert len(got) == len(members) and all(n == 1 for n in got.values())
    for v in members.values():
        least = min((d for d, _ in v if d is not None), default=None)
        assert len([r for r in got if r in v]) == 1 and next(r for r in got if r in v)[0] == least


def test_spans_go_as_brute_force_says(spark, given, rows, data):
    got = STAGES["repeated_spans"](spark, given.filter("doc_id IS NULL OR doc_id != 5"), data).collect()
    unique = [r for r in rows if r[0] != 5]
    want = brute_spans(unique)
    left = Counter()
    for d, t, *_ in unique:
        after = want[(d, t)] if t else t
        if after == t or any(c.isalnum() for c in after or ""):
            left[(d, after)] += 1
    assert Counter((r.doc_id, r.text) for r in got) == left
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_mix_repeats_in_training_order(spark, given, data):
    got = [(r.doc_id, r.text) for r in STAGES["source_mix"](spark, given, data).collect()]
    plan = {r.doc_id: r for r in mixing.mix(given).collect()}
    want = Counter()
    for r in given.select("doc_id", "text").collect():
        p = plan[r.doc_id]
        if r.text and r.text.split() and p.copies:
            want[(r.doc_id, r.text)] += p.copies
    assert Counter(got) == want


def test_pack_is_a_round_trip(spark, given, data):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = STAGES["pack"](spark, given.filter("doc_id IS NOT NULL AND doc_id NOT IN (3, 5)"), data).collect()
    texts = {r.doc_id: r.text or "" for r in given.collect()}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, pieces in by.items():
        ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) == pieces[0].doc_tokens


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, no_docs, data, name):
    out = STAGES[name](spark, no_docs, data)
    assert out.isEmpty() and (name == "pack" or out.columns == corpus_pipeline.COLUMNS)
