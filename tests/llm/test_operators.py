"""Operators against brute force, and their edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import common, fingerprint, html_text, lang_id, mixing, near_dup, packing, quality_model, quality_rules, span_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(rows):
    return [(d, t or "") for d, t, *_ in rows]


# 1


def test_language(spark, docs, no_docs):
    got = lang_id.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[60].lang_pred == by[61].lang_pred == by[62].lang_pred == by[63].lang_pred == "und" and by[63].score == 0
    assert {r.lang_pred for r in got} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in got)
    assert by[None].held_out and by[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    assert lang_id.identify(no_docs).count() == 0


def test_language_accuracy(spark, data):
    docs = common.table(spark, data, "documents")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_ties_repeats_and_signs(spark):
    train = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"))]
    odd = [(100, "😀😀", None), (101, "𝟏𝟐𝟑", None), (102, "12 !!", "en"), (103, "the the the", None), (103, "the the the", None), (None, "und der", "de"), (104, "der " * 300000, None)]
    got = lang_id.identify(spark.createDataFrame([(d, t, lang) for d, t, lang in train + odd], "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 100}
    assert len(got) == len(train) + len(odd)
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[103].lang_pred == "en" and by[104].lang_pred == "de"
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 103}) == 1


def test_every_language_is_learnt(spark):
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(3 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 20, n) for i, n in enumerate(names) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang_pred for r in lang_id.identify(docs).collect()}
    learnt = {n for i, n in enumerate(names) for j in range(3) if zlib.crc32(str(3 * i + j).encode()) % 5}
    assert got == learnt


def test_kernel_is_shared_ngrams():
    a, b = (set(lang_id.presence(t).tolist()) for t in ("Hello, world", "HELLO world!"))
    assert a == b
    assert lang_id.presence("12 !!") is None


# 2


def brute_spans(rows):
    seen, out = set(), {}
    key = lambda r: (r[0] is None, r[0] if r[0] is not None else 0)
    for d, t in sorted({(d, t) for d, t in texts_of(rows)}, key=key):
        if not t:
            continue
        starts, _, _ = span_dedup.sentences(t)
        edges = [*starts.tolist(), len(t)]
        parts = [t[edges[i] : edges[i + 1]] for i in range(len(starts))]
        words = [tuple(re.findall(r"[^\W_]+", p.lower())) for p in parts]
        gone = [False] * len(parts)
        for i in range(len(parts)):
            j = n = 0
            while i + j < len(parts) and (j < span_dedup.SENTENCES or n < span_dedup.MIN_WORDS):
                n += len(words[i + j])
                j += 1
            if j >= span_dedup.SENTENCES and n >= span_dedup.MIN_WORDS:
                g = tuple(words[i : i + j])
                if g in seen:
                    gone[i : i + j] = [True] * j
                seen.add(g)
        out[(d, t)] = "".join(p for p, x in zip(parts, gone, strict=True) if not x)
    return out


def test_spans(spark, docs, rows, no_docs):
    unique = [r for r in rows if r[0] != 5]
    df = docs.filter("doc_id IS NULL OR doc_id != 5")
    got = span_dedup.remove_repeats(df.withColumn("original", F.col("text"))).collect()
    assert len(got) == len(unique)
    want = brute_spans(unique)
    for r in got:
        assert r.text == (want[(r.doc_id, r.original)] if r.original else r.original)
    assert sum(r.removed_sentences for r in got) > 50
    assert span_dedup.remove_repeats(no_docs).count() == 0


def test_sentences_cover_text():
    t = 'Say "no". Why? 3.5 is fine!\nNext ' + " ".join(f"w{i}" for i in range(60))
    starts, size, _ = span_dedup.sentences(t)
    assert starts[0] == 0 and (np.diff(starts) > 0).all() and size.max() <= span_dedup.MOST


# 3


def test_fingerprints(spark, docs, rows, no_docs):
    df = docs.filter("doc_id IS NOT NULL AND doc_id NOT IN (3, 5)")
    got = fingerprint.compare(df).collect()
    text = {d: t for d, t in texts_of(rows) if d is not None and d not in (3, 5)}
    ids = sorted(text)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert len(got) == len(ids)
    for r in got:
        t = text[r.doc_id]
        m = len(t) // 4
        edited = t[: len(t) - m] + text[after[r.doc_id]][:m]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {}
    for r in got:
        assert by.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by.values())) == len(by)
    long = [r.near_edited for r in got if r.n_chars > 400]
    assert 0.5 < np.mean(long) < 0.9
    assert fingerprint.compare(no_docs).count() == 0
    assert fingerprint.compare(docs).count() == len(rows)
    alone = fingerprint.compare(df.filter("doc_id = 7")).first()
    assert alone.near_next == 1


def near(spark, a, b):
    both = fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fingerprint.likeness(*both).alias("near"), fingerprint.differing_sections(*both).alias("sections"), fingerprint.differing_paragraphs(F.col("a"), F.col("b")).alias("paragraphs")
    )
    return row.first()


def test_likeness_and_edits(spark):
    a = "\n".join(f"paragraph number {i} says {i * 7919 % 97}" for i in range(30))
    b = a.replace("number 11 says", "number eleven said")
    assert near(spark, a, a) == (1.0, [], [])
    row = near(spark, a, b)
    assert 0.8 < row.near < 1 and len(row.sections) == 1 and row.paragraphs == [11]
    row = near(spark, a, "a new line\n" + a)
    assert row.near > 0.9 and len(row.sections) <= 1 and row.paragraphs == []


def test_likeness_is_continuous(spark):
    words = [f"{chr(97 + i % 26)}{i * 37 % 101}word" for i in range(400)]
    for n in (6, 9, 10, 60, 400):
        text = " ".join(words[:n])
        whole = near(spark, text, " ".join(words[: n * 3 // 4])).near
        assert 0.6 < whole < 1
        assert near(spark, text, "X" + text).near > 0.6
    assert near(spark, "", "").near == 1 and near(spark, "", "x").near == 0


def brute_likeness(a, b):
    """Dice share of all leaf hashes, section by section, without a sketch."""

    def hashes(text):
        lines, sections, held = text.split("\n"), [], []
        for i, line in enumerate(lines):
            held.append(line)
            if i == len(lines) - 1 or ENDS_SECTION[line]:
                sections.append("\n".join(held))
                held = []
        import regex

        return {s: frozenset(zip(w, [*w[1:], None], strict=True)) for s in sections for w in [regex.findall(r"[^\s\p{Z}\p{P}\p{S}07jqx]{1,16}[\s\p{Z}\p{P}\p{S}07jqx]*|[\s\p{Z}\p{P}\p{S}07jqx]+", s)]}

    x, y = hashes(a), hashes(b)
    same = sum(len(x[s]) for s in x.keys() & y.keys())
    p, q = (frozenset().union(*[u[s] for s in u.keys() - v.keys()]) for u, v in ((x, y), (y, x)))
    rest = sum(len(u[s]) for u, v in ((x, y), (y, x)) for s in u.keys() - v.keys())
    dice = 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0
    return (2 * same + dice * rest) / (2 * same + rest) if same or rest else 0.0


ENDS_SECTION: dict[str, bool] = {}


def test_likeness_equals_brute_force_without_sketch(spark, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "SKETCH", 1 << 20)
    texts = sorted({t or "" for _, t, *_ in rows if len(t or "") < 20000})
    pairs = [(t, t[: len(t) * 3 // 4] + u[: len(t) // 4]) for t, u in zip(texts, texts[1:], strict=False)]
    lines = sorted({line for p in pairs for t in p for line in t.split("\n")})
    ENDS_SECTION.update((r.line, r.ends) for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", (F.pmod(F.xxhash64("line"), F.lit(fingerprint.SECTION)) == 0).alias("ends")).collect())
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("near")).collect():
        assert r.near == pytest.approx(1.0 if r.a == r.b else brute_likeness(r.a, r.b), abs=1e-9)


# 4


def brute_bytes(rows, length):
    docs = [t.encode() for _, t in texts_of(rows)]
    n = Counter(b[i : i + length] for b in docs for i in range(len(b) - length + 1))
    out = Counter()
    for (d, _), b in zip(texts_of(rows), docs, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [400, 120])
def test_suffixes(spark, docs, rows, no_docs, length):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_bytes(rows, length)
    assert suffix_dedup.remove_repeats(no_docs, length).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffixes_of_few_letters(spark, hot):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) * rng.randint(1, 2)) for i in range(60)]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, hot))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_bytes(rows, 40)


def test_suffixes_of_a_hot_anchor(spark):
    """A passage in every text, with ends that a few share: split by classes of windows, and as one group."""
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(70))
    ends = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(12)]
    rows = [(i, "".join(rng.choice("abc") for _ in range(20)) + rng.choice(ends)[rng.randint(0, 40) :] + passage + rng.choice(ends)[: rng.randint(5, 60)] + rng.choice("xyz") * 9) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_bytes(rows, 100)
    for hot in (suffix_dedup.HOT, 20, 1):
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, 100, hot))
        assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want


# 5


def test_quality_rules(spark, docs, rows, no_docs):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in texts_of(rows):
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.judge(no_docs).count() == 0


def test_order_of_rules_never_changes_the_verdict(spark, docs):
    rules = quality_rules.default_rules()
    a = quality_rules.judge(docs, rules).select("doc_id", "kept")
    b = quality_rules.judge(docs, rules[::-1]).select("doc_id", "kept")
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


# 6


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, left = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(full.values())
        level = rest / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > most * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in left}
        for s in over:
            full[s] = most * sizes[s]
            left.discard(s)


def test_mix(spark, docs, rows, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and any(sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6 * max(1, r.target) for s in sizes)
    assert mixing.mix(docs).select("doc_id", "taken").exceptAll(mixing.mix(docs).select("doc_id", "taken")).isEmpty()
    again = mixing.apply_mix(docs.drop("extra"))
    assert again.columns == docs.drop("extra").columns and again.count() == sum(r.copies for r in got if r.taken)
    assert mixing.mix(no_docs).count() == 0


def test_positions_follow_each_document(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 3 else None) for i in range(4000)] + [(9999, "w " * 50000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = [r for r in got if r.taken]
    assert len(got) == 4001 and len({r.position for r in taken}) > 0.99 * len(taken)
    assert all(0 <= r.position <= 1 for r in taken) and all(r.position is None for r in got if not r.taken)
    big = next(r for r in got if r.doc_id == 9999)
    assert big.taken in (0, 50000, 100000, 150000)


def test_due_inverts_demand(spark):
    df = spark.createDataFrame([(s, a) for s in (0.0, 0.2, 0.7, 1.0) for a in (-1.0, -0.5, 0.0, 0.5, 1.0)], "share double, slope double")
    for r in df.select("share", "slope", mixing.due(F.col("share"), F.col("slope")).alias("t")).collect():
        assert (1 - r.slope) * r.t + r.slope * r.t**2 == pytest.approx(r.share, abs=1e-9)


# 7


def test_html(spark):
    page = """<html><head><title>T</title><script>if (a<b) x("</p>")</script><style>p{}</style></head><body>
    <header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, friends.</div>
    <article><h1>A title</h1><p>First  paragraph &amp; more,<br>same block.<p>Second &eacute; one, <b>bold
    text</b> here.</p><ul><li>item one</li><li>item two</li></ul></article>
    <aside>Related, things.</aside><div id="comments"><p>Nice article, thanks! I agree with all of it, really.</p></div><form><input><button>Go</button></form><footer>&copy; all</footer></body></html>"""
    assert html_text.main_text(page) == "A title\n\nFirst paragraph & more, same block.\n\nSecond é one, bold text here.\n\nitem one\n\nitem two"
    plain = "<body><div class='menu'><a>x</a></div><div id=main><h2>Head</h2><p>Some words, and more. Yes.</p><p>Other words, too.</p></div></body>"
    assert html_text.main_text(plain) == "Head\n\nSome words, and more. Yes.\n\nOther words, too."
    remarks = "<main class='page-sidebar-left'><article class='post'><p>The text, at length. It goes on.</p></article><section><article class='comment'><p>A remark, at length. It also goes on and on.</p></article></section></main>"
    assert html_text.main_text(remarks) == "The text, at length. It goes on."
    for odd in (None, "", "<", "<a href='x", "</p></p>", "<script>never ends", "<!-- open", "&#xZZ; &bogus;", "<p>" * 3000 + "deep"):
        html_text.main_text(odd)
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert len(got) == 3 and {r.text for r in got if r.page_id == 2} == {""} and all(r.n_chars == len(r.text) for r in got)


def test_html_of_any_depth():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div>" * 50000 + "deep, and so on.") == "deep, and so on."
    for odd in ("<div>x" * 50000, "<b>x" * 50000, "<span>" * 50000 + "<p>x" * 50000, "<span>" * 50000 + "</i>x" * 50000, "<ul><li>" * 50000 + "x"):
        html_text.main_text(odd)
    assert time.perf_counter() - began < 60


def test_html_article_parts_with_telling_names(spark):
    parts = [f"Text number {i}, with marks. And so on, at length." for i in range(3)]
    page = f"<body><nav>menu</nav><article><h1>Head</h1><div class='social-history'><p>{parts[0]}</p></div><section id='related-work'><p>{parts[1]}</p></section><div class='promo-video-text'><p>{parts[2]}</p></div></article></body>"
    assert html_text.main_text(page) == "\n\n".join(["Head", *parts])
    rows = [(1, "u", page, "t", 5), (None, None, page, None, None), (2, "u", None, "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == got[None].text == "\n\n".join(["Head", *parts]) and got[2].text == "" and got[2].n_chars == 0
    assert html_text.extract(df.filter("page_id > 9")).count() == 0


def test_html_pages_of_the_tables(spark, data):
    """Articles of the test pages stand in article or main elements or in a class of content; every paragraph in an article element is kept."""
    pages = common.table(spark, data, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.findall(r"<article[^>]*>(.*?)</article>", r.html, re.S)
        if len(inner) == 1 and not re.search(r"<(aside|nav|form|header|footer|div|section)", inner[0]):
            for p in re.findall(r"<p>([^<&]+)</p>", inner[0]):
                assert " ".join(p.split()) in got[r.page_id]


def test_html_names_and_headings():
    body = "<article><h1>Head</h1><p>The text, at length. It goes on.</p></article>"
    for wrap in ("<div class='content has-sidebar'>%s</div>", "<div id='main' class='page-sidebar-left'>%s</div>", "<div class='sidebar'>%s</div>"):
        assert html_text.main_text("<body>" + wrap % body + "<div class='site-footer'>All rights, all of them.</div></body>") == "Head\n\nThe text, at length. It goes on."
    assert html_text.main_text("<body><div class='widget'><p>All the text, at length. It goes on.</p></div></body>") == "All the text, at length. It goes on."
    teaser = "<div class='sidebar widget'><article><p>Short, so.</p></article></div>"
    assert html_text.main_text("<body>" + body + teaser + "</body>") == "Head\n\nThe text, at length. It goes on."
    text = "A long sentence, with commas, and so on. Another one, at length. " * 20
    page = f"<body><div class='nav'><a>x</a></div><div><h1>Head</h1><p>A lead</p><div class=body><p>{text}</p><p>{text}</p></div></div><div><a>more</a></div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Head", "A lead", text.strip(), text.strip()])
    short = text[:300].strip()
    uneven = "<body><div><section>" + f"<p>{short}</p>" * 15 + f"</section><div><ul><li>{short}</li></ul></div></div></body>"
    assert html_text.main_text(uneven) == "\n\n".join([short] * 16)
    teaser = "<div class='ad'>" + text + "</div>"
    assert html_text.main_text("<body>" + teaser + body + "</body>") == "Head\n\nThe text, at length. It goes on."


# 8


def test_quality_model(spark, data):
    docs, labels = common.table(spark, data, "documents").select("doc_id", "text"), common.table(spark, data, "labels")
    got = quality_model.classify(docs, labels).join(labels, "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9


def test_tokens_of_long_runs_differ():
    a, b = "a" * 9000, "a" * 8999 + "b"
    c, d = "x" * 4096 + "y" * 4096, "y" * 4096 + "x" * 4096
    assert len({tuple(quality_model.tokens(t).tolist()) for t in (a, b, c, d)}) == 4


def test_neighbour_sums_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 3, 700)]
    table, want = quality_model.index_table(), np.zeros((quality_model.TABLE, quality_model.DIM))
    for t in texts:
        for i in range(len(t)):
            for j in range(max(0, i - quality_model.WINDOW), min(len(t), i + quality_model.WINDOW + 1)):
                if i != j:
                    want[t[i]] += table[t[j]]
    assert np.array_equal(quality_model.neighbour_sums(texts, 64), want)


def test_quality_model_edges(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1), (70, None)], "doc_id long, quality int")
    got = quality_model.classify(docs.select("doc_id", "text"), labels, epochs=20).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    one = quality_model.classify(docs.select("doc_id", "text"), labels.filter("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert quality_model.classify(no_docs.select("doc_id", "text"), labels).count() == 0


# 9


def test_packing(spark, docs, rows, no_docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    special = [(900, "a <|endoftext|> b", "en", "s", 17)]
    df = docs.drop("extra").unionByName(spark.createDataFrame(special, docs.drop("extra").schema))
    got = packing.pack(df, length=256).toPandas()
    want = Counter()
    for d, t in texts_of(rows + special):
        want[(d, tuple(tok.encode(t, add_special_tokens=False).ids + [1]))] += 1
    sizes = Counter()
    for (d, ids), n in want.items():
        sizes[(d, len(ids))] += n
    assert got.length.sum() == sum(len(ids) * n for (_, ids), n in want.items())
    seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in seq:
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 256
    single = {d: ids for (d, ids) in want if d is not None and d not in (3, 5)}
    for r in got[got.doc_id.isin(list(single))].itertuples():
        ids = np.array(single[int(r.doc_id)], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("parts", [1, 200])
def test_packing_pads_one_sequence_only(spark, data, parts):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = packing.pack(common.table(spark, data, "documents")).select("sequence_id", "offset", "length").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    got = got.sort_values(["sequence_id", "offset"])
    full = got.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == packing.LENGTH).all() and list(full.index) == list(range(len(full)))
    assert (got.offset.to_numpy() == (got.groupby("sequence_id").length.cumsum() - got.length).to_numpy()).all()


def test_packing_follows_the_curve(spark, docs):
    """Sequences hold documents in the order of their curve keys, ties by number."""
    path = packing.default_tokenizer()
    keys = {(r.doc_id, r.size): r.key for r in packing.tokenize(docs, path).collect()}
    got = packing.pack(docs, length=256).filter("start = 0").orderBy("sequence_id", "offset").collect()
    order = [keys[(r.doc_id, r.doc_tokens)] for r in got]
    assert len(order) == docs.count() and order == sorted(order)


def test_curve_takes_unit_steps():
    import itertools

    cells = np.array(list(itertools.product(range(8), repeat=3)))
    path = cells[np.argsort(packing.hilbert(cells, 3))]
    assert set(np.abs(np.diff(path, axis=0)).sum(axis=1)) == {1}


# 10


def test_near_duplicates(spark, docs, rows, no_docs):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    items = list({(d, t) for d, t in texts_of(rows)})
    sh = [set(near_dup.shingles(t).tolist()) for _, t in items]
    group = list(range(len(items)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            a, b = sh[i], sh[j]
            if items[i][1] == items[j][1] or (a and b and len(a & b) / len(a | b) >= 0.8):
                group[root(i)] = root(j)
    want = defaultdict(set)
    for i, (d, _) in enumerate(items):
        want[root(i)].add(d)
    classes = Counter(frozenset(v) for v in want.values())
    found = defaultdict(set)
    for r in near_dup.classes(docs).collect():
        found[(r.class_id, r.class_size)].add(r.doc_id)
    # one number has two texts and one document has none, so that their classes can't be told by number
    told = lambda v: frozenset(d for d in v if d not in (5, None))
    assert Counter(told(v) for v in found.values()) - Counter([frozenset()] * 9) == Counter(told(v) for v in classes.elements()) - Counter([frozenset()] * 9)
    by = {r.doc_id: r.class_id for r in got if r.doc_id not in (3, 5, None)}
    assert all(by[i] == 40 for i in range(40, 52))
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


@pytest.mark.parametrize("few", [0, 1024])
def test_near_copies_that_share_a_passage_with_all_others(spark, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW_PAIRS", few, raising=False)
    words = lambda name, n: [f"{name}x{i}" for i in range(n)]
    passage, rows = words("license", 150), []
    for i in range(80):
        own = words(f"own{i}", 29)
        rows += [(2 * i + j, " ".join(passage + own + words(f"end{i}of{j}", 20))) for j in (0, 1)]
    s = [near_dup.shingles(t) for _, t in rows[:3]]
    assert near_dup.aligned(s[0], s[1]) >= 0.8 > 0.7 > near_dup.aligned(s[1], s[2])
    alike = [len(set(near_dup.tuples(near_dup.shingles(a))) & set(near_dup.tuples(near_dup.shingles(b)))) >= near_dup.AGREE for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 if alike[d // 2] else d for d, _ in rows}


@pytest.mark.parametrize(("per_text", "worth", "once"), [(10**6, 0.2, True), (0, -1, False)])
def test_texts_that_meet_in_few_pairs_are_compared_once(spark, monkeypatch, per_text, worth, once):
    """Three families share a passage, nine texts of each are one class before; with or without a round of draws, classes are those of all links."""
    monkeypatch.setattr(near_dup, "FEW_PAIRS", 0)
    monkeypatch.setattr(near_dup, "PER_TEXT", per_text, raising=False)
    monkeypatch.setattr(near_dup, "WORTH", worth)
    words = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    texts = [" ".join([words("all", 100), words(f"own{f}", 20), words(f"end{f}of{j}", 2 + f)]) for f in range(3) for j in range(12)]
    rows = [(f"d{i:02d}", f"l{i // 12}" if i % 12 < 9 else f"o{i:02d}", t, near_dup.tuples(near_dup.shingles(t)), 1) for i, t in enumerate(texts)]
    placed = spark.createDataFrame(rows, "digest string, label string, text string, keys array<long>, weight long")
    tried, joined = [], near_dup.joined
    monkeypatch.setattr(near_dup, "joined", lambda *a: tried.append(1) or joined(*a))
    got = dict(map(tuple, near_dup.settle(placed.drop("text"), placed.select("digest", "text", "keys")).collect()))
    s = [near_dup.shingles(t) for t in texts]
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if group[i] != group[j] and (rows[i][1] == rows[j][1] or len(set(rows[i][3]) & set(rows[j][3])) >= near_dup.AGREE and near_dup.aligned(s[i], s[j]) >= near_dup.SIMILARITY):
                group = [group[j] if g == group[i] else g for g in group]
    want = {frozenset(f"d{i:02d}" for i, g in enumerate(group) if g == x) for x in group}
    assert {frozenset(d for d, x in got.items() if x == label) for label in got.values()} == want
    assert len(tried) == 1 or not once


def widest_join(spark, since):
    """Most rows that a join on labels of classes made in an execution from number `since` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    for k in range(since, store.executionsList().size()):
        run = store.executionsList().apply(k).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and "label_" in node.desc():
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                        most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def test_texts_near_a_large_class_meet_few_of_its_texts(spark, monkeypatch):
    """A class of copies with one changed word each; of other copies, with four, those align that changed the same word, among others."""
    monkeypatch.setattr(near_dup, "FEW_PAIRS", 0)
    monkeypatch.setattr(near_dup, "PER_TEXT", 10**6)
    rng, texts = random.Random(3), []
    for i in range(200):
        words = [f"v{k}" for k in range(150)]
        for k in [i % 14] if i < 100 else [*rng.sample(range(29), 3), 29]:
            words[5 * k + 4] = f"changed{i}of{k}"
        texts.append(" ".join(words))
    s = [near_dup.shingles(t) for t in texts]
    keys = [near_dup.tuples(x) for x in s]
    first = ["big" if i < 100 else f"o{i:03d}" for i in range(200)]
    placed = spark.createDataFrame([(f"d{i:03d}", first[i], t, keys[i], 1) for i, t in enumerate(texts)], "digest string, label string, text string, keys array<long>, weight long")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = dict(map(tuple, near_dup.settle(placed.drop("text"), placed.select("digest", "text", "keys")).collect()))
    assert widest_join(spark, since) <= 10 * len(texts)
    group = list(first)
    for i in range(len(s)):
        for j in range(i):
            if group[i] != group[j] and len(set(keys[i]) & set(keys[j])) >= near_dup.AGREE and near_dup.aligned(s[i], s[j]) >= near_dup.SIMILARITY:
                group = [group[j] if g == group[i] else g for g in group]
    classes = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert 1 < len(set(group)) < len(set(first))
    assert classes([got[f"d{i:03d}"] for i in range(len(s))]) == classes(group)


@pytest.mark.parametrize("n", [1, 150, 3000])
def test_outlines_differ_in_no_more_bits_than_texts_in_shingles(n):
    rng = np.random.default_rng(n)
    bits = lambda s: np.array(near_dup.outline(s), np.int64).view(np.uint8)
    for changed in (0, n // 10, n):
        a = rng.integers(0, 2**64, n, np.uint64)
        b = np.concatenate([a[changed:], rng.integers(0, 2**64, changed + 3, np.uint64)])
        only = len(np.setxor1d(a, b))
        differ = int(np.unpackbits(bits(a) ^ bits(b)).sum())
        assert differ <= only and (only - differ) % 2 == 0
        assert differ > 0.8 * only or only > 60
    assert near_dup.outline(a[:0]) == [0] * near_dup.WORDS


def test_shingles_of_one_class_are_not_returned(spark):
    """Texts of one class share `own`; all share `passage`. Own shingles come first and fill the places that must be looked at."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(f"d{f}{j}", f"c{f}", f"{words(f'own{f}x', 60)} {words('passage', 60)}") for f in (0, 1) for j in (0, 1)]
    rows += [("d2", "c2", f"{words('other', 10)} {words('passage', 60)}"), ("d3", "c3", words("passage", 60))]
    got = near_dup.rarest(spark.createDataFrame(rows, "digest string, label string, text string")).collect()
    assert {r.digest for r in got} == {"d2", "d3"} and {r.label for r in got} == {"c2", "c3"}
    shared = set(near_dup.shingles(words("passage", 60)).view(np.int64).tolist())
    assert all(r.key in shared for r in got)


def test_few_links_need_no_exchange(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(9)], "a string, b string")
    out, seen, write = [], [], common.materialize
    try:
        common.materialize = lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a)
        out = near_dup.components(edges).collect()
    finally:
        common.materialize = write
    assert {r.label for r in out} == {"000"} and len(out) == 10
    assert seen and not any("hashpartitioning" in p for p in seen)


def test_chains_of_near_copies(spark):
    """12 chains of 30 texts with 6 of 300 words changed from one to the next: every class is a chain, and no link between candidates is lost."""
    rng, rows = random.Random(8), []
    for c in range(12):
        words = [f"c{c}w{i}" for i in range(300)]
        for i in range(30):
            rows.append((100 * c + i, " ".join(words)))
            for _ in range(6):
                words[rng.randrange(300)] = f"new{rng.random()}"
    links = {100 * c + i for c in range(12) for i in range(29)}
    s = {d: near_dup.shingles(t) for d, t in rows}
    keys = {d: set(near_dup.tuples(x)) for d, x in s.items()}
    true = {d for d in links if near_dup.aligned(s[d], s[d + 1]) >= 0.8}
    candidates = {d for d in true if len(keys[d] & keys[d + 1]) >= near_dup.AGREE}
    assert len(true) > 300 and len(candidates) >= 0.99 * len(true)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == got[d + 1] for d in candidates)
    assert all(got[d] // 100 == d // 100 for d in got)


def test_recall_of_links(spark, data):
    """Every pair of the table that aligns, found over an inverted list of shingles, is in one class, and classes hold no others."""
    docs = common.table(spark, data, "documents").select("doc_id", "text")
    rows = [(r.doc_id, near_dup.shingles(r.text)) for r in docs.collect()]
    lists = defaultdict(list)
    for d, s in rows:
        for x in s.tolist():
            lists[x].append(d)
    shared = Counter()
    for v in lists.values():
        shared.update((a, b) for i, a in enumerate(v) for b in v[i + 1 :])
    by = dict(rows)
    true = [(a, b) for (a, b), n in shared.items() if n >= 0.4 * max(len(by[a]), len(by[b])) and near_dup.aligned(by[a], by[b]) >= near_dup.SIMILARITY]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert sum(got[a] == got[b] for a, b in true) >= 0.999 * len(true)
    linked = defaultdict(set)
    for a, b in true:
        linked[got[a]] |= {a, b}
    assert all(d in linked[c] or d == c or not len(by[d]) for d, c in got.items())


def test_alignment_needs_order():
    a = near_dup.shingles(" ".join(f"w{i}" for i in range(200)))
    assert near_dup.aligned(a, a) == 1
    swapped = near_dup.shingles(" ".join(f"w{i}" for i in [*range(100, 200), *range(100)]))
    assert near_dup.aligned(a, swapped) < 0.6 < len(set(a) & set(swapped)) / len(set(a) | set(swapped))


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 40) if i != 20]
    got = dict(map(tuple, near_dup.components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert {got[f"{i:03d}"] for i in range(21)} == {"000"} and {got[f"{i:03d}"] for i in range(21, 41)} == {"021"}
    chain = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(20)], "node string, parent string")
    assert {r.label for r in near_dup.forest(chain).collect()} == {"20"}


# columns that are called as the operators' own


CLASHING = ["score", "predicted", "held_out", "keys", "digest", "label", "position", "size", "bin", "row", "measures", "kept_digest", "weight", "spans", "doc", "part", "none", "copies", "target", "key", "node", "ids", "at", "first"]


@pytest.fixture(scope="module")
def clashing(docs):
    df = docs.drop("extra").filter("doc_id IS NOT NULL AND doc_id NOT IN (3, 5)")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def unchanged(df, but=()):
    for r in df.select("doc_id", *[c for c in CLASHING if c not in but]).collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING if c not in but)


def test_clashing_names(spark, clashing, rows):
    unchanged(near_dup.deduplicate(clashing))
    unchanged(span_dedup.remove_repeats(clashing))
    unchanged(mixing.apply_mix(clashing))
    unchanged(quality_rules.judge(clashing))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(50)], "doc_id long, quality int, label int")
    unchanged(quality_model.classify(clashing, labels, epochs=5), ("score", "predicted", "held_out"))
    n = clashing.count()
    assert lang_id.identify(clashing).count() == n
    assert fingerprint.compare(clashing).count() == n
    assert suffix_dedup.remove_repeats(clashing).count() == n
    assert mixing.mix(clashing).count() == n
    assert packing.pack(clashing).select("doc_id").distinct().count() == n
    assert near_dup.near_duplicates(clashing).count() == n


# pages and texts that earlier forms lost or broke on

PROSE = "<p>This is a sentence, with words. And another one, quite long, that says more about it.</p>" * 4


@pytest.mark.parametrize(
    ("page", "paragraphs"),
    [
        (f"<body><form id=aspnetForm><input name=q><div><article><h1>T</h1>{PROSE}</article></div></form></body>", 4),
        (f"<body><form method=post><label>Name</label><input><div><h1>T</h1>{PROSE}</div></form></body>", 4),
        (f'<article data-hidden="x"><h1>T</h1>{PROSE}</article>', 4),
        (f'<div data-role="navigation" data-id="sidebar" title="class=menu"><h1>T</h1>{PROSE}</div><div class=menu>links here</div>', 4),
        (f'<main><h1>T</h1>{PROSE}<section id="search"><h2>S</h2>{PROSE}</section><div id="copyright"><h2>C</h2>{PROSE}</div><section class="related"><h2>R</h2>{PROSE}</section></main>', 16),
        (f'<article><h1>T</h1>{PROSE}<div class="related"><ul><li><a href=x>Other thing, yes.</a></li></ul></div><div class="cookie-notice"><p>We use cookies.</p></div></article>', 4),
        (f"<article><h1>T</h1>{PROSE}<section id=comments><h2>Comments</h2><article class=comment>{PROSE}</article></section></article>", 4),
        (f'<article hidden="">{PROSE}</article><article><h1>T</h1>{PROSE}</article>', 4),
        (f"<div><article><h1>T</h1>{PROSE}</article><p>This is a sentence, with words, that closes it. And one more.</p></div><footer><p>This is a foot, of the page.</p></footer>", 5),
    ],
)
def test_html_lists_only_weigh(page, paragraphs):
    text = html_text.main_text(page)
    assert text.startswith("T\n\n") and text.count("This is") == paragraphs
    assert not any(x in text for x in ("Name", "links here", "cookies", "Other thing", "Comments"))


@pytest.mark.parametrize("tail", ["<a>y</a>", "</b>", "<p>x", "<li>x", "</i>", "<td>x"])
@pytest.mark.parametrize("fence", ["<div>", "<table>", ""])
def test_html_fenced_tags_in_linear_time(fence, tail):
    began = time.process_time()
    html_text.main_text("<a>x" + fence + "<i>" * 12000 + tail * 12000)
    assert time.process_time() - began < 3


RUNS = [" ", "\n", "\t ", "　", "a", "!", "日", "́", "1", "ab ", "<|endoftext|>"]


@pytest.mark.parametrize("run", RUNS)
def test_tokens_of_long_runs(run):
    path = packing.default_tokenizer()
    encode, _ = packing.encoder(path)
    for text in (run * 100_000, f"x{run * 100_000}y", f"x {run * 70_000} z{run * 70_000}\n!"):
        assert encode(text).tolist() == packing._library(path).encode(text, add_special_tokens=False).ids
    for n in (1_000_000, 5_000_000) if run in RUNS[:2] + RUNS[4:6] else (1_000_000,):
        ids = encode(run * (n // len(run)))
        assert len(ids) and len({int(x) for x in ids[len(ids) // 4 : len(ids) // 2]}) <= 8


def test_tokens_of_twenty_million_blanks(spark):
    docs = spark.createDataFrame([(1, "x" + " " * 20_000_000), (2, "\n" * 20_000_000 + "y"), (3, "ok")], "doc_id long, text string")
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(got) == 3 and all(r.n == r.of for r in got) and max(r.n for r in got) == 20_000_002


def test_tokens_equal_the_library():
    path, rng = packing.default_tokenizer(), random.Random(3)
    encode, _ = packing.encoder(path)
    for _ in range(2000):
        text = "".join(rng.choice([*" \n\t　\xa0\x85\x1c\x1fabc'sé日1!", "<|endoftext|>", "  ", " \n "]) for _ in range(rng.randint(0, 60)))
        assert encode(text).tolist() == packing._library(path).encode(text, add_special_tokens=False).ids
