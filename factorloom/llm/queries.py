"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, fingerprint, html_text, lang_id, mixing, near_dup, packing, quality_model, quality_rules, span_dedup, suffix_dedup, vector_codes
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality_model.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_dup_lines * 2 > len(string_split(t, chr(10)))
            OR length(regexp_replace(t, '[^!?]+', '', 'g')) * 5 > n_words
            OR length(regexp_replace(t, '\P{Lu}+', '', 'g')) * 2 > word_chars
            OR length(regexp_replace(t, '\P{L}+', '', 'g')) * 2 < word_chars) AS kept
FROM b
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT * 1024)::DOUBLE / 4294967296.0::DOUBLE AS place FROM documents),
b AS (SELECT source, floor(place)::INT AS bin, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal FROM s),
w AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most, CASE ordinal % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM o),
f AS (SELECT *, row_number() OVER x AS rank, (sum(source_size) OVER () - coalesce(sum(most) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW x AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)),
k AS (SELECT min(rank) AS first FROM f WHERE level * weight <= most),
t AS (SELECT f.source, source_size, slope, CASE WHEN first IS NULL OR rank < first THEN most::DOUBLE ELSE (SELECT level FROM f AS g WHERE g.rank = k.first) * weight END AS target FROM f, k),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
e AS (SELECT u.source, target - whole * source_size AS rest, g.i AS bin,
             (sum(coalesce(b.n, 0)) OVER (PARTITION BY u.source ORDER BY g.i) - coalesce(b.n, 0))::BIGINT AS begins, coalesce(b.n, 0) AS held
      FROM u CROSS JOIN generate_series(0, 1024) AS g(i) LEFT JOIN b ON b.source IS NOT DISTINCT FROM u.source AND b.bin = g.i),
c AS (SELECT source, arg_min(bin, (abs(begins - rest), bin)) AS cut FROM e GROUP BY source),
r AS (SELECT doc_id, size, source_size, target, slope, (size * (whole + (e.bin < c.cut)::INT))::BIGINT AS taken, least(1.0, (begins + (place - floor(place)) * held) / target) AS share
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND floor(d.place)::INT = e.bin)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS position
FROM r
"""



def _op11_sql(rounds: int = 6) -> str:
    """Rounds unrolled; a relation for each assignment and each set of entries."""
    text = ["""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT r, part, list_slice(e, part * len(e) // 8 + 1, (part + 1) * len(e) // 8) AS x FROM v, generate_series(0, 7) AS g(part)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS entry FROM v QUALIFY entry < 16),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN s USING (r))"""]
    for i in range(rounds + 1):
        text.append(f"""
a{i} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min({{'d': d, 'entry': entry}}) AS best FROM (
      SELECT r, p.part, x, entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT AS d FROM p JOIN c{i} AS c ON p.part = c.part) GROUP BY r, part)""")
        if i < rounds:
            text.append(f"""
m{i} AS (SELECT part, entry, k, sum(v)::HUGEINT AS total, count(*) AS n FROM (SELECT part, best.entry AS entry, unnest(x) AS v, unnest(generate_series(1, len(x))) AS k FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT part, entry, list((CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END)::BIGINT ORDER BY k) AS c FROM m{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{i} AS o LEFT JOIN n{i} AS n ON o.part = n.part AND o.entry = n.entry)""")
    return "WITH " + ",".join(text) + f"""
, f AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h
"""


def _op12_sql(rounds: int = 3) -> str:
    text = ["""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
      WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < 16)"""]
    for i in range(rounds + 1):
        text.append(f"""
a{i} AS MATERIALIZED (SELECT r, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
      SELECT r, x, k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::BIGINT AS d FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            text.append(f"""
m{i} AS (SELECT k, j, sum(v)::HUGEINT AS total, count(*) AS n FROM (SELECT best.k AS k, unnest(x) AS v, unnest(generate_series(1, 64)) AS j FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT k, list((CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END)::BIGINT ORDER BY j) AS c FROM m{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{i} AS o LEFT JOIN n{i} AS n ON o.k = n.k)""")
    return "WITH " + ",".join(text) + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} AS c ON c.k = best.k
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, w[j:j + n - 1] AS x FROM (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (SELECT r, j, n, w[j:j + n - 1] AS x FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT r, j, dw.n AS n, item FROM dw JOIN iw ON dw.x = iw.x),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(j, j + n - 1)) AS k FROM hit) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_span_dedup": op2_span_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mix": op6_source_mix,
    "op7_html_text": op7_html_text,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_curve_packing": op9_curve_packing,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": OP5_SQL,
    "op6_source_mix": OP6_SQL,
    "op11_vector_codes": _op11_sql(),
    "op12_centroid_clusters": _op12_sql(),
    "op13_decontamination": OP13_SQL,
}
