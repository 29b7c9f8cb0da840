"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_text, langid, licences, mixing, near_dedup, quality, substring_dedup, suffix_dedup
from .storage import read


def held_out(ident: str = "doc_id") -> F.Column:
    """Rows that nothing is learned from; those without an id are among them."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 5 == 0, F.lit(True))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "licence", "dice", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences.licence", ",").alias("licences"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compared_with_edits(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.printed("sketch").alias("fingerprint"),
        fingerprint.printed("edited_sketch").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeated(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out()), read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "ambiguous")


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_simhash": op2_simhash,
    "op3_licences": op3_licences,
    "op4_fingerprint": op4_fingerprint,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_source_mix": op9_source_mix,
    "op10_language_id": op10_language_id,
}

_REPEATED_WORDS = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT row, unnest(generate_series(1, len(words) - 34)) AS i, words FROM docs WHERE len(words) >= 35),
windows AS (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM starts),
hits AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT row, unnest(generate_series(i, i + 34)) AS i FROM hits),
lost AS (SELECT row, list(i) AS gone, count(*) AS n FROM gone GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lost USING (row)
"""

_MIX = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS bucket FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sizes),
ranked AS (SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio FROM weighed),
summed AS (SELECT *, coalesce(sum(source_size) OVER up_to, 0) AS stopped, coalesce(sum(weight) OVER up_to, 0) AS gone,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM ranked WINDOW up_to AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * stopped) / CAST(all_weight - gone AS DOUBLE) AS own FROM summed),
fixed AS (SELECT *, max(CASE WHEN own <= 2.0::DOUBLE * ratio THEN own END) OVER () AS level FROM levels),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level * weight, 2.0::DOUBLE * source_size)) AS target FROM fixed),
placed AS (SELECT docs.*, source_size, target, CAST(row_number() OVER (PARTITION BY docs.source ORDER BY size, bucket, doc_id) AS DOUBLE) AS place,
    CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0::DOUBLE END AS step,
    CAST(('0x' || substr(md5(coalesce(docs.source, '')), 1, 3))::INTEGER AS DOUBLE) / 4096.0::DOUBLE AS shift
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(place * step + shift) - floor((place - 1.0::DOUBLE) * step + shift) AS BIGINT) * size AS taken
FROM placed
"""

_REPEATED_BYTES = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT row, h, unnest(generate_series(1, length(h) // 2 - 399)) AS i FROM docs WHERE length(h) >= 800),
windows AS (SELECT row, i, md5(substr(h, 2 * i - 1, 800)) AS w FROM starts),
hits AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
runs AS (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hits),
named AS (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS run FROM runs),
spans AS (SELECT row, min(i) AS s, max(i) + 400 AS e FROM named GROUP BY row, run),
gaps AS (SELECT row, s, e, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 1) AS open FROM spans),
cut AS (SELECT row, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS tail,
    string_agg(substr(h, CAST(2 * open - 1 AS BIGINT), CAST(2 * (s - open) AS BIGINT)), '' ORDER BY s) AS kept
  FROM gaps JOIN docs USING (row) GROUP BY row)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, CAST(2 * tail - 1 AS BIGINT)) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (row)
"""

_CONTAMINATED = r"""
WITH lowered AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tests AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(len(words), 10) AS size FROM tests WHERE len(words) > 0),
shown AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM (SELECT *, unnest(generate_series(1, len(words) - size + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT size FROM shown),
starts AS (SELECT row, size, words, unnest(generate_series(1, len(words) - size + 1)) AS i FROM lowered, sizes WHERE len(words) >= size),
windows AS (SELECT row, size, i, array_to_string(words[i:i + size - 1], ' ') AS w FROM starts),
hits AS (SELECT row, size, i, item_id FROM windows JOIN shown USING (size, w)),
covered AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest(generate_series(i, i + size - 1)) AS p FROM (SELECT DISTINCT row, size, i FROM hits)) GROUP BY row),
listed AS (SELECT row, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (row) LEFT JOIN listed USING (row)
"""

_LICENCES = r"""
WITH templates(t, licence, n, gram, c) AS (VALUES {templates}),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT row, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM docs),
hits AS (SELECT row, t, n, gram, c, pos, row_number() OVER (PARTITION BY row, t, gram ORDER BY pos) AS k FROM grams JOIN templates USING (gram)),
capped AS (SELECT h.row, h.t, h.n, h.pos, coalesce(b.pos, 0) AS before FROM hits h LEFT JOIN hits b ON b.row = h.row AND b.t = h.t AND b.gram = h.gram AND b.k = h.k - h.c),
whole AS (SELECT row, t FROM capped WHERE before = 0 GROUP BY row, t, n HAVING count(*) * 1.2::DOUBLE >= n * 0.8::DOUBLE),
open AS (SELECT capped.* FROM capped JOIN whole USING (row, t)),
passages AS (SELECT a.row, a.t, 2.0::DOUBLE * row_number() OVER (PARTITION BY a.row, a.t, a.pos ORDER BY b.pos) / CAST(b.pos - a.pos + 1 + a.n AS DOUBLE) AS dice
  FROM open a JOIN open b ON a.row = b.row AND a.t = b.t AND b.pos >= a.pos AND b.pos < a.pos + floor(a.n * 1.5::DOUBLE) AND b.before < a.pos),
best AS (SELECT row, licence, max(dice) AS dice FROM passages JOIN (SELECT DISTINCT t, licence FROM templates) USING (t) WHERE dice >= 0.8::DOUBLE GROUP BY row, licence),
listed AS (SELECT row, count(*) AS n, first(licence ORDER BY dice DESC, licence) AS licence, max(dice) AS dice, string_agg(licence, ',' ORDER BY dice DESC, licence) AS licences FROM best GROUP BY row)
SELECT doc_id, licence, dice, coalesce(n, 0) AS n_licences, coalesce(licences, '') AS licences FROM docs LEFT JOIN listed USING (row)
""".replace("{templates}", ", ".join(f"({i}, '{name}', {grams.total()}, '{g}', {c})" for i, (name, grams) in enumerate((n, licences.template_bigrams(t)) for n, t in licences.TEMPLATES) for g, c in grams.items()))

ORACLES = {"op3_licences": _LICENCES, "op8_decontaminate": _CONTAMINATED, "op6_suffix_dedup": _REPEATED_BYTES, "op5_substring_dedup": _REPEATED_WORDS, "op9_source_mix": _MIX}
