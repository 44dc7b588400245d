"""The operators as queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, language, nearjoin, packing, pseudonyms, quality, repeats, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.op1(table(spark, sf_dir, "documents"), spark.conf.get(pseudonyms.KEY_SETTING, None) or pseudonyms.DEMO_KEY)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op2(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op4(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.op6(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op8(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op9(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_repeats": op2_repeats,
    "op3_warc": op3_warc,
    "op4_fingerprint": op4_fingerprint,
    "op5_toxicity": op5_toxicity,
    "op6_near_join": op6_near_join,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
}

OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)
), firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (win) WHERE first_id < doc_id
), words AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
last AS (SELECT digest, max(page_id) AS last FROM p GROUP BY digest),
found AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN octet_length(encode(html)) >= 1000 AND last <> page_id THEN last END AS refers_to
  FROM p JOIN last USING (digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM found
"""

OP10_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, len(win) AS size, array_to_string(win, ' ') AS win
  FROM (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: w[i + 1 : i + 10])) AS win FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM doc_words, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, item_id, i, d.size FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.win = b.win
), hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Models, sketches and the packing have no SQL; their tests hold them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_repeats": OP2_SQL, "op3_warc": OP3_SQL, "op10_decontaminate": OP10_SQL}
