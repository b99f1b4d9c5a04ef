"""The queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covagrid.llm.common import table
from covagrid.llm.decontaminate import benchmark_matches
from covagrid.llm.exact_dedup import exact_dedup
from covagrid.llm.html_extract import main_texts
from covagrid.llm.license_scan import license_notices
from covagrid.llm.line_dedup import dedup_lines
from covagrid.llm.packing import pack_documents
from covagrid.llm.quality import quality_scores
from covagrid.llm.simhash import simhash_groups
from covagrid.llm.url_filter import url_verdicts
from covagrid.llm.warc import warc_round_trip

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="lines_removed")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH rules(rule, rule_verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), split AS (SELECT rule, rule_verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rule_path FROM rules),
best AS (
  SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN split s ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.host, p.path
)
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

OP4_SQL = r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, list_filter(range(len(ps)), lambda i: ends_with(ps[i + 1], chr(10)) OR i = len(ps) - 1) AS es FROM t),
w AS (
  SELECT doc_id, b, b + 3 AS e, 'short' || x || chr(1) || y || chr(1) || z AS body
  FROM (SELECT doc_id, b, trim(ps[b + 1], ' ' || chr(10)) AS x, trim(ps[b + 2], ' ' || chr(10)) AS y, trim(ps[b + 3], ' ' || chr(10)) AS z FROM (SELECT doc_id, ps, unnest(range(0, len(ps) - 2)) AS b FROM l WHERE len(ps) >= 3))
  WHERE length(x) + length(y) + length(z) >= 100
  UNION ALL
  SELECT doc_id, b, e, 'whole' || body AS body
  FROM (SELECT doc_id, b, e, array_to_string(list_transform(ps[b + 1 : e], lambda x: trim(x, ' ' || chr(10))), chr(1)) AS body FROM (SELECT doc_id, ps, CASE WHEN j = 0 THEN 0 ELSE es[j] + 1 END AS b, es[j + 3] + 1 AS e FROM (SELECT *, unnest(range(0, len(es) - 2)) AS j FROM l WHERE len(es) >= 3)))
  WHERE trim(body, chr(1)) <> ''
), f AS (
  SELECT doc_id, b, e, first_value(doc_id) OVER o AS first_doc, first_value(b) OVER o AS first_b, first_value(e) OVER o AS first_e
  FROM w WINDOW o AS (PARTITION BY body ORDER BY doc_id, b, e)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_doc = doc_id THEN greatest(b, first_e) ELSE b END, e)) AS pos
  FROM f WHERE first_doc <> doc_id OR first_b <> b
), k AS (
  SELECT x.doc_id, string_agg(piece, '' ORDER BY x.pos) FILTER (WHERE c.pos IS NULL) AS text, count(c.pos)::INTEGER AS lines_removed
  FROM (SELECT doc_id, unnest(ps) AS piece, unnest(range(0, len(ps))) AS pos FROM l) x LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY x.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP7_SQL = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first_page FROM t GROUP BY digest),
names AS (
  SELECT digest, first_page, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(digest, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM g
)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM t JOIN names USING (digest)
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), ranked AS (
  SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id
  FROM t WINDOW w AS (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_best_fit_packing, op3_quality_classifier, op4_line_dedup, op5_html_extraction, op6_license_scan, op7_warc, op8_exact_dedup, op9_decontamination, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL}
