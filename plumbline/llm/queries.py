"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from .common import table
from .decontaminate import decontamination_report
from .embeddings import linked_vectors
from .html import page_texts
from .interactions import filter_interactions
from .langid import language_report
from .licenses import license_report, license_sql
from .mixing import mixed_documents
from .neardup import near_duplicate_report
from .packing import packed_documents
from .quality import quality_report
from .tokenfiles import token_file_report
from .tokens import token_counts
from .whitening import whitened_vectors


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark, table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'max') = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN counts USING (vec_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(spark, table(spark, sf_dir, "documents"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(spark, table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(spark, table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s(i) WHERE len(w) > 0
), doc_grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM doc_words, (SELECT DISTINCT n FROM item_windows) AS lengths, unnest(generate_series(1, len(w) - n + 1)) AS s(i) WHERE len(w) >= n
), found AS (
  SELECT doc_id, item_id, i, n FROM doc_grams JOIN item_windows USING (n, gram)
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(generate_series(i, i + n - 1)) AS s(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(spark, table(spark, sf_dir, "embeddings"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
flags AS (
  SELECT part, d.doc_id IN (SELECT doc_id FROM good) AS good, d.doc_id IN (SELECT doc_id FROM toxic) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text), regexp_matches(d.text, '[#$%&*|]'),
     coalesce(d.doc_id > first, false)] AS fails
  FROM d JOIN firsts USING (text)
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), tried AS (
  SELECT part, good, toxic, fails, filter_order, step, fails[ascii(filter_order[step]) - 64] AS own,
    len(list_filter(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS failed
  FROM (SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL), orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), counted AS (
  SELECT t.*, n FROM tried AS t JOIN (SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL) USING (part, good, toxic, fails)
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The pipeline and the training-data operators."""
    return {
        "pipeline": pipeline.run,
        "op1_quality": op1_quality,
        "op2_embedding_neardup": op2_embedding_neardup,
        "op3_packing": op3_packing,
        "op4_license_scan": op4_license_scan,
        "op5_minhash_neardup": op5_minhash_neardup,
        "op6_language_id": op6_language_id,
        "op7_html_text": op7_html_text,
        "op8_token_files": op8_token_files,
        "op9_token_counts": op9_token_counts,
        "op10_decontamination": op10_decontamination,
        "op11_mixing": op11_mixing,
        "op12_whitening": op12_whitening,
        "op13_filter_interactions": op13_filter_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_neardup": OP2_SQL, "op4_license_scan": license_sql(), "op10_decontamination": OP10_SQL, "op13_filter_interactions": OP13_SQL}
