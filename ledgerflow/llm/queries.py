"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, decontaminate, html_text, language_id, line_dedup, piece_nbest, quality, simhash, token_count, training_order
from .common import shared_path, table


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all sequences of ``documents`` as shards in training order and reads them back: one row a sequence."""
    from pyspark.sql import functions as F

    out = shared_path(spark, "training_order")
    training_order.materialise(table(spark, sf_dir, "documents"), out, stable=True)
    return training_order.read_shards(spark, out).select("slot", "shard_id", "doc_id", "seq_no", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"), all_pairs=True)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance")


def op9_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_nbest.segment_nbest(table(spark, sf_dir, "documents"), with_ids=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline script, which is imported when it is asked for: it lies beside the package, not in it."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_training_order, op2_token_count, op3_language_id, op4_html_text, op5_bloom_lm, op6_decontaminate, op7_line_dedup, op8_quality, op9_piece_nbest, op10_simhash, pipeline)
    return {f.__name__: f for f in own}


#: Every window of every item, at its place in the documents.
OP6_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, words[i:i + least(len(words), 10) - 1] AS w
  FROM item, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS r(i) WHERE len(words) > 0),
doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
spot AS (SELECT doc_id, i, n, words[i:i + n - 1] AS w FROM doc, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(words) - n + 2)) AS r(i) WHERE len(words) >= n),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.w = win.w),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS all_ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(all_ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL}
