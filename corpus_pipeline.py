"""Corpus pipeline: documents through five training-data operators, each stage written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate, language_id, line_dedup, piece_nbest, simhash
from ledgerflow.llm.common import row_key, stored, table

#: Least mean probability of the predicted language; an even guess among four is 0.25.
LANGUAGE_SCORE = 0.4
#: Characters from which an unsure language counts against a document; a word or two may belong to several.
SURE_CHARS = 50


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those of no language go, and longer ones of an unsure one. Each row has its own verdict, whatever its id."""
    none = F.col("lang_pred") == "und"
    model = language_id.fit(docs.where(~language_id.held_out()))
    verdicts = language_id.identify(docs.select(row_key().alias("doc_id"), "text"), model)
    found = verdicts.where(none | (F.col("score") < LANGUAGE_SCORE)).groupBy(F.col("doc_id").alias("rejected")).agg(F.bool_or(none).alias("no_language"))
    found = stored(found, "rejected")  # its size is known then: a small set is broadcast, and the texts stay where they are
    keyed = docs.withColumn("row_key", row_key())
    return keyed.join(found, (keyed["row_key"] == found["rejected"]) & (found["no_language"] | (F.length(keyed["text"]) >= SURE_CHARS)), "left_anti").drop("row_key")


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; a document with no line left goes."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The n-best segmentations of the documents that are left, with their ids and the decoded text."""
    return piece_nbest.segment_nbest(docs, with_ids=True)


STAGES = [
    ("language ID", identified),
    ("line dedup", lines_once),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding and decoding", segmented),
]

#: The first stage is a trained network, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
