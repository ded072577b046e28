"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, portions
from .common import documents, shared_path, small_batches, stored

#: Texts that the library encodes at once: bounds the memory that encodings take.
ENCODE_BATCH = 32


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and of the library's name and version, which together fix all counts."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"tokenizers {tokenizers.__version__}".encode()).hexdigest()


@cache
def _tokenizer(name: str) -> tuple[Callable[[list[str]], list[list[int]]], Encoder | None, list[str]]:
    """The library's function for lists of texts, a table in front of it where its split pattern allows one, and the strings that the library treats apart."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for at in range(0, len(texts), ENCODE_BATCH) for x in tokenizer.encode_batch_fast(texts[at:at + ENCODE_BATCH], add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    split = about["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not about["normalizer"] and not about["post_processor"]
    apart = about["added_tokens"]
    plain = plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in apart)
    return encode, Encoder(encode) if plain else None, [x["content"] for x in apart]


def _counts(name: str, texts: list[str]) -> list[int]:
    encode, encoder, apart = _tokenizer(name)
    whole = [i for i, text in enumerate(texts) if encoder is None or any(x in text for x in apart)]
    out = encoder.counts(texts).tolist() if encoder else [0] * len(texts)
    for i, ids in zip(whole, encode([texts[i] for i in whole]), strict=True):
        out[i] = len(ids)
    return out


def _encoder(name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n for _, texts in portions(batch) for n in _counts(name, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = "byte_bpe_50k.json", limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    ``cache`` is a Parquet folder with one part for each tokenizer digest, of (content digest,
    n_tokens). Content is normalised only where that can't change a count: a null text is the
    empty text. Distinct contents are found by digest, with one text for each digest and map task
    before the shuffle; those that the cache lacks are encoded once and appended in one commit.
    A warm cache is compared by digests alone. Then every row takes its count from the cache by
    digest; adaptive execution splits a digest of very many rows. Without ``cache`` a fresh one is
    made in the shared folder.

    Texts that the split pattern lets fall apart are counted by their pieces (``bpe``), which gives
    what the library gives; texts with special strings, and other tokenizers, go to the library whole.

    Repeated rows and ids are returned as often as they come, a null id as null, no rows for an
    empty table. Other columns of ``docs`` are not used.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(public_tokenizers.path(tokenizer))
    part = f"{cache or shared_path(spark, 'token_counts')}/tokenizer={version}"
    text = F.coalesce("text", F.lit(""))
    keyed = documents(docs, id_col, text_col).select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    schema = "digest binary, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(part)  # an empty part where there is none

    def counts() -> DataFrame:  # two jobs that append at once may repeat a digest
        return spark.read.schema(schema).parquet(part).dropDuplicates(["digest"])

    wanted = keyed.select("digest", "text")
    if not counts().isEmpty():
        # a warm cache: digests alone are compared with it, and only rows with missing ones go on; where these are few, Spark broadcasts them
        missing = stored(keyed.select("digest").distinct().join(counts(), "digest", "left_anti"), "missing_digests")
        wanted = wanted.join(missing, "digest", "left_semi")
    texts = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    with small_batches(spark):
        texts.mapInArrow(_encoder(tokenizer), schema).write.mode("append").parquet(part)
    # written without repeats, so that the join takes it straight from a shuffle and a digest of very many rows can be split
    found = stored(counts(), "token_counts_of_run")
    return keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(found, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
