"""What leaders send: entries for witnesses, snapshots in chunks, pages of the log; and metrics of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_config_change
from ..schema import CHUNK_BYTES
from .scans import entry_size, terms_of


def witness_entries(log: DataFrame) -> DataFrame:
    """The log as a witness gets it: config changes whole, of other entries only index and term."""
    whole = is_config_change()
    return log.select("shard_id", "idx", F.when(whole, F.col("type")).otherwise("Metadata").alias("type"), "term", F.when(whole, F.col("key")).otherwise(0).alias("key"))


def snapshot_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of snapshots' files (shard_id, idx, file_id, size), numbered in each file and over the whole snapshot.

    File 0 is the main one. Files are numbered by a window over files, not chunks; an empty file has one chunk.
    """
    count = F.greatest(F.call_function("div", F.col("size") + (chunk_bytes - 1), F.lit(chunk_bytes)), F.lit(1).cast("long"))
    before = Window.partitionBy("shard_id", "idx").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("file_chunk_count", count).withColumn("_before", F.coalesce(F.sum("file_chunk_count").over(before), F.lit(0)))
    rows = rows.withColumn("chunk_count", F.sum("file_chunk_count").over(Window.partitionBy("shard_id", "idx")))
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_chunk_count") - 1)).alias("file_chunk_id"))
    size = F.least(F.lit(chunk_bytes).cast("long"), F.col("size") - F.col("file_chunk_id") * chunk_bytes)
    return each.select("shard_id", "idx", "file_id", "file_chunk_id", "file_chunk_count", (F.col("_before") + F.col("file_chunk_id")).alias("chunk_id"), "chunk_count", size.alias("bytes"))


def witness_chunks(snapshots: DataFrame) -> DataFrame:
    """The one chunk without payload that a witness gets instead of a snapshot."""
    return snapshots.select("shard_id", "idx", "term", F.lit(0).cast("long").alias("chunk_id"), F.lit(1).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("witness"))


def replicate_heads(progress: DataFrame, log: DataFrame, first_idx: int, commit: int) -> DataFrame:
    """Heads of the messages to each replica: a snapshot where the log is gone, else entries after the match with its term; the commit index that a heartbeat may tell."""
    terms = terms_of(log, progress.select("shard_id", "replica_id", F.col("match").alias("idx")))
    next_ = F.col("idx") + 1
    return terms.select("shard_id", "replica_id", next_.alias("next"), F.when(next_ < first_idx, "snapshot").otherwise("replicate").alias("send"), F.col("term").alias("prev_term"), F.least("idx", F.lit(commit).cast("long")).alias("heartbeat_commit"))


def replicate_pages(progress: DataFrame, log: DataFrame, max_bytes: int) -> DataFrame:
    """Entries of the next message to each replica: those after its match within the byte budget, the first one in any case."""
    rows = log.join(progress.select("shard_id", "replica_id", "match"), "shard_id").where("idx > match")
    so_far = Window.partitionBy("shard_id", "replica_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_seen", F.sum(entry_size()).over(so_far)).where((F.col("_seen") <= max_bytes) | (F.col("idx") == F.col("match") + 1)).select("shard_id", "replica_id", "idx", "term")


def event_metrics(log: DataFrame, kinds: list[str]) -> DataFrame:
    """Counters of each kind of event by shard, and the shard's newest term and client."""
    counts: list[Column] = [F.count_if(F.col("k") == kind).alias(kind) for kind in kinds]
    return log.groupBy("shard_id").agg(*counts, F.max("term").alias("term"), F.max_by("client_id", "idx").alias("last_client"))
