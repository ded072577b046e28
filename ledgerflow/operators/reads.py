"""Reads of materialised state, and reports on shards and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_at(log: DataFrame, asks: DataFrame) -> DataFrame:
    """Value of each asked key as of an index: asks (shard_id, k, read_idx, read_id); null where nothing was written yet.

    Entries and asks are one stream in index order for each key, so an as-of join is one window. With
    the commit index this is a linearizable read, with a replica's applied index a stale one.
    """
    writes = log.select("shard_id", "k", F.col("idx").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("read_id"), F.struct("v", "idx").alias("_value"))
    wanted = asks.select("shard_id", "k", F.col("read_idx").alias("_at"), F.lit(1).alias("_kind"), "read_id", F.lit(None).cast(writes.schema["_value"].dataType).alias("_value"))
    so_far = Window.partitionBy("shard_id", "k").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = writes.unionByName(wanted).withColumn("_seen", F.last("_value", ignorenulls=True).over(so_far)).where("_kind = 1")
    return found.select("shard_id", "k", F.col("_at").alias("read_idx"), "read_id", F.col("_seen.v").alias("v"), F.col("_seen.idx").alias("written_at"))


def read_permissions(commits: DataFrame, asks: DataFrame) -> DataFrame:
    """Asks with the index that a linearizable read waits for: the shard's commit index; a shard without leader gives none and drops them."""
    known = commits.select("shard_id", F.col("commit").alias("read_idx"))
    return asks.join(known, "shard_id", "left").withColumn("dropped", F.col("read_idx").isNull())


def queued_reads(asks: DataFrame) -> DataFrame:
    """Reads as they enter a shard's queue: the first ask of each context; ``went_back`` marks a commit index below the one before, a broken leader."""
    first = F.row_number().over(Window.partitionBy("shard_id", "ctx").orderBy("seq"))
    order = Window.partitionBy("shard_id").orderBy("seq")
    once = asks.withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return once.withColumn("went_back", F.coalesce(F.col("read_idx") < F.lag("read_idx").over(order), F.lit(False)))


def snapshot_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Result of each snapshot request by its key: ignored ones are rejected, others aborted or completed with their index."""
    found = results.select("shard_id", "key", "ignored", "aborted", F.col("idx").alias("_idx"))
    code = F.when(F.col("ignored").isNull(), "pending").when(F.col("ignored"), "rejected").when(F.col("aborted"), "aborted").otherwise("completed")
    return requests.join(found, ["shard_id", "key"], "left").select("shard_id", "key", code.alias("code"), F.when(code == "completed", F.col("_idx")).alias("idx"))


def shard_infos(progress: DataFrame, states: DataFrame, views: DataFrame) -> DataFrame:
    """Live status of each replica: role, match, hard state, leader and whether it leads."""
    rows = progress.select("shard_id", "replica_id", "role", "match").join(states, ["shard_id", "replica_id"], "left").join(views.select("shard_id", "leader_id"), "shard_id", "left")
    return rows.withColumn("is_leader", F.col("leader_id").eqNullSafe(F.col("replica_id"))).withColumn("pending", F.col("term").isNull())


def shard_members(progress: DataFrame) -> DataFrame:
    """Replicas of each shard by role, in ascending order; a shard has a handful."""
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("replica_id")))).alias(role)
    return progress.groupBy("shard_id").agg(of("voter"), of("witness"), of("non_voting"))


def host_report(progress: DataFrame, hosts: DataFrame) -> DataFrame:
    """Replicas and shards of each host, and whether it holds a witness."""
    return progress.join(hosts, ["shard_id", "replica_id"]).groupBy("host_id").agg(F.count("*").alias("replicas"), F.countDistinct("shard_id").alias("shards"), F.bool_or(F.col("role") == "witness").alias("holds_witness"))
