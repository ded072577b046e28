"""Log overwrite, conflicts and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_batches(appends: DataFrame) -> DataFrame:
    """For appends (shard_id, seq, start, n, term): the part of each that later ones leave.

    An append drops all from its start on, so an entry lives while no later append starts at or
    before it. The window runs over appends, not entries, from the last one back.
    """
    later = Window.partitionBy("shard_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min("start").over(later)
    end = F.col("start") + F.col("n")
    return appends.withColumn("live_end", F.least(end, F.coalesce(cut, end))).where("live_end > start")


def live_entries(appends: DataFrame) -> DataFrame:
    """(shard_id, idx, term, seq) of the log after all appends."""
    return live_batches(appends).select("shard_id", F.explode(F.sequence(F.col("start"), F.col("live_end") - 1)).alias("idx"), "term", "seq")


def conflict_index(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """First index of each shard's incoming entries that the log lacks with the same term."""
    return incoming.join(log.select("shard_id", "idx", "term"), ["shard_id", "idx", "term"], "left_anti").groupBy("shard_id").agg(F.min("idx").alias("conflict_idx"))


def append_faults(conflicts: DataFrame, commits: DataFrame) -> DataFrame:
    """Conflicts at or below what is committed: such entries must not be overwritten."""
    return conflicts.join(commits, "shard_id").where("conflict_idx <= commit")


def overlay_extents(extents: DataFrame) -> DataFrame:
    """Index extents (shard_id, seq, start, end, file) after overlays; neighbours in one file are one extent."""
    later = Window.partitionBy("shard_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    live = extents.withColumn("end", F.least("end", F.coalesce(F.min("start").over(later) - 1, F.col("end")))).where("end >= start")
    order = Window.partitionBy("shard_id").orderBy("start")
    starts = (F.lag("end").over(order) + 1 != F.col("start")) | (F.lag("file").over(order) != F.col("file"))
    grouped = live.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return grouped.groupBy("shard_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("file").alias("file")).drop("_island")


def obsolete_files(on_disk: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk that no live extent names."""
    return on_disk.join(live.select("shard_id", "file").distinct(), ["shard_id", "file"], "left_anti")


def merge_file_sets(a: Column, b: Column) -> Column:
    """Sorted union of two sets of file numbers."""
    return F.sort_array(F.array_union(a, b))


def merge_file_metas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two lists of files by number; of a file in both the first list's row stays."""
    both = a.withColumn("_from", F.lit(0)).unionByName(b.withColumn("_from", F.lit(1)))
    rest = [c for c in a.columns if c not in ("shard_id", "file")]
    return both.groupBy("shard_id", "file").agg(F.min_by(F.struct(*rest), "_from").alias("_x")).select("shard_id", "file", *(F.col(f"_x.{c}").alias(c) for c in rest))


def drop_obsolete(extents: DataFrame, obsolete: DataFrame) -> DataFrame:
    """Extents in files numbered above the newest obsolete file of their shard."""
    newest = obsolete.groupBy("shard_id").agg(F.max("file").alias("_newest"))
    return extents.join(newest, "shard_id", "left").where("_newest is null or file > _newest").drop("_newest")


def pending_compactions(tasks: DataFrame) -> DataFrame:
    """One task for each replica, of its newest index; how many it replaced, and whether a later request went back."""
    order = Window.partitionBy("shard_id", "replica_id").orderBy("seq")
    rows = tasks.withColumn("_back", F.coalesce(F.col("idx") < F.lag("idx").over(order), F.lit(False)))
    return rows.groupBy("shard_id", "replica_id").agg(F.max("idx").alias("idx"), (F.count("*") - 1).alias("replaced"), F.bool_or("_back").alias("went_back"))


def saved_marks(saves: DataFrame, memory: DataFrame) -> DataFrame:
    """The mark that each save leaves: its index where the (index, term) is in memory, else what was before. Marks may fall after a truncation."""
    found = memory.select("shard_id", "idx", "term", F.col("idx").alias("_mark")).join(saves.select("shard_id", "idx", "term").distinct(), ["shard_id", "idx", "term"])
    rows = saves.join(found, ["shard_id", "idx", "term"], "left")
    so_far = Window.partitionBy("shard_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("shard_id", "seq", F.coalesce(F.last("_mark", ignorenulls=True).over(so_far), F.lit(0)).alias("saved_to"))


def shard_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards that were loaded, kept or offloaded between two sets."""
    a, b = before.select("shard_id", F.lit(1).alias("was")), after.select("shard_id", F.lit(1).alias("is_"))
    return a.join(b, "shard_id", "full").select("shard_id", F.when(F.col("was").isNull(), "loaded").when(F.col("is_").isNull(), "offloaded").otherwise("kept").alias("change"))


def merge_views(updates: DataFrame) -> DataFrame:
    """Shard views: replicas of the newest config index, leader of the highest term; the first update that has it wins."""
    replicas = F.max(F.when(F.col("config_index") > 0, F.struct("config_index", (-F.col("seq")).alias("s"), "replicas")))
    leader = F.max(F.when(F.col("leader_id") != 0, F.struct("term", (-F.col("seq")).alias("s"), "leader_id")))
    return updates.groupBy("shard_id").agg(replicas.alias("r"), leader.alias("l")).select(
        "shard_id", F.coalesce("r.config_index", F.lit(0)).alias("config_index"), "r.replicas", F.coalesce("l.leader_id", F.lit(0)).alias("leader_id"), F.coalesce("l.term", F.lit(0)).alias("term"))


def route(messages: DataFrame, local: DataFrame) -> DataFrame:
    """Messages with delivered: their shard is here and its replica is the addressee."""
    here = local.select("shard_id", F.col("replica_id").alias("own"))
    return messages.join(here, "shard_id", "left").withColumn("delivered", F.coalesce(F.col("own") == F.col("to"), F.lit(False))).drop("own")


def resolve(wanted: DataFrame, hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Two lookups: (shard, replica) to host, host to address; null where unknown."""
    return wanted.join(hosts, ["shard_id", "replica_id"], "left").join(addresses, "host_id", "left").select("shard_id", "replica_id", "host_id", "address")
