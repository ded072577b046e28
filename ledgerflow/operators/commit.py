"""Quorum commit, votes, liveness and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quorum


def quorum_index(progress: DataFrame) -> DataFrame:
    """Index that a quorum of each shard's voters and witnesses has: the match at place n - quorum in ascending order."""
    found = progress.where("role <> 'non_voting'").groupBy("shard_id").agg(F.sort_array(F.collect_list("match")).alias("m"))  # a shard has a handful of replicas
    n = F.size("m")
    return found.select("shard_id", F.get("m", (n - quorum(n)).cast("int")).alias("quorum_idx"))


def commit(progress: DataFrame, log: DataFrame) -> DataFrame:
    """(shard_id, commit): the quorum index where its entry has the shard's current term, else 0."""
    current = log.groupBy("shard_id").agg(F.max("term").alias("current"))
    wanted = quorum_index(progress)
    # an inner join lets Spark broadcast the few wanted entries instead of shuffling the log; the left join is of shards
    found = log.select("shard_id", F.col("idx").alias("quorum_idx"), "term").join(wanted, ["shard_id", "quorum_idx"])
    at = wanted.join(found, ["shard_id", "quorum_idx"], "left").join(current, "shard_id")
    return at.select("shard_id", "quorum_idx", F.when(F.col("term") == F.col("current"), F.col("quorum_idx")).otherwise(0).alias("commit"))


def count_votes(responses: DataFrame, voters: int) -> DataFrame:
    """Outcome of elections: each voter's first response counts; won and lost at a quorum."""
    first = responses.withColumn("_at", F.row_number().over(Window.partitionBy("shard_id", "term", "voter").orderBy("seq"))).where("_at = 1")
    counted = first.groupBy("shard_id", "term").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("rejected"))
    need = voters // 2 + 1
    return counted.withColumn("outcome", F.when(F.col("granted") >= need, "won").when(F.col("rejected") >= need, "lost").otherwise("open"))


def has_quorum(activity: DataFrame) -> DataFrame:
    """Whether the active voters of each window of each shard are a quorum; a leader is active to itself."""
    return activity.groupBy("shard_id", "window_id").agg(F.count_if(F.col("active") | F.col("leader")).alias("active"), F.count("*").alias("voters")).withColumn("has_quorum", F.col("active") >= quorum(F.col("voters")))


def committed_marks(updates: DataFrame) -> DataFrame:
    """Monotone commit index over a sequence of updates, and whether an update was beyond the log."""
    w = Window.partitionBy("shard_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return updates.select("shard_id", "seq", F.max("value").over(w).alias("commit"), (F.col("value") > F.col("last_idx")).alias("beyond_log"))


def mark_faults(updates: DataFrame) -> DataFrame:
    """Updates whose marks are out of order: applied <= processed <= commit must hold, and none may fall."""
    order = Window.partitionBy("shard_id").orderBy("seq")
    fault = F.when(F.col("applied") > F.col("processed"), "applied_beyond_processed").when(F.col("processed") > F.col("commit"), "processed_beyond_commit").when(F.lag("applied").over(order) > F.col("applied"), "applied_fell")
    return updates.select("shard_id", "seq", fault.alias("fault")).where("fault is not null")


def progress_marks(acks: DataFrame) -> DataFrame:
    """match and next of each follower after each acknowledgement; neither falls."""
    w = Window.partitionBy("shard_id", "replica_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return acks.select("shard_id", "replica_id", "seq", F.max("idx").over(w).alias("match"), (F.max("idx").over(w) + 1).alias("next"))


def release_reads(requests: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Time and index at which queued reads are released.

    A confirmed read releases all before it in the queue, with its own index: each takes the
    earliest confirmation among the places from its own on.
    """
    w = Window.partitionBy("shard_id").orderBy(F.desc("queue_pos")).rowsBetween(Window.unboundedPreceding, 0)  # a running minimum from the queue's end
    rows = requests.join(confirmations, ["shard_id", "queue_pos"], "left")
    best = F.min(F.when(F.col("confirm_time").isNotNull(), F.struct("confirm_time", "read_idx"))).over(w)
    return rows.select("shard_id", "queue_pos", best.getField("confirm_time").alias("released_at"), best.getField("read_idx").alias("released_idx"))


def complete_reads(reads: DataFrame, applied: DataFrame) -> DataFrame:
    """As-of completion: a read ends at the first time the applied index reaches its own, or times out.

    Reads and applied marks are one stream in index order; the next mark at or after a read is its
    completion. One window by shard, no inequality join.
    """
    marks = applied.select("shard_id", F.col("applied").alias("at_idx"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("read_id"), F.lit(None).cast("long").alias("deadline"), F.col("tick").alias("mark"))
    asks = reads.select("shard_id", F.col("read_idx").alias("at_idx"), F.lit(0).alias("kind"), "read_id", "deadline", F.lit(None).cast("long").alias("mark"))
    w = Window.partitionBy("shard_id").orderBy(F.desc("at_idx"), F.desc("kind"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    found = asks.unionByName(marks).withColumn("done", F.min("mark").over(w)).where("kind = 0")
    code = F.when(F.col("done").isNull(), "pending").when(F.col("deadline") > F.col("done"), "completed").otherwise("timeout")
    return found.select("shard_id", "read_id", F.col("done").alias("tick"), code.alias("code"))


def match_proposals(pending: DataFrame, applied: DataFrame, now: int) -> DataFrame:
    """Pending proposals with the result of their applied entry; expired ones time out, others wait."""
    keys = ["shard_id", "key", "client_id", "series_id"]
    rows = pending.join(applied.select(*keys, F.col("idx").alias("result_idx"), "rejected"), keys, "left")
    code = F.when(F.col("deadline") < now, "timeout").when(F.col("result_idx").isNull(), "pending").when(F.col("rejected"), "rejected").otherwise("completed")
    return rows.select(*keys, code.alias("code"), F.when(code.isin("completed", "rejected"), F.col("result_idx")).alias("result_idx"))
