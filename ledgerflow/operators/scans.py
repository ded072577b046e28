"""Scans over logs: ranges, byte budgets, bounds, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import batch_id

ENTRY_BYTES = 24


def _order() -> Window:
    return Window.partitionBy("shard_id").orderBy("idx")


def entry_size() -> Column:
    return F.col("cmd_len") + ENTRY_BYTES


def range_scan(log: DataFrame, low: int, high: int) -> DataFrame:
    """Entries with index in [low, high); the range reaches the Parquet scan."""
    return log.where((F.col("idx") >= low) & (F.col("idx") < high))


def contiguous(rows: DataFrame) -> DataFrame:
    """Each shard's entries up to the first hole."""
    first = F.min("idx").over(Window.partitionBy("shard_id"))
    return rows.withColumn("_gap", F.col("idx") - F.row_number().over(_order()) - first + 1).where("_gap = 0").drop("_gap")


def limit_size(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Prefix of each shard within a byte budget: stops before the budget is exceeded, but keeps the first entry."""
    seen = F.sum(entry_size()).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).withColumn("_at", F.row_number().over(_order())).where((F.col("_seen") <= max_bytes) | (F.col("_at") == 1)).drop("_seen", "_at")


def storage_limit(rows: DataFrame, max_bytes: int) -> DataFrame:
    """The same with the stores' rule: the entry that crosses the budget is still returned."""
    before = F.coalesce(F.sum(entry_size()).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") <= max_bytes).drop("_before")


def bounds(log: DataFrame) -> DataFrame:
    """First and last index, count and last term of each shard; length counts the range, not the rows."""
    return log.groupBy("shard_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max_by("term", "idx").alias("last_term"), F.count("*").alias("n_rows")).withColumn("length", F.col("last_idx") - F.col("first_idx") + 1)


def check_bound(requests: DataFrame, log_bounds: DataFrame) -> DataFrame:
    """Status of each requested range: ok, invalid, compacted or unavailable."""
    status = (F.when(F.col("low") > F.col("high"), "invalid").when(F.col("low") < F.col("first_idx"), "compacted")
              .when(F.col("high") > F.col("last_idx") + 1, "unavailable").otherwise("ok"))
    return requests.join(log_bounds.select("shard_id", "first_idx", "last_idx"), "shard_id").withColumn("status", status)


def query_log(log: DataFrame, commits: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """Committed entries in [low, high) of each shard within the storage budget, high clamped to commit + 1."""
    rows = range_scan(log, low, high).join(commits, "shard_id").where("idx <= commit").drop("commit")
    return storage_limit(rows, max_bytes)


def query_status(log_bounds: DataFrame, commits: DataFrame, low: int, high: int) -> DataFrame:
    """Result code of a log query for each shard and the range that is available."""
    rows = log_bounds.join(commits, "shard_id")
    code = F.when(F.lit(high) <= F.lit(low), "invalid_range").when((F.lit(low) < F.col("first_idx")) | (F.lit(low) > F.col("commit")), "out_of_range").otherwise("completed")
    return rows.select("shard_id", code.alias("code"), F.col("first_idx").alias("first"), (F.col("commit") + 1).alias("last"))


def terms_of(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Term of (shard, index) pairs; 0 where the log lacks the entry."""
    keys = ["shard_id", "idx"]
    found = log.select(*keys, "term").join(wanted.select(*keys).distinct(), keys)  # the wanted side may be broadcast, the log needn't move
    return wanted.join(found, keys, "left").withColumn("term", F.coalesce("term", F.lit(0)))


def batches(log: DataFrame) -> DataFrame:
    """Entries grouped as stored batches."""
    return log.groupBy("shard_id", batch_id(F.col("idx")).alias("batch_id")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum(entry_size()).alias("bytes"))


def node_infos(progress: DataFrame) -> DataFrame:
    """Replicas that are known of."""
    return progress.select("shard_id", "replica_id").distinct()


def newest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot record of each shard, or of each replica where the records name one."""
    keys = [c for c in ("shard_id", "replica_id") if c in snapshots.columns]
    rest = [c for c in snapshots.columns if c not in (*keys, "idx")]
    return snapshots.groupBy(*keys).agg(F.max("idx").alias("_newest"), F.max_by(F.struct(*rest), "idx").alias("_x")).select(*keys, F.col("_newest").alias("idx"), *(F.col(f"_x.{c}").alias(c) for c in rest))


def compacted(log: DataFrame, low_water: DataFrame) -> DataFrame:
    """The log without what lies at or below each shard's low-water mark."""
    return log.join(low_water, "shard_id").where("idx > low_water").drop("low_water")


def raft_state(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First index and entry count of each shard's tail after its newest snapshot."""
    newest = snapshots.groupBy("shard_id").agg(F.max("idx").alias("snapshot_idx"))
    return log.join(newest, "shard_id").where("idx > snapshot_idx").groupBy("shard_id").agg(F.min("idx").alias("first_idx"), F.count("*").alias("entry_count"), F.max("snapshot_idx").alias("snapshot_idx"))


def hard_states(tails: DataFrame, states: DataFrame) -> DataFrame:
    """Tails with each replica's stored term, vote and commit; a shard without entries after its snapshot has none to read."""
    return states.join(tails, "shard_id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))


def restore_batches(batches_: DataFrame) -> DataFrame:
    """Entries of compacted batches (shard_id, first_idx, term, payloads): index by position, the first one's term."""
    rows = batches_.select("shard_id", "first_idx", "term", F.posexplode("payloads").alias("_at", "payload"))
    return rows.select("shard_id", (F.col("first_idx") + F.col("_at")).alias("idx"), "term", "payload")


def snapshots_upto(snapshots: DataFrame, upto: DataFrame) -> DataFrame:
    """Snapshot records of each shard up to an index."""
    return snapshots.join(upto, "shard_id").where("idx <= upto").drop("upto")


def splice(stored: DataFrame, tail: DataFrame) -> DataFrame:
    """Stored log with the in-memory tail on top: a tail entry and all after its first index replace stored ones."""
    cut = tail.groupBy("shard_id").agg(F.min("idx").alias("_cut"))
    kept = stored.join(cut, "shard_id", "left").where("_cut is null or idx < _cut").drop("_cut")
    return kept.unionByName(tail)


def violations(log: DataFrame) -> DataFrame:
    """Entries that break the order: an index that is not the next one, or a term that falls."""
    rows = log.select("shard_id", "idx", "term", F.lag("idx").over(_order()).alias("before_idx"), F.lag("term").over(_order()).alias("before_term"))
    return rows.where("idx <> before_idx + 1 or term < before_term")


def entries_to_apply(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Entries above each shard's applied index."""
    return log.join(applied, "shard_id").where("idx > applied").drop("applied")


def apply_faults(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Shards whose entries can't be applied: ``hole`` where the first one leaves a gap after the applied index, ``old`` where all are applied already."""
    ends = log.groupBy("shard_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).join(applied, "shard_id")
    fault = F.when(F.col("first_idx") > F.col("applied") + 1, "hole").when(F.col("last_idx") <= F.col("applied"), "old")
    return ends.withColumn("fault", fault).where("fault is not null")
