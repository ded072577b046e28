"""Log tables: from a Parquet layout of the engine, or derived from event tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerflow-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_log(log: DataFrame, path: str, buckets: int = 64) -> None:
    """Append a log in the layout that ``read_log`` prunes: a folder for each bucket of shards, rows by shard and index in its files."""
    rows = log.withColumn("bucket", F.pmod("shard_id", F.lit(buckets)))
    rows.repartition("bucket").sortWithinPartitions("shard_id", "idx").write.mode("append").partitionBy("bucket").parquet(path)


def read_log(spark: SparkSession, path: str, shard_id: int | None = None, buckets: int = 64) -> DataFrame:
    """A stored log; with a shard the bucket partition and the row groups' index ranges are pruned."""
    log = spark.read.parquet(path)  # a shard's bucket and row groups are all that is read
    return log if shard_id is None else log.where((F.col("bucket") == shard_id % buckets) & (F.col("shard_id") == shard_id))


def events_log(events: DataFrame, shards: int = 8) -> DataFrame:
    """The log of an event table: one shard for each residue of the user, a dense index in event order.

    The window deals rows by shard, which is the unit of ordering: real logs have many shards.
    """
    by_shard = Window.partitionBy("shard_id").orderBy("event_id")
    by_client = Window.partitionBy("client_id").orderBy("event_id")
    rows = events.select(
        (F.col("user_id") % shards).alias("shard_id"), F.day("ts").cast("long").alias("term"), F.col("event_id").alias("key"), F.col("user_id").alias("client_id"),
        F.col("event_id"), F.col("event_type").alias("k"), F.col("value").alias("v"), entry_type(F.col("event_id")).alias("type"), (F.col("event_id") % 5 * 16).alias("cmd_len"))
    series = F.row_number().over(by_client).cast("long")
    return rows.select("*", F.row_number().over(by_shard).cast("long").alias("idx"), series.alias("series_id")).select(
        "*", F.greatest(F.col("series_id") - 3, F.lit(0)).cast("long").alias("responded_to"))


def entry_type(event_id: Column) -> Column:
    return F.when(event_id % 10 == 0, "ConfigChange").when(event_id % 10 == 1, "Metadata").when(event_id % 10 < 5, "Encoded").otherwise("Application")


#: The same derivation for the oracle.
LOG_SQL = """log AS (
  SELECT user_id % 8 AS shard_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id)::BIGINT AS idx, extract(day FROM ts)::BIGINT AS term,
         user_id AS client_id, event_id, event_id AS key, event_type AS k, value AS v,
         CASE WHEN event_id % 10 = 0 THEN 'ConfigChange' WHEN event_id % 10 = 1 THEN 'Metadata' WHEN event_id % 10 < 5 THEN 'Encoded' ELSE 'Application' END AS type,
         event_id % 5 * 16 AS cmd_len, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS series_id,
         greatest(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 3, 0)::BIGINT AS responded_to FROM events)"""


def events_progress(log: DataFrame) -> DataFrame:
    """Highest index that each of five replicas acknowledged (three voters, a witness, a non-voting one); one that acknowledged nothing has 0."""
    replicas = F.explode(F.array(*(F.lit(r).cast("long") for r in range(5))))
    acked = F.when(F.col("key") % 7 >= F.col("replica_id") * 2 % 7, F.col("idx")).otherwise(0)
    role = F.when(F.col("replica_id") < 3, "voter").when(F.col("replica_id") == 3, "witness").otherwise("non_voting")
    return log.select("shard_id", "key", "idx", replicas.alias("replica_id")).groupBy("shard_id", "replica_id", role.alias("role")).agg(F.max(acked).alias("match"))


PROGRESS_SQL = """progress AS (SELECT shard_id, r::BIGINT AS replica_id, CASE WHEN r < 3 THEN 'voter' WHEN r = 3 THEN 'witness' ELSE 'non_voting' END AS role,
  max(CASE WHEN key % 7 >= r * 2 % 7 THEN idx ELSE 0 END)::BIGINT AS match FROM log, range(5) AS t(r) GROUP BY ALL)"""
