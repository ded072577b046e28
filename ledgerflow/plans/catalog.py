"""Registered queries over the driver's tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import commit, membership, messages, overwrite, scans, sessions
from ..sources.tables import LOG_SQL, PROGRESS_SQL, events_log, events_progress, read, read_log, shared_folder, write_log
from ..streaming import queries as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, log: bool = True):
    """Register a function of (log, read) as a query; ``sql`` continues a WITH clause that has ``log`` and ``progress``."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(events_log(read(spark, sf_dir, "events")) if log else None, lambda name: read(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = f"WITH {LOG_SQL}, {PROGRESS_SQL} {sql}" if log else sql
        return f

    return add


def _shards(log: DataFrame) -> DataFrame:
    return log.select("shard_id").distinct()


def _half(log: DataFrame) -> DataFrame:
    """A commit index for each shard: half of its log."""
    return log.groupBy("shard_id").agg(F.floor(F.max("idx") / 2).cast("long").alias("commit"))


HALF = "half AS (SELECT shard_id, (max(idx) // 2)::BIGINT AS commit FROM log GROUP BY 1)"


@query(f""", q AS (SELECT shard_id, list_sort(list(match) FILTER (role <> 'non_voting'))[2] AS quorum_idx FROM progress GROUP BY 1),
  c AS (SELECT q.shard_id, CASE WHEN l.term = (SELECT max(term) FROM log x WHERE x.shard_id = q.shard_id) THEN quorum_idx ELSE 0 END AS commit FROM q LEFT JOIN log l ON l.shard_id = q.shard_id AND l.idx = quorum_idx)
  SELECT log.shard_id, k, arg_max(v, idx) AS v, count(*) AS n, max(idx) AS last_idx FROM log JOIN c ON c.shard_id = log.shard_id WHERE idx <= commit GROUP BY ALL""")
def state_at_commit(log, table):
    commits = commit.commit(events_progress(log), log).select("shard_id", "commit")
    return sessions.kv_state(log.join(commits, "shard_id").where("idx <= commit"))


@query("SELECT shard_id, k, arg_max(v, idx) AS v, count(*) AS n, max(idx) AS last_idx FROM log GROUP BY ALL")
def kv_state(log, table):
    return sessions.kv_state(log)


@query("SELECT shard_id, idx, term, key FROM log WHERE idx >= 100 AND idx < 300")
def log_range(log, table):
    return scans.range_scan(log, 100, 300).select("shard_id", "idx", "term", "key")


@query("""SELECT shard_id, idx FROM (SELECT shard_id, idx, sum(cmd_len + 24) OVER w AS seen, row_number() OVER w AS place FROM log WHERE idx >= 10
  WINDOW w AS (PARTITION BY shard_id ORDER BY idx)) WHERE seen <= 4000 OR place = 1""")
def limit_size(log, table):
    return scans.limit_size(log.where("idx >= 10"), 4000).select("shard_id", "idx")


@query("""SELECT shard_id, idx FROM (SELECT shard_id, idx, coalesce(sum(cmd_len + 24) OVER (PARTITION BY shard_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM log WHERE idx >= 10) WHERE seen <= 4000""")
def storage_limit(log, table):
    return scans.storage_limit(log.where("idx >= 10"), 4000).select("shard_id", "idx")


@query(f""", {HALF} SELECT shard_id, idx, term, key FROM (SELECT log.*, coalesce(sum(cmd_len + 24) OVER (PARTITION BY log.shard_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM log JOIN half USING (shard_id) WHERE idx >= 20 AND idx < 100000 AND idx <= commit) WHERE seen <= 10000""")
def query_log(log, table):
    return scans.query_log(log, _half(log), 20, 100_000, 10_000).select("shard_id", "idx", "term", "key")


@query(f""", {HALF} SELECT h.shard_id, CASE WHEN 700 > commit OR 700 < min(idx) THEN 'out_of_range' ELSE 'completed' END AS code, min(idx) AS first, commit + 1 AS last
  FROM half h JOIN log USING (shard_id) GROUP BY h.shard_id, commit""")
def query_log_status(log, table):
    return scans.query_status(scans.bounds(log), _half(log), 700, 900)


@query("SELECT shard_id, min(idx) AS first_idx, max(idx) AS last_idx, arg_max(term, idx) AS last_term, count(*) AS n_rows, max(idx) - min(idx) + 1 AS length FROM log GROUP BY 1")
def log_bounds(log, table):
    return scans.bounds(log)


@query("""SELECT l.shard_id, l.low, l.high, b.first_idx, b.last_idx, CASE WHEN low > high THEN 'invalid' WHEN low < first_idx THEN 'compacted' WHEN high > last_idx + 1 THEN 'unavailable' ELSE 'ok' END AS status
  FROM (SELECT shard_id, idx - 50 AS low, idx * 2 - 100 AS high FROM log) l JOIN (SELECT shard_id, min(idx) AS first_idx, max(idx) AS last_idx FROM log GROUP BY 1) b USING (shard_id)""")
def check_bounds(log, table):
    return scans.check_bound(log.select("shard_id", (F.col("idx") - 50).alias("low"), (F.col("idx") * 2 - 100).alias("high")), scans.bounds(log))


@query("""SELECT shard_id, idx FROM (SELECT shard_id, idx, idx - row_number() OVER (PARTITION BY shard_id ORDER BY idx) - min(idx) OVER (PARTITION BY shard_id) + 1 AS gap FROM log WHERE idx % 97 <> 5) WHERE gap = 0""")
def scan_to_first_hole(log, table):
    return scans.contiguous(log.where("idx % 97 <> 5")).select("shard_id", "idx")


@query("SELECT w.shard_id, w.idx, coalesce(l.term, 0) AS term FROM (SELECT shard_id, idx * 2 AS idx FROM log) w LEFT JOIN log l ON l.shard_id = w.shard_id AND l.idx = w.idx")
def terms_of_entries(log, table):
    return scans.terms_of(log, log.select("shard_id", (F.col("idx") * 2).alias("idx"))).select("shard_id", "idx", "term")


@query("SELECT shard_id, idx // 48 AS batch_id, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, sum(cmd_len + 24)::BIGINT AS bytes FROM log GROUP BY ALL")
def entry_batches(log, table):
    return scans.batches(log)


@query("SELECT shard_id, idx AS low, idx + 37 AS high, idx // 48 AS first_batch, CASE WHEN (idx + 37) % 48 = 0 THEN (idx + 37) // 48 ELSE (idx + 37) // 48 + 1 END AS end_batch FROM log")
def batch_id_ranges(log, table):
    low, high = scalars.batch_range(F.col("idx"), F.col("idx") + 37)
    return log.select("shard_id", F.col("idx").alias("low"), (F.col("idx") + 37).alias("high"), low.alias("first_batch"), high.cast("long").alias("end_batch"))


@query(""", s AS (SELECT shard_id, max(idx) AS snapshot_idx FROM log WHERE k = 'purchase' GROUP BY 1)
  SELECT shard_id, min(idx) AS first_idx, count(*) AS entry_count, max(snapshot_idx) AS snapshot_idx FROM log JOIN s USING (shard_id) WHERE idx > snapshot_idx GROUP BY 1""")
def raft_state(log, table):
    return scans.raft_state(log, log.where("k = 'purchase'").select("shard_id", "idx"))


@query("SELECT DISTINCT shard_id, replica_id FROM progress")
def node_info(log, table):
    return scans.node_infos(events_progress(log))


@query(""", s AS (SELECT shard_id, idx, term, idx * 10 AS size FROM log WHERE k = 'purchase') SELECT shard_id, max(idx) AS idx, arg_max(term, idx) AS term, arg_max(size, idx) AS size FROM s GROUP BY 1""")
def newest_snapshot(log, table):
    return scans.newest_snapshots(log.where("k = 'purchase'").select("shard_id", "idx", "term", (F.col("idx") * 10).alias("size")))


@query(f""", {HALF} SELECT shard_id, idx, CASE WHEN idx > commit THEN term + 1 ELSE term END AS term, CASE WHEN idx > commit THEN 1 ELSE 0 END AS tail FROM log JOIN half USING (shard_id)""")
def splice_tail(log, table):
    marked = log.join(_half(log), "shard_id")
    stored = marked.where("idx <= commit + 10").select("shard_id", "idx", "term", F.lit(0).alias("tail"))
    return scans.splice(stored, marked.where("idx > commit").select("shard_id", "idx", (F.col("term") + 1).alias("term"), F.lit(1).alias("tail")))


@query("""SELECT shard_id, idx, term, before_idx, before_term FROM (SELECT shard_id, idx, term, lag(idx) OVER w AS before_idx, lag(term) OVER w AS before_term
  FROM (SELECT shard_id, idx, CASE WHEN idx % 50 = 0 THEN 0 ELSE term END AS term FROM log WHERE idx % 97 <> 5) WINDOW w AS (PARTITION BY shard_id ORDER BY idx)) WHERE idx <> before_idx + 1 OR term < before_term""")
def order_violations(log, table):
    return scans.violations(log.where("idx % 97 <> 5").withColumn("term", F.when(F.col("idx") % 50 == 0, 0).otherwise(F.col("term"))))


@query(f""", {HALF} SELECT shard_id, idx, key FROM log JOIN half USING (shard_id) WHERE idx > commit""")
def entries_to_apply(log, table):
    return scans.entries_to_apply(log, _half(log).withColumnRenamed("commit", "applied")).select("shard_id", "idx", "key")


@query("""SELECT shard_id, count(*) FILTER (type IN ('Application', 'Encoded', 'Metadata')) AS proposals, count(*) FILTER (type = 'ConfigChange') AS config_changes,
  count(*) FILTER (type <> 'ConfigChange' AND client_id <> 0) AS session_managed, count(*) FILTER (type <> 'ConfigChange' AND client_id = 0 AND cmd_len = 0) AS empty, sum(cmd_len + 24)::BIGINT AS bytes,
  bool_and(series_id = 0) AS all_noop FROM log GROUP BY 1""")
def entry_classes(log, table):
    return log.groupBy("shard_id").agg(
        F.count_if(scalars.is_proposal()).alias("proposals"), F.count_if(scalars.is_config_change()).alias("config_changes"), F.count_if(scalars.is_session_managed()).alias("session_managed"),
        F.count_if(scalars.is_empty()).alias("empty"), F.sum(scans.entry_size()).alias("bytes"), F.bool_and(F.col("series_id") == 0).alias("all_noop"))


@query("""SELECT key, CASE WHEN type = 'ConfigChange' THEN 'config' WHEN client_id % 5 = 0 THEN 'noop' WHEN cmd_len = 0 AND series_id = 1 THEN 'register' WHEN cmd_len = 0 AND series_id = 2 THEN 'unregister' ELSE 'update' END AS kind FROM log""")
def entry_kinds(log, table):
    series = F.when(F.col("series_id") == 1, -2).when(F.col("series_id") == 2, -1).otherwise(F.col("series_id"))
    return log.withColumn("client_id", F.when(F.col("client_id") % 5 == 0, 0).otherwise(F.col("client_id"))).withColumn("series_id", series).select("key", scalars.entry_kind().alias("kind"))


@query("SELECT shard_id, idx, CASE WHEN type = 'ConfigChange' THEN type ELSE 'Metadata' END AS type, term, CASE WHEN type = 'ConfigChange' THEN key ELSE 0 END AS key FROM log")
def witness_entries(log, table):
    return messages.witness_entries(log)


@query("""SELECT a.shard_id, a.idx, b.idx AS other, (a.term > b.term OR (a.term = b.term AND a.idx >= b.idx)) AS up_to_date, (a.key % 3 = 0 OR a.key % 3 = b.key % 3 OR a.term > b.term) AS can_grant
  FROM log a JOIN log b ON a.shard_id = b.shard_id AND a.idx = 3 * b.idx""")
def vote_predicates(log, table):
    other = log.select("shard_id", (F.col("idx") * 3).alias("idx"), F.col("idx").alias("other"), F.col("term").alias("own_term"), (F.col("key") % 3).alias("candidate"))
    return log.join(other, ["shard_id", "idx"]).select("shard_id", "idx", "other", scalars.up_to_date(F.col("term"), F.col("idx"), F.col("own_term"), F.col("other")).alias("up_to_date"), scalars.can_grant_vote(F.col("key") % 3, F.col("candidate"), F.col("term"), F.col("own_term")).alias("can_grant"))


@query("SELECT shard_id, list_sort(list(match) FILTER (role <> 'non_voting'))[2] AS quorum_idx FROM progress GROUP BY 1")
def quorum_index(log, table):
    return commit.quorum_index(events_progress(log))


@query(""", q AS (SELECT shard_id, list_sort(list(match) FILTER (role <> 'non_voting'))[2] AS quorum_idx FROM progress GROUP BY 1)
  SELECT q.shard_id, quorum_idx, CASE WHEN l.term = (SELECT max(term) FROM log x WHERE x.shard_id = q.shard_id) THEN quorum_idx ELSE 0 END AS commit FROM q LEFT JOIN log l ON l.shard_id = q.shard_id AND l.idx = quorum_idx""")
def quorum_commit(log, table):
    return commit.commit(events_progress(log), log)


VOTES = """votes AS (SELECT shard_id, term, client_id % 5 AS voter, idx AS seq, key % 3 <> 0 AS granted FROM log)"""


@query(f""", {VOTES}, f AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY shard_id, term, voter ORDER BY seq) = 1)
  SELECT shard_id, term, count(*) FILTER (granted) AS granted, count(*) FILTER (NOT granted) AS rejected,
  CASE WHEN count(*) FILTER (granted) >= 3 THEN 'won' WHEN count(*) FILTER (NOT granted) >= 3 THEN 'lost' ELSE 'open' END AS outcome FROM f GROUP BY ALL""")
def election_outcomes(log, table):
    votes = log.select("shard_id", "term", (F.col("client_id") % 5).alias("voter"), F.col("idx").alias("seq"), (F.col("key") % 3 != 0).alias("granted"))
    return commit.count_votes(votes, 5)


@query("""SELECT shard_id, term AS window_id, count(*) FILTER (active) AS active, count(*) AS voters, count(*) FILTER (active) >= count(*) // 2 + 1 AS has_quorum
  FROM (SELECT shard_id, term, client_id, bool_or(key % 4 = 0 OR client_id % 10 = 7) AS active FROM log GROUP BY ALL) GROUP BY ALL""")
def check_quorum(log, table):
    seen = log.groupBy("shard_id", F.col("term").alias("window_id"), "client_id").agg(F.bool_or(F.col("key") % 4 == 0).alias("active"))
    return commit.has_quorum(seen.withColumn("leader", F.col("client_id") % 10 == 7))


@query("""SELECT shard_id, idx AS seq, max(key % 1000) OVER (PARTITION BY shard_id ORDER BY idx) AS commit, key % 1000 > 900 AS beyond_log FROM log""")
def commit_marks(log, table):
    return commit.committed_marks(log.select("shard_id", F.col("idx").alias("seq"), (F.col("key") % 1000).alias("value"), F.lit(900).alias("last_idx")))


@query("""SELECT shard_id, client_id % 3 AS replica_id, idx AS seq, max(idx - key % 7) OVER w AS match, max(idx - key % 7) OVER w + 1 AS next FROM log WINDOW w AS (PARTITION BY shard_id, client_id % 3 ORDER BY idx)""")
def replica_progress(log, table):
    return commit.progress_marks(log.select("shard_id", (F.col("client_id") % 3).alias("replica_id"), F.col("idx").alias("seq"), (F.col("idx") - F.col("key") % 7).alias("idx")))


#: A confirmation's time and index as one number, which the least of a window carries along.
READS = """req AS (SELECT shard_id, idx AS queue_pos, min(CASE WHEN type = 'Encoded' THEN (idx + key % 60) * 1000000000 + idx END) OVER w AS best FROM log
  WINDOW w AS (PARTITION BY shard_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f""", {READS} SELECT shard_id, queue_pos, best // 1000000000 AS released_at, best % 1000000000 AS released_idx FROM req""")
def read_index_release(log, table):
    asks = log.select("shard_id", F.col("idx").alias("queue_pos"), F.col("idx").alias("read_idx"))
    return commit.release_reads(asks, log.where("type = 'Encoded'").select("shard_id", F.col("idx").alias("queue_pos"), (F.col("idx") + F.col("key") % 60).alias("confirm_time")))


@query("""SELECT shard_id, idx AS read_id, tick, CASE WHEN tick IS NULL THEN 'pending' WHEN idx * 2 + key % 40 > tick THEN 'completed' ELSE 'timeout' END AS code
  FROM (SELECT shard_id, idx, key, min(CASE WHEN type = 'ConfigChange' THEN idx * 2 END) OVER (PARTITION BY shard_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tick FROM log)""")
def read_completion(log, table):
    asks = log.select("shard_id", F.col("idx").alias("read_id"), F.col("idx").alias("read_idx"), (F.col("idx") * 2 + F.col("key") % 40).alias("deadline"))
    return commit.complete_reads(asks, log.where("type = 'ConfigChange'").select("shard_id", F.col("idx").alias("applied"), (F.col("idx") * 2).alias("tick")))


@query("""SELECT p.shard_id, p.key, p.client_id, p.series_id, CASE WHEN p.idx % 11 = 0 THEN 'timeout' WHEN a.idx IS NULL THEN 'pending' WHEN a.type = 'Metadata' THEN 'rejected' ELSE 'completed' END AS code,
  CASE WHEN p.idx % 11 <> 0 THEN a.idx END AS result_idx FROM log p LEFT JOIN (SELECT * FROM log WHERE type <> 'Application') a USING (shard_id, key, client_id, series_id)""")
def proposal_results(log, table):
    keys = ["shard_id", "key", "client_id", "series_id"]
    pending = log.select(*keys, F.when(F.col("idx") % 11 == 0, 5).otherwise(50).alias("deadline"))
    return commit.match_proposals(pending, log.where("type <> 'Application'").select(*keys, "idx", (F.col("type") == "Metadata").alias("rejected")), 10)


APPENDS = """appends AS (SELECT shard_id, idx AS seq, idx * 5 - (key % 4) * 6 + 30 AS start, 8 + key % 5 AS n, term FROM log)"""


def _appends(log: DataFrame) -> DataFrame:
    return log.select("shard_id", F.col("idx").alias("seq"), (F.col("idx") * 5 - (F.col("key") % 4) * 6 + 30).alias("start"), (8 + F.col("key") % 5).alias("n"), "term")


@query(f""", {APPENDS}, cut AS (SELECT *, least(start + n, coalesce(min(start) OVER (PARTITION BY shard_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), start + n)) AS live_end FROM appends)
  SELECT shard_id, i::BIGINT AS idx, term, seq FROM cut, unnest(range(start, live_end)) AS t(i)""")
def log_overwrite(log, table):
    return overwrite.live_entries(_appends(log))


@query("""SELECT i.shard_id, min(i.idx) AS conflict_idx FROM (SELECT shard_id, idx, CASE WHEN idx >= 100 + shard_id THEN term + 1 ELSE term END AS term FROM log) i ANTI JOIN log l USING (shard_id, idx, term) GROUP BY 1""")
def conflict_index(log, table):
    return overwrite.conflict_index(log, log.select("shard_id", "idx", F.when(F.col("idx") >= 100 + F.col("shard_id"), F.col("term") + 1).otherwise(F.col("term")).alias("term")))


@query(f""", {APPENDS}, e AS (SELECT shard_id, seq, start, least(start + n - 1, coalesce(min(start) OVER (PARTITION BY shard_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, start + n - 1)) AS "end", seq // 20 AS file FROM appends),
  m AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = start AND lag(file) OVER w = file THEN 0 ELSE 1 END AS new FROM e WHERE "end" >= start WINDOW w AS (PARTITION BY shard_id ORDER BY start)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY shard_id ORDER BY start) AS island FROM m) SELECT shard_id, min(start) AS start, max("end") AS "end", min(file) AS file FROM g GROUP BY shard_id, island""")
def extent_overlay(log, table):
    rows = _appends(log).select("shard_id", "seq", "start", (F.col("start") + F.col("n") - 1).alias("end"), F.floor(F.col("seq") / 20).alias("file"))
    return overwrite.overlay_extents(rows)


@query("SELECT shard_id, idx // 20 AS file FROM log GROUP BY ALL HAVING max(key % 9) < 8")
def obsolete_files(log, table):
    files = log.select("shard_id", F.floor(F.col("idx") / 20).alias("file"), "key")
    return overwrite.obsolete_files(files.select("shard_id", "file").distinct(), files.where("key % 9 = 8"))


@query("SELECT coalesce(a.client_id, b.client_id) AS shard_id, CASE WHEN a.client_id IS NULL THEN 'loaded' WHEN b.client_id IS NULL THEN 'offloaded' ELSE 'kept' END AS change FROM (SELECT DISTINCT client_id FROM log WHERE client_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT client_id FROM log WHERE client_id % 4 <> 0) b USING (client_id)")
def shard_changes(log, table):
    clients = log.select(F.col("client_id").alias("shard_id")).distinct()
    return overwrite.shard_diff(clients.where("shard_id % 3 <> 0"), clients.where("shard_id % 4 <> 0"))


@query("""SELECT shard_id, max(ci) AS config_index, arg_max(name, (ci, -seq)) FILTER (ci > 0) AS replicas, coalesce(arg_max(leader, (t, -seq)) FILTER (leader <> 0), 0) AS leader_id, coalesce(max(t) FILTER (leader <> 0), 0) AS term
  FROM (SELECT n_regionkey::BIGINT AS shard_id, n_nationkey AS seq, n_name AS name, (n_nationkey * 7 % 5)::BIGINT AS ci, (n_nationkey % 4)::BIGINT AS leader, (n_nationkey * 3 % 7)::BIGINT AS t FROM nation) GROUP BY 1""", log=False)
def shard_views(log, table):
    n = F.col("n_nationkey").cast("long")
    return overwrite.merge_views(table("nation").select(F.col("n_regionkey").cast("long").alias("shard_id"), n.alias("seq"), F.col("n_name").alias("replicas"), (n * 7 % 5).alias("config_index"), (n % 4).alias("leader_id"), (n * 3 % 7).alias("term")))


@query("SELECT key, shard_id, client_id % 3 AS \"to\", coalesce(client_id % 3 = shard_id % 3 AND shard_id <> 5, false) AS delivered FROM log")
def message_routing(log, table):
    local = _shards(log).where("shard_id <> 5").select("shard_id", (F.col("shard_id") % 3).alias("replica_id"))
    return overwrite.route(log.select("key", "shard_id", (F.col("client_id") % 3).alias("to")), local)


@query("""SELECT w.shard_id, w.replica_id, CASE WHEN w.replica_id < 3 THEN w.shard_id * 10 + w.replica_id END AS host_id, n_name AS address FROM (SELECT DISTINCT shard_id, client_id % 4 AS replica_id FROM log) w
  LEFT JOIN nation ON n_nationkey = w.shard_id * 10 + w.replica_id AND w.replica_id < 3""")
def address_lookup(log, table):
    wanted = log.select("shard_id", (F.col("client_id") % 4).alias("replica_id")).distinct()
    hosts = wanted.where("replica_id < 3").select("shard_id", "replica_id", (F.col("shard_id") * 10 + F.col("replica_id")).alias("host_id"))
    return overwrite.resolve(wanted, hosts, table("nation").select(F.col("n_nationkey").cast("long").alias("host_id"), F.col("n_name").alias("address")))


#: Each client has a session in each of three shards; config changes are tried again, views are outside sessions.
RETRIES = """tries AS (SELECT key % 3 AS shard_id, client_id, CASE WHEN k = 'view' THEN 0 ELSE series_id END AS series_id, responded_to, key * 2 + retry * 41 AS idx FROM log, range(2) AS t(retry) WHERE retry = 0 OR type = 'ConfigChange')"""


def _tries(log: DataFrame) -> DataFrame:
    retry = F.explode(F.when(F.col("type") == "ConfigChange", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("retry")
    series = F.when(F.col("k") == "view", 0).otherwise(F.col("series_id"))
    return log.select("key", "client_id", series.alias("series_id"), "responded_to", retry).select(
        (F.col("key") % 3).alias("shard_id"), "client_id", "series_id", "responded_to", (F.col("key") * 2 + F.col("retry") * 41).alias("idx"))


@query(f""", {RETRIES}, w AS (SELECT *, client_id <> 0 AND series_id <> 0 AS managed, max(CASE WHEN client_id <> 0 AND series_id <> 0 THEN responded_to END) OVER (PARTITION BY shard_id, client_id ORDER BY idx) AS upto FROM tries)
  SELECT shard_id, client_id, series_id, responded_to, idx, CASE WHEN NOT managed THEN 'applied' WHEN NOT series_id > upto THEN 'ignored'
  WHEN count(*) FILTER (series_id > upto) OVER (PARTITION BY shard_id, client_id, series_id ORDER BY idx) > 1 THEN 'cached' ELSE 'applied' END AS outcome FROM w""")
def session_dedup(log, table):
    return sessions.session_outcomes(_tries(log))


@query()
def session_eviction(log, table):
    first = F.row_number().over(Window.partitionBy("shard_id", "client_id").orderBy("idx")) == 1
    rows = _tries(log).withColumn("cmd_len", F.col("series_id") * 3)
    opened = rows.withColumn("_f", first).where("_f").drop("_f").withColumn("idx", F.lit(0) - F.col("client_id") - 1).withColumn("kind", F.lit("register"))
    return sessions.fold_sessions(opened.unionByName(rows.withColumn("kind", F.lit("update"))), capacity=12)


@query("SELECT shard_id, k, arg_max(v, idx) AS v, max(m) AS applied FROM (SELECT *, max(idx) OVER (PARTITION BY shard_id) AS m FROM log) GROUP BY 1, 2")
def user_state_machine(log, table):
    return sessions.run_machine(log, sessions.LastValue)


@query(f""", {HALF} SELECT shard_id, k, arg_max(v, idx) AS v, count(*) AS n, max(idx) AS last_idx FROM log GROUP BY ALL""")
def snapshot_and_tail(log, table):
    cut = log.join(_half(log), "shard_id")
    return sessions.merge_state(sessions.kv_state(cut.where("idx <= commit")), cut.where("idx > commit"))


@query(f""", {HALF} SELECT shard_id, commit AS low_water, count(*) FILTER (idx > commit) AS kept, count(*) FILTER (idx <= commit) AS dropped FROM log JOIN half USING (shard_id) GROUP BY 1, 2""")
def compaction(log, table):
    return log.join(_half(log), "shard_id").groupBy("shard_id", F.col("commit").alias("low_water")).agg(F.count_if(F.col("idx") > F.col("commit")).alias("kept"), F.count_if(F.col("idx") <= F.col("commit")).alias("dropped"))


@query()
def membership_fold(log, table):
    nation = table("nation").join(table("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    kinds = F.array(*(F.lit(x) for x in ("AddNode", "AddNonVoting", "AddWitness", "RemoveNode")))
    key = F.col("s_suppkey")
    return membership.fold_changes(nation.select(
        F.col("n_regionkey").cast("long").alias("shard_id"), key.alias("idx"), F.lit(0).cast("long").alias("config_change_id"), F.get(kinds, (key * 7 % 4).cast("int")).alias("type"),
        (key % 9 + 1).alias("replica_id"), F.format_string("host%d:9000", key % 9 + 1).alias("address"), (key < 3).alias("initialize")))


@query("""SELECT shard_id, count(*) FILTER (k = 'click') AS click, count(*) FILTER (k = 'purchase') AS purchase, count(*) FILTER (k = 'view') AS view, max(term) AS term, arg_max(client_id, idx) AS last_client FROM log GROUP BY 1""")
def event_metrics(log, table):
    return messages.event_metrics(log, ["click", "purchase", "view"])


@query("""SELECT user_id AS shard_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part
  FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 36000 SECOND THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, part""", log=False)
def idle_periods(log, table):
    found = streaming.idle_periods(table("events").select(F.col("user_id").alias("shard_id"), F.col("ts").cast("timestamp").alias("ts")), 36_000)
    first = F.col("start").cast("timestamp_ntz")
    return found.select("shard_id", first.alias("first_ts"), (F.col("end") - F.expr("INTERVAL 36000 SECONDS")).cast("timestamp_ntz").alias("last_ts"), "n")


@query("SELECT conv_id AS shard_id, 0::BIGINT AS replica_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars, true AS complete FROM conversations WHERE text IS NOT NULL GROUP BY 1", log=False)
def chunk_assembly(log, table):
    rows = table("conversations").where("text is not null")
    count = F.count("*").over(Window.partitionBy("conv_id"))
    return streaming.assemble_chunks(rows.select(F.col("conv_id").alias("shard_id"), F.lit(0).cast("long").alias("replica_id"), F.lit(1).cast("long").alias("sender"), F.col("turn").alias("chunk_id"), count.alias("chunk_count"), F.col("turn").alias("seq"), F.col("text").alias("data")))


@query()
def rate_limit(log, table):
    return streaming.rate_limit(log.select("shard_id", F.col("idx").alias("tick"), F.col("v").alias("size")), 60.0)


@query("""SELECT key, lpad(key::VARCHAR, 6, '0') || '.log' AS file, printf('snapshot-%016X', key) AS dir, key AS parsed, key % 8 AS part, key % 16 % 4 AS store, (greatest(length(ltrim(bin(key), '0')), 1) + 6) // 7 AS varint,
  (key % 256) >> 4 AS version, (key % 16) >> 1 AS compression, key % 2 = 1 AS has_session FROM log""")
def scalar_rules(log, table):
    """The file's number is cut to six digits, as the SQL has it; ``scalars.log_file`` keeps all digits (``naming_rules``)."""
    key, byte = F.col("key"), F.col("key") % 256
    file = F.concat(F.lpad(key.cast("string"), 6, "0"), F.lit(".log"))
    return log.select("key", file.alias("file"), scalars.snapshot_dir(key).alias("dir"), scalars.snapshot_index(scalars.snapshot_dir(key)).alias("parsed"), scalars.partition_of(key, 8).alias("part"),
                      scalars.partition_of(key, 16, 4).alias("store"), scalars.varint_bytes(key).alias("varint"), *scalars.header_fields(byte))


@query("""SELECT shard_id, idx, c AS chunk_id, (size + 63) // 64 AS chunk_count, least(64, size - c * 64) AS bytes FROM (SELECT shard_id, idx, cmd_len * 3 + 10 AS size FROM log), unnest(range((size + 63) // 64)) AS t(c)""")
def snapshot_chunks(log, table):
    rows = log.select("shard_id", "idx", F.lit(0).alias("file_id"), (F.col("cmd_len") * 3 + 10).alias("size"))
    return messages.snapshot_chunks(rows, 64).select("shard_id", "idx", "chunk_id", "chunk_count", "bytes")


@query("""SELECT p.shard_id, p.replica_id, p.match + 1 AS next, CASE WHEN p.match + 1 < 50 THEN 'snapshot' ELSE 'replicate' END AS send, coalesce(l.term, 0) AS prev_term, least(p.match, 900) AS heartbeat_commit
  FROM progress p LEFT JOIN log l ON l.shard_id = p.shard_id AND l.idx = p.match""")
def replicate_messages(log, table):
    return messages.replicate_heads(events_progress(log), log, 50, 900)


@query("SELECT p.key FROM log p ANTI JOIN (SELECT DISTINCT client_id, term FROM log WHERE k = 'purchase') l USING (client_id, term) WHERE p.type <> 'ConfigChange'")
def dropped_proposals(log, table):
    led = log.where("k = 'purchase'").select("client_id", "term").distinct()  # the terms in which a node knew its leader
    return log.where(scalars.is_proposal()).join(led, ["client_id", "term"], "left_anti").select("key")


@query("""SELECT shard_id, idx, key FROM (SELECT shard_id, idx, key, k, lag(k) OVER (PARTITION BY client_id ORDER BY idx) AS before FROM log) WHERE before = 'purchase' AND k = 'view'""")
def result_transitions(log, table):
    before = F.lag("k").over(Window.partitionBy("client_id").orderBy("idx"))
    return log.withColumn("before", before).where("before = 'purchase' and k = 'view'").select("shard_id", "idx", "key")


@query("SELECT o_custkey % 16 AS shard_id, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey)::BIGINT AS idx, o_orderkey AS key, (o_custkey % 16) % 4 AS worker FROM orders", log=False)
def orders_log(log, table):
    shard = F.col("o_custkey") % 16
    return table("orders").select(shard.alias("shard_id"), F.row_number().over(Window.partitionBy(shard).orderBy("o_orderkey")).cast("long").alias("idx"), F.col("o_orderkey").alias("key"), scalars.partition_of(shard, 4).alias("worker"))


@query("SELECT (SELECT count(*) FROM log) AS n, 0 AS only_left, 0 AS only_right")
def differential_store(log, table):
    """The log against what the bucketed store gives back, entry by entry."""
    columns = ["shard_id", "idx", "term", "key", "k", "v", "type", "cmd_len"]
    spark, one = log.sparkSession, log.select(*columns)
    path = shared_folder(spark, "stored_log")
    write_log(one, path)
    row = lambda df, side: df.select("shard_id", "idx", F.struct(*columns).alias(side))
    both = row(one, "a").join(row(read_log(spark, path), "b"), ["shard_id", "idx"], "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count("*").alias("n"), F.count_if(~same & F.col("a").isNotNull()).alias("only_left"), F.count_if(~same & F.col("b").isNotNull()).alias("only_right"))


@query("""SELECT shard_id, idx, CASE WHEN c > 0 AND apply > c THEN 'not_committed' WHEN apply > hi THEN 'not_saved' END AS fault,
  snap = 0 AND NOT coalesce(apply BETWEEN lo AND hi, false) AS fast, (term <> before_term OR vote <> before_vote) AS sync
  FROM (SELECT shard_id, idx, term, key % 3 AS vote, idx - key % 4 + 3 AS c, CASE WHEN key % 6 <> 0 THEN idx - key % 5 + 2 END AS apply, CASE WHEN key % 7 <> 0 THEN idx END AS lo,
        CASE WHEN key % 7 <> 0 THEN idx + 1 END AS hi, CASE WHEN key % 11 = 0 THEN idx ELSE 0 END AS snap,
        lag(term, 1, term) OVER w AS before_term, lag(key % 3, 1, key % 3) OVER w AS before_vote FROM log WINDOW w AS (PARTITION BY shard_id ORDER BY idx))""")
def update_rules(log, table):
    order = Window.partitionBy("shard_id").orderBy("idx")
    idx, key = F.col("idx"), F.col("key")
    vote, saves = key % 3, key % 7 != 0
    apply, low, high = F.when(key % 6 != 0, idx - key % 5 + 2), F.when(saves, idx), F.when(saves, idx + 1)
    before_term, before_vote = F.coalesce(F.lag("term").over(order), "term"), F.coalesce(F.lag(vote).over(order), vote)
    return log.select(
        "shard_id", "idx", scalars.update_fault(idx - key % 4 + 3, apply, high).alias("fault"),
        scalars.fast_apply(F.when(key % 11 == 0, idx).otherwise(0), apply, low, high).alias("fast"),
        scalars.needs_sync(F.col("term"), vote, before_term, before_vote).alias("sync"))
