"""Further registered queries: reads, reports, predicates of sessions, messages, chunks and members."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import commit, membership, messages, overwrite, reads, scans, sessions
from ..sources.tables import events_progress, read_log, shared_folder, write_log
from .catalog import HALF, _half, query

STATES = "states AS (SELECT shard_id, replica_id, (SELECT max(term) FROM log l WHERE l.shard_id = progress.shard_id) AS term, (shard_id + 1) % 3 AS vote, match // 2 AS commit FROM progress)"


def _states(log):
    """A stored hard state for each replica."""
    terms = log.groupBy("shard_id").agg(F.max("term").alias("term"))
    return events_progress(log).join(terms, "shard_id").select("shard_id", "replica_id", "term", ((F.col("shard_id") + 1) % 3).alias("vote"), F.floor(F.col("match") / 2).cast("long").alias("commit"))


@query(f""", {STATES}, s AS (SELECT shard_id, max(idx) AS snapshot_idx FROM log WHERE k = 'purchase' GROUP BY 1),
  t AS (SELECT shard_id, min(idx) AS first_idx, count(*) AS entry_count, max(snapshot_idx) AS snapshot_idx FROM log JOIN s USING (shard_id) WHERE idx > snapshot_idx GROUP BY 1)
  SELECT shard_id, replica_id, term, vote, commit, first_idx, coalesce(entry_count, 0) AS entry_count, snapshot_idx FROM states LEFT JOIN t USING (shard_id)""")
def hard_states(log, table):
    return scans.hard_states(scans.raft_state(log, log.where("k = 'purchase'").select("shard_id", "idx")), _states(log))


@query("""SELECT a.shard_id, a.k, a.read_idx, a.read_id, l.v, l.idx AS written_at FROM (SELECT shard_id, k, idx // 2 AS read_idx, key AS read_id FROM log) a
  ASOF LEFT JOIN log l ON a.shard_id = l.shard_id AND a.k = l.k AND a.read_idx >= l.idx""")
def point_reads(log, table):
    return reads.read_at(log, log.select("shard_id", "k", F.floor(F.col("idx") / 2).cast("long").alias("read_idx"), F.col("key").alias("read_id")))


@query("""SELECT a.shard_id, a.k, a.read_idx, a.read_id, l.v, l.idx AS written_at FROM (SELECT DISTINCT p.shard_id, k, match AS read_idx, replica_id AS read_id FROM progress p JOIN log USING (shard_id) WHERE role <> 'witness') a
  ASOF LEFT JOIN log l ON a.shard_id = l.shard_id AND a.k = l.k AND a.read_idx >= l.idx""")
def stale_reads(log, table):
    keys = log.select("shard_id", "k").distinct()
    local = events_progress(log).where("role <> 'witness'").select("shard_id", F.col("match").alias("read_idx"), F.col("replica_id").alias("read_id"))
    return reads.read_at(log, local.join(keys, "shard_id"))


@query(f""", {HALF} SELECT log.shard_id, log.key, half.commit AS read_idx, half.commit IS NULL AS dropped FROM log LEFT JOIN (SELECT * FROM half WHERE shard_id <> 3) half USING (shard_id)""")
def read_permissions(log, table):
    return reads.read_permissions(_half(log).where("shard_id <> 3"), log.select("shard_id", "key"))


@query("""SELECT shard_id, seq, ctx, read_idx, coalesce(read_idx < lag(read_idx) OVER (PARTITION BY shard_id ORDER BY seq), false) AS went_back
  FROM (SELECT shard_id, idx AS seq, client_id AS ctx, idx - key % 5 AS read_idx FROM log QUALIFY row_number() OVER (PARTITION BY shard_id, client_id ORDER BY idx) = 1)""")
def queued_reads(log, table):
    return reads.queued_reads(log.select("shard_id", F.col("idx").alias("seq"), F.col("client_id").alias("ctx"), (F.col("idx") - F.col("key") % 5).alias("read_idx")))


@query("""SELECT r.shard_id, r.key, CASE WHEN s.key IS NULL THEN 'pending' WHEN s.v < 20 THEN 'rejected' WHEN s.cmd_len = 0 THEN 'aborted' ELSE 'completed' END AS code,
  CASE WHEN s.v >= 20 AND s.cmd_len <> 0 THEN s.idx END AS idx FROM log r LEFT JOIN (SELECT * FROM log WHERE type <> 'Application') s USING (shard_id, key)""")
def snapshot_results(log, table):
    done = log.where("type <> 'Application'").select("shard_id", "key", (F.col("v") < 20).alias("ignored"), (F.col("cmd_len") == 0).alias("aborted"), "idx")
    return reads.snapshot_results(log.select("shard_id", "key"), done)


@query(f""", {STATES} SELECT p.shard_id, p.replica_id, role, match, term, vote, commit, p.shard_id % 5 AS leader_id, p.shard_id % 5 = p.replica_id AS is_leader, term IS NULL AS pending
  FROM progress p LEFT JOIN (SELECT * FROM states WHERE replica_id <> 4) s USING (shard_id, replica_id)""")
def shard_infos(log, table):
    return reads.shard_infos(events_progress(log), _states(log).where("replica_id <> 4"), log.select("shard_id", (F.col("shard_id") % 5).alias("leader_id")).distinct())


@query("""SELECT shard_id, len(list(replica_id) FILTER (role = 'voter')) AS voters, list_sort(list(replica_id) FILTER (role = 'voter'))[1] AS first_voter, list_sort(list(replica_id) FILTER (role = 'witness'))[1] AS witness,
  count(*) FILTER (role = 'non_voting') AS non_voting FROM progress GROUP BY 1""")
def shard_members(log, table):
    return reads.shard_members(events_progress(log)).select("shard_id", F.size("voter").cast("long").alias("voters"), F.get("voter", 0).alias("first_voter"), F.get("witness", 0).alias("witness"), F.size("non_voting").cast("long").alias("non_voting"))


@query("""SELECT (shard_id + replica_id) % 4 AS host_id, count(*) AS replicas, count(DISTINCT shard_id) AS shards, bool_or(role = 'witness') AS holds_witness FROM progress GROUP BY 1""")
def host_report(log, table):
    progress = events_progress(log)
    return reads.host_report(progress, progress.select("shard_id", "replica_id", ((F.col("shard_id") + F.col("replica_id")) % 4).alias("host_id")))


MESSAGES = ("Replicate", "Ping", "InstallSnapshot", "Unreachable", "Election", "LocalTick", "HeartbeatResp", "RequestVoteResp", "SnapshotStatus", "Propose", "ReplicateResp")


@query(f"""SELECT key, m AS message, m NOT IN ('InstallSnapshot', 'Unreachable', 'SnapshotStatus') AS can_drop, m IN ('Unreachable', 'Election', 'LocalTick', 'SnapshotStatus') AS local, m IN ('Unreachable', 'HeartbeatResp', 'RequestVoteResp', 'SnapshotStatus', 'ReplicateResp') AS response,
  m IN ('Replicate', 'Ping') AS free_order FROM (SELECT key, {list(MESSAGES)}[key % {len(MESSAGES)} + 1] AS m FROM log)""")
def message_classes(log, table):
    m = F.col("message")
    rows = log.select("key", F.get(F.array(*map(F.lit, MESSAGES)), (F.col("key") % len(MESSAGES)).cast("int")).alias("message"))
    return rows.select("key", m, scalars.can_drop(m).alias("can_drop"), scalars.is_local_message(m).alias("local"), scalars.is_response(m).alias("response"), scalars.is_free_order(m).alias("free_order"))


@query("""SELECT shard_id, idx, t = 0 AND vote = 0 AND c = 0 AS empty_state, t = bt AND vote = bv AND c = bc AS same_state, snap = 0 AS empty_snapshot,
  NOT (t = 0 AND vote = 0 AND c = 0) OR snap <> 0 OR cmd_len > 0 AS has_update
  FROM (SELECT *, lag(t, 1, 0) OVER w AS bt, lag(vote, 1, 0) OVER w AS bv, lag(c, 1, 0) OVER w AS bc FROM (SELECT shard_id, idx, cmd_len, term % 2 AS t, key % 2 AS vote, (client_id % 2) AS c, CASE WHEN k = 'purchase' THEN idx ELSE 0 END AS snap FROM log)
  WINDOW w AS (PARTITION BY shard_id ORDER BY idx))""")
def state_rules(log, table):
    order = Window.partitionBy("shard_id").orderBy("idx")
    now = (F.col("term") % 2, F.col("key") % 2, F.col("client_id") % 2)
    before = tuple(F.coalesce(F.lag(x).over(order), F.lit(0)) for x in now)
    snapshot = F.when(F.col("k") == "purchase", F.col("idx")).otherwise(0)
    empty = scalars.is_empty_state(*now)
    return log.select("shard_id", "idx", empty.alias("empty_state"), scalars.same_state(now, before).alias("same_state"), (snapshot == 0).alias("empty_snapshot"), (~empty | (snapshot != 0) | (F.col("cmd_len") > 0)).alias("has_update"))


@query("""SELECT conv_id, turn, n = -1 OR n = turn + 1 AS last_chunk, n = turn + 1 AS last_file_chunk, n = -2 AS poison FROM
  (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN -1 WHEN conv_id % 7 = 0 THEN -2 ELSE count(*) OVER (PARTITION BY conv_id) END AS n FROM conversations)""", log=False)
def chunk_rules(log, table):
    n = F.when(F.col("conv_id") % 5 == 0, scalars.LAST_CHUNK).when(F.col("conv_id") % 7 == 0, scalars.POISON_CHUNK).otherwise(F.count("*").over(Window.partitionBy("conv_id")))
    return table("conversations").withColumn("n", n).select("conv_id", "turn", scalars.is_last_chunk(F.col("n"), F.col("turn")).alias("last_chunk"), scalars.is_last_file_chunk(F.col("n"), F.col("turn")).alias("last_file_chunk"), scalars.is_poison_chunk(F.col("n")).alias("poison"))


SESSION = "(SELECT key, shard_id, key % 8 AS wanted, CASE WHEN key % 13 = 0 THEN 0 ELSE client_id END AS client, CASE WHEN key % 5 = 0 THEN -2 WHEN key % 5 = 1 THEN -1 WHEN key % 5 = 2 THEN 0 ELSE series_id END AS series, responded_to + key % 9 AS responded FROM log)"


@query(f"""SELECT key, CASE WHEN shard_id <> wanted OR client = 0 OR series IN (-2, -1) THEN 'invalid' WHEN responded > series THEN 'broken' END AS fault, shard_id = wanted AND client <> 0 AND series IN (-2, -1) AS session_op FROM {SESSION}""")
def session_rules(log, table):
    kind, key = F.col("key") % 5, F.col("key")
    client, series = F.when(key % 13 == 0, 0).otherwise(F.col("client_id")), F.when(kind == 0, -2).when(kind == 1, -1).when(kind == 2, 0).otherwise(F.col("series_id"))
    return log.select("key", scalars.session_fault(client, series, F.col("responded_to") + key % 9, F.col("shard_id"), key % 8).alias("fault"), scalars.valid_for_session_op(client, series, F.col("shard_id"), key % 8).alias("session_op"))


@query("""SELECT shard_id, idx, idx > key % 50 + 20 AND idx + 3 > key % 50 + 20 AND idx > key % 40 + 20 AS snapshot_required, cmd_len > 32 AS too_big, e IN ('Timeout', 'Aborted') AS temporary,
  CASE WHEN o AND u > 0 THEN CASE WHEN idx >= u + 1 THEN u END WHEN idx > CASE WHEN o THEN client_id % 30 ELSE 10 END THEN idx - CASE WHEN o THEN client_id % 30 ELSE 10 END END AS compact_to,
  term % 4 > 1 AND key % 3 <> client_id % 3 AND shard_id <> 0 AND key % 10 < 5 AS drops_vote, k IN ('wait', 'snapshot') AS paused
  FROM (SELECT *, ['Timeout', 'Rejected', 'Aborted'][key % 3 + 1] AS e, key % 2 = 0 AS o, key % 4 * 10 AS u FROM log)""")
def replica_rules(log, table):
    idx, key, own = F.col("idx"), F.col("key"), F.col("client_id")
    error = F.get(F.array(F.lit("Timeout"), F.lit("Rejected"), F.lit("Aborted")), (key % 3).cast("int"))
    return log.select(
        "shard_id", "idx", scalars.snapshot_required(idx, idx + 3, key % 50, key % 40, 20).alias("snapshot_required"), (F.col("cmd_len") > 32).alias("too_big"), scalars.is_temporary(error).alias("temporary"),
        scalars.compaction_index(idx, key % 2 == 0, key % 4 * 10, own % 30, 10).alias("compact_to"),
        scalars.drops_vote_request(F.col("term") % 4, F.lit(1), key % 3, own % 3, F.col("shard_id"), key % 10, F.lit(5)).alias("drops_vote"), scalars.is_paused(F.col("k")).alias("paused"))


OLD = """old AS (SELECT n_regionkey::BIGINT AS shard_id, n_nationkey::BIGINT AS replica_id, ['voter', 'non_voting', 'witness', 'removed'][n_nationkey % 4 + 1] AS role, lower(n_name) AS address FROM nation),
  new AS (SELECT n_regionkey::BIGINT AS shard_id, n_nationkey::BIGINT AS replica_id, CASE WHEN n_nationkey % 3 = 0 THEN 'moved' ELSE lower(n_name) END AS address FROM nation)"""


def _members(table):
    n = F.col("n_nationkey")
    own = table("nation").select(F.col("n_regionkey").cast("long").alias("shard_id"), n.cast("long").alias("replica_id"), F.lower("n_name").alias("address"), n)
    role = F.get(F.array(*(F.lit(x) for x in ("voter", "non_voting", "witness", "removed"))), (n % 4).cast("int"))
    return own.withColumn("role", role).drop("n_nationkey"), own.withColumn("address", F.when(n % 3 == 0, "moved").otherwise(F.col("address"))).drop("n_nationkey")


@query(f"""WITH {OLD} SELECT shard_id, replica_id, CASE WHEN role <> 'removed' AND old.address <> new.address THEN 'address_changed' WHEN role = 'non_voting' THEN 'was_non_voting' WHEN role = 'witness' THEN 'was_witness' WHEN role = 'removed' THEN 'was_removed' END AS fault
  FROM new JOIN old USING (shard_id, replica_id) WHERE fault IS NOT NULL""", log=False)
def new_member_faults(log, table):
    return membership.new_member_faults(*_members(table))


@query(f"""WITH {OLD}, rec AS (SELECT r_regionkey::BIGINT AS shard_id, r_regionkey = 1 AS j, ['unknown', 'regular', 'disk'][r_regionkey % 3 + 1] AS machine, r_regionkey = 2 AS nj FROM region),
  o AS (SELECT * FROM old WHERE role <> 'removed'), n AS (SELECT * FROM new WHERE shard_id <> 0),
  d AS (SELECT shard_id, count(o.address) AS rec_n, count(n.address) AS in_n, count(*) FILTER (o.address IS DISTINCT FROM n.address) AS differ FROM o FULL JOIN n USING (shard_id, replica_id) GROUP BY 1)
  SELECT shard_id, CASE WHEN machine <> 'unknown' AND machine <> 'regular' THEN 'machine' WHEN NOT j AND coalesce(rec_n, 0) = 0 THEN 'no_address' WHEN j AND coalesce(in_n, 0) > 0 THEN 'members_of_joined'
  WHEN nj AND coalesce(rec_n, 0) > 0 THEN 'joins_as_initial' WHEN coalesce(in_n, 0) > 0 AND coalesce(differ, 0) > 0 THEN 'members_differ' END AS fault FROM rec LEFT JOIN d USING (shard_id)""", log=False)
def bootstrap_faults(log, table):
    old, new = _members(table)
    r = F.col("r_regionkey")
    machine = F.get(F.array(*(F.lit(x) for x in ("unknown", "regular", "disk"))), (r % 3).cast("int"))
    records = table("region").select(r.cast("long").alias("shard_id"), (r == 1).alias("join"), machine.alias("machine"), (r == 2).alias("now_join"), F.lit("regular").alias("now_machine"))
    return membership.bootstrap_faults(records, old.where("role <> 'removed'").drop("role"), new.where("shard_id <> 0").withColumn("address", F.concat(F.lit(" "), F.upper("address"))))


@query("SELECT DISTINCT shard_id, client_id AS replica_id FROM log ANTI JOIN (SELECT shard_id, client_id FROM log WHERE k = 'purchase' AND cmd_len = 64) m USING (shard_id, client_id)")
def removed_replicas(log, table):
    members = log.select("shard_id", F.col("client_id").alias("replica_id"), "k", "cmd_len")
    return membership.self_removed(members.select("shard_id", "replica_id").distinct(), members.where("k = 'purchase' and cmd_len = 64"))


def _reversed(md5: str) -> str:
    return " || ".join(f"substr({md5}, {at}, 2)" for at in range(15, 0, -2))


@query(f"""SELECT shard_id, {_reversed("md5(ids || ';' || c)")} AS member_hash FROM (SELECT shard_id, string_agg(replica_id::VARCHAR, ',' ORDER BY replica_id) FILTER (role = 'voter') AS ids, (shard_id * 7)::VARCHAR AS c FROM progress GROUP BY shard_id)""")
def member_hashes(log, table):
    return membership.member_hashes(events_progress(log), log.select("shard_id", (F.col("shard_id") * 7).alias("config_change_id")).distinct())


FILES = "f AS (SELECT shard_id, idx // 20 AS file, max(CASE WHEN key % 9 = 8 THEN 1 ELSE 0 END) AS live, count(*) AS n FROM log GROUP BY ALL)"


def _files(log):
    return log.groupBy("shard_id", F.call_function("div", F.col("idx"), F.lit(20)).alias("file")).agg(F.max((F.col("key") % 9 == 8).cast("int")).alias("live"), F.count("*").alias("n"))


@query(f""", {FILES} SELECT shard_id, file, live, n FROM (SELECT *, max(file) FILTER (live = 0) OVER (PARTITION BY shard_id) AS newest FROM f) WHERE newest IS NULL OR file > newest""")
def extents_left(log, table):
    files = _files(log)
    return overwrite.drop_obsolete(files, files.where("live = 0"))


@query(f""", {FILES} SELECT shard_id, file, CASE WHEN live = 1 THEN n ELSE -n END AS n FROM f WHERE live = 1 OR n > 10""")
def merged_files(log, table):
    files = _files(log)
    return overwrite.merge_file_metas(files.where("live = 1").select("shard_id", "file", "n"), files.where("n > 10").select("shard_id", "file", (-F.col("n")).alias("n")))


@query("""SELECT shard_id, array_to_string(list_sort(list_distinct(list(client_id % 50) || list(key % 50))), ',') AS files FROM log GROUP BY 1""")
def merged_file_sets(log, table):
    sets = log.groupBy("shard_id").agg(F.collect_set(F.col("client_id") % 50).alias("a"), F.collect_set(F.col("key") % 50).alias("b"))  # at most fifty each
    return sets.select("shard_id", F.array_join(overwrite.merge_file_sets(F.col("a"), F.col("b")), ",").alias("files"))


@query("""SELECT shard_id, replica_id, max(i) AS idx, count(*) - 1 AS replaced, bool_or(back) AS went_back FROM (SELECT shard_id, client_id % 3 AS replica_id, idx - key % 4 AS i,
  coalesce(idx - key % 4 < lag(idx - key % 4) OVER (PARTITION BY shard_id, client_id % 3 ORDER BY idx), false) AS back FROM log) GROUP BY 1, 2""")
def pending_compactions(log, table):
    return overwrite.pending_compactions(log.select("shard_id", (F.col("client_id") % 3).alias("replica_id"), F.col("idx").alias("seq"), (F.col("idx") - F.col("key") % 4).alias("idx")))


@query("""SELECT shard_id, seq, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY shard_id ORDER BY seq), 0) AS saved_to FROM
  (SELECT s.shard_id, s.idx AS seq, l.idx AS mark FROM log s LEFT JOIN log l ON l.shard_id = s.shard_id AND l.idx = s.idx - s.key % 3 AND l.term = s.term AND l.cmd_len > 0)""")
def saved_marks(log, table):
    saves = log.select("shard_id", F.col("idx").alias("seq"), (F.col("idx") - F.col("key") % 3).alias("idx"), "term")
    return overwrite.saved_marks(saves, log.where("cmd_len > 0").select("shard_id", "idx", "term"))


@query(f""", {HALF}, b AS (SELECT l.shard_id, min(l.idx) AS first_idx, max(l.idx) AS last_idx FROM log l JOIN half h USING (shard_id) WHERE CASE WHEN l.shard_id % 3 = 0 THEN l.idx > commit + 2 WHEN l.shard_id % 3 = 1 THEN l.idx <= commit ELSE l.idx > commit END GROUP BY 1)
  SELECT shard_id, first_idx, last_idx, commit AS applied, CASE WHEN first_idx > commit + 1 THEN 'hole' WHEN last_idx <= commit THEN 'old' END AS fault FROM b JOIN half USING (shard_id) WHERE fault IS NOT NULL""")
def apply_faults(log, table):
    applied = _half(log).withColumnRenamed("commit", "applied")
    rows = log.join(applied, "shard_id").where(F.when(F.col("shard_id") % 3 == 0, F.col("idx") > F.col("applied") + 2).when(F.col("shard_id") % 3 == 1, F.col("idx") <= F.col("applied")).otherwise(F.col("idx") > F.col("applied")))
    return scans.apply_faults(rows.drop("applied"), applied)


@query("SELECT shard_id, idx, CASE WHEN first THEN term ELSE first_term END AS term, key AS payload FROM (SELECT *, idx % 48 = 0 OR idx = 1 AS first, arg_min(term, idx) OVER (PARTITION BY shard_id, idx // 48) AS first_term FROM log)")
def restored_batches(log, table):
    packed = log.groupBy("shard_id", scalars.batch_id(F.col("idx")).alias("b")).agg(F.min("idx").alias("first_idx"), F.min_by("term", "idx").alias("term"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "key"))), lambda x: x["key"]).alias("payloads"))
    return scans.restore_batches(packed)


@query(f""", {HALF} SELECT shard_id, idx, term FROM log JOIN half USING (shard_id) WHERE k = 'purchase' AND idx <= commit""")
def snapshots_upto(log, table):
    return scans.snapshots_upto(log.where("k = 'purchase'").select("shard_id", "idx", "term"), _half(log).withColumnRenamed("commit", "upto"))


@query("""SELECT shard_id, client_id, max(upto) AS responded_to, count(*) AS n, max(series_id) AS newest
  FROM (SELECT shard_id, client_id, series_id, max(responded_to) OVER (PARTITION BY shard_id, client_id) AS upto FROM log) WHERE series_id > upto GROUP BY 1, 2""")
def session_images(log, table):
    """Sessions saved and recovered again, in the two versions of an image; a session holds the results that its client has not responded to."""
    upto = log.groupBy("shard_id", "client_id").agg(F.max("responded_to").alias("responded_to"))
    open_ = log.drop("responded_to").join(upto, ["shard_id", "client_id"]).where("series_id > responded_to")
    rows = open_.groupBy("shard_id", "client_id").agg(F.max("responded_to").alias("responded_to"), F.map_from_entries(F.collect_list(F.struct(F.col("series_id").cast("string"), F.col("cmd_len").alias("r")))).alias("old"))
    new = F.transform_values("old", lambda k, v: F.struct(v.alias("value"), F.lit("x").alias("data")))
    images = sessions.save_sessions(rows.withColumnRenamed("old", "history").where("client_id % 2 = 0")).unionByName(sessions.save_sessions(rows.withColumn("history", new).drop("old").where("client_id % 2 = 1")))
    return sessions.recover_sessions(images).select("shard_id", "client_id", "responded_to", F.size("history").cast("long").alias("n"), F.array_max(F.transform(F.map_keys("history"), lambda k: k.cast("long"))).alias("newest"))


@query("SELECT shard_id, idx, CASE WHEN key % 5 <> 0 THEN length(k) END AS result, key % 5 = 0 AS fault FROM log")
def batch_results(log, table):
    return sessions.match_batch(log, log.where("key % 5 <> 0").select("shard_id", "idx", F.length("k").cast("long").alias("result")))


@query("SELECT shard_id, idx, length(k) AS result FROM log")
def machine_results(log, table):
    return sessions.run_machine(log, sessions.LastValue, results=True)


@query(f"""SELECT key, lower(trim('  Host' || key || ':90 ')) = lower('host' || key || ':90') AS same_address, key AS number, 32 + cmd_len + cmd_len // 6 AS snappy, key % 3 <> 0 AS valid,
  {_reversed("md5(key::VARCHAR)")} AS digest, shard_id || ':' || client_id || ':' || idx AS chunk_key, 'external-file-' || key AS file, ((key * 1000 + 2097151) // 2097152) * 4 + key * 1000 + 16 AS stored,
  least(key, idx) AS low, greatest(key, idx) AS high, 10 + (key % 10) AS timeout FROM log""")
def naming_rules(log, table):
    key = F.col("key")
    address = F.concat(F.lit("host"), key, F.when(key % 3 == 0, ":99999").otherwise(":90"))
    return log.select(
        "key", scalars.address_equal(F.concat(F.lit("  Host"), key, F.lit(":90 ")), F.concat(F.lit("host"), key, F.lit(":90"))).alias("same_address"), scalars.log_file_number(scalars.log_file(key)).alias("number"),
        scalars.snappy_bound(F.col("cmd_len")).alias("snappy"), scalars.valid_address(address).alias("valid"), scalars.digest_long(key.cast("string")).alias("digest"),
        scalars.chunk_key(F.col("shard_id"), F.col("client_id"), F.col("idx")).alias("chunk_key"), scalars.external_file(key).alias("file"), scalars.stored_payload(key * 1000).alias("stored"),
        F.least("key", "idx").alias("low"), F.greatest("key", "idx").alias("high"), scalars.election_timeout(10, key % 10 / 10).cast("long").alias("timeout"))


@query("SELECT idx, term, key FROM log WHERE shard_id = 5 AND idx BETWEEN 20 AND 4000")
def stored_shard_scan(log, table):
    """One shard's range out of a stored log: its bucket's folder and the row groups of the range are read."""
    path = shared_folder(log.sparkSession, "stored_log")
    write_log(log.select("shard_id", "idx", "term", "key"), path)
    return read_log(log.sparkSession, path, shard_id=5).where("idx between 20 and 4000").select("idx", "term", "key")


@query("""SELECT shard_id, idx, file_id, c AS file_chunk_id, n AS file_chunk_count, before + c AS chunk_id, total AS chunk_count, least(64, size - c * 64) AS bytes FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY shard_id, idx ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(n) OVER (PARTITION BY shard_id, idx))::BIGINT AS total FROM (
    SELECT shard_id, idx, f::BIGINT AS file_id, cmd_len * (f + 1) AS size, greatest((cmd_len * (f + 1) + 63) // 64, 1) AS n FROM log, range(3) AS t(f))), unnest(range(n)) AS u(c)""")
def snapshot_file_chunks(log, table):
    files = log.select("shard_id", "idx", "cmd_len", F.explode(F.array(*(F.lit(f).cast("long") for f in range(3)))).alias("file_id"))
    return messages.snapshot_chunks(files.select("shard_id", "idx", "file_id", (F.col("cmd_len") * (F.col("file_id") + 1)).alias("size")), 64)


@query("SELECT shard_id, idx, term, 0::BIGINT AS chunk_id, 1::BIGINT AS chunk_count, 0::BIGINT AS bytes, true AS witness FROM log WHERE k = 'purchase'")
def witness_chunks(log, table):
    return messages.witness_chunks(log.where("k = 'purchase'"))


@query("""SELECT shard_id, replica_id, idx, term FROM (SELECT log.shard_id, replica_id, idx, term, match, sum(cmd_len + 24) OVER (PARTITION BY log.shard_id, replica_id ORDER BY idx) AS seen
  FROM log JOIN (SELECT shard_id, replica_id, match // 2 AS match FROM progress) p ON p.shard_id = log.shard_id AND idx > match) WHERE seen <= 2000 OR idx = match + 1""")
def replicate_pages(log, table):
    progress = events_progress(log).withColumn("match", F.call_function("div", F.col("match"), F.lit(2)))
    return messages.replicate_pages(progress, log, 2000)


@query(f""", {HALF} SELECT shard_id, idx, term, key FROM log JOIN half USING (shard_id) WHERE idx > commit""")
def compacted_log(log, table):
    return scans.compacted(log, _half(log).withColumnRenamed("commit", "low_water")).select("shard_id", "idx", "term", "key")


@query("""SELECT shard_id, seq, CASE WHEN a > p THEN 'applied_beyond_processed' WHEN p > c THEN 'processed_beyond_commit' WHEN before > a THEN 'applied_fell' END AS fault FROM (
  SELECT *, lag(a) OVER (PARTITION BY shard_id ORDER BY seq) AS before FROM (SELECT shard_id, idx AS seq, idx - key % 3 AS a, idx - key % 2 AS p, idx + key % 5 - 1 AS c FROM log)) WHERE fault IS NOT NULL""")
def mark_faults(log, table):
    idx, key = F.col("idx"), F.col("key")
    return commit.mark_faults(log.select("shard_id", idx.alias("seq"), (idx - key % 3).alias("applied"), (idx - key % 2).alias("processed"), (idx + key % 5 - 1).alias("commit")))


@query(f""", {HALF} SELECT shard_id, conflict_idx, commit FROM (SELECT shard_id, min(idx) AS conflict_idx FROM log WHERE idx >= 40 * (shard_id + 1) GROUP BY 1) JOIN half USING (shard_id) WHERE conflict_idx <= commit""")
def append_faults(log, table):
    incoming = log.select("shard_id", "idx", F.when(F.col("idx") >= 40 * (F.col("shard_id") + 1), F.col("term") + 1).otherwise(F.col("term")).alias("term"))
    return overwrite.append_faults(overwrite.conflict_index(log, incoming), _half(log))
