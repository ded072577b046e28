"""Log operators against their SQL and against plain Python models."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerflow.functions import scalars
from ledgerflow.operators import commit, membership, overwrite, sessions
from ledgerflow.plans.catalog import ORACLES, QUERIES
from ledgerflow.plans import reports  # noqa: F401  registers further queries
from ledgerflow.sources.tables import events_log, read, read_log, write_log
from ledgerflow.streaming import queries as streaming

DATA = "/root/testdata/sf0.001"


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    for t in ("events", "orders", "nation", "region", "supplier", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    found = oracle.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_log_files_of_long_numbers(spark):
    """A number of more than six digits keeps them all, in the file's name and read back from it."""
    numbers = [0, 7, 999_999, 1_000_000, 5_999_999, 2**62]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", scalars.log_file(F.col("n")).alias("file"))
    assert [(r.file, r.back) for r in rows.select("file", scalars.log_file_number(F.col("file")).alias("back")).collect()] == [(f"{n:06d}.log", n) for n in numbers]


@pytest.mark.parametrize("name", ["naming_rules", "scalar_rules"])
def test_long_keys_equal_sql(spark, tmp_path, name):
    """Keys of more than six digits."""
    read(spark, DATA, "events").withColumn("event_id", F.col("event_id") + 999_500).write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = own.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), columns)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_partitioning_changes_nothing(spark, partitions):
    log = events_log(read(spark, DATA, "events"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = sessions.kv_state(log.repartition(partitions)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(str, found)) == sorted(map(str, sessions.kv_state(log).collect()))


def test_overwrite_model(spark):
    rng = random.Random(1)
    appends, logs = [], {}
    for shard in range(40):
        log = {}
        for seq in range(rng.randint(1, 9)):
            start, n, term = rng.randint(1, max(log, default=0) + 1), rng.randint(1, 6), seq
            appends.append((shard, seq, start, n, term))
            log = {i: x for i, x in log.items() if i < start} | {start + k: (term, seq) for k in range(n)}
        logs[shard] = log
    found = overwrite.live_entries(spark.createDataFrame(appends, "shard_id long, seq long, start long, n long, term long")).collect()
    assert {(r.shard_id, r.idx): (r.term, r.seq) for r in found} == {(s, i): x for s, log in logs.items() for i, x in log.items()}


def test_quorum_cases(spark):
    cases = {1: ([1], 1), 2: ([1, 2], 1), 3: ([2, 1, 2], 2), 4: ([2, 1, 1, 2], 1), 5: ([5, 4, 3, 2, 1], 3)}
    rows = [(c, r, "voter", m) for c, (matches, _) in cases.items() for r, m in enumerate(matches)]
    rows += [(c, 10 + r, "non_voting", 99) for c in cases for r in range(3)]  # these have no vote
    found = commit.quorum_index(spark.createDataFrame(rows, "shard_id long, replica_id long, role string, match long")).collect()
    assert {r.shard_id: r.quorum_idx for r in found} == {c: w for c, (_, w) in cases.items()}


def test_sessions_window_equals_fold(spark):
    rng = random.Random(2)
    rows = []
    for client in range(1, 6):
        rows.append((0, -client, "register", client, 0, 0, 1))
    for idx in range(1, 200):
        client, series = rng.randint(1, 5), rng.randint(1, 12)
        rows.append((0, idx, "update", client, series, rng.randint(0, series - 1), 10 * series))
    log = spark.createDataFrame(rows, "shard_id long, idx long, kind string, client_id long, series_id long, responded_to long, cmd_len long")
    fold = {r.idx: r.outcome for r in sessions.fold_sessions(log).collect() if r.idx > 0}
    window = {r.idx: r.outcome for r in sessions.session_outcomes(log.where("kind = 'update'")).collect()}
    assert fold == window and set(window.values()) == {"applied", "cached", "ignored"}


def test_sessions_belong_to_shards(spark):
    rows = [(s, i, 7, 1, 0) for s in (1, 2) for i in (1, 2)] + [(1, 3, 0, 5, 0), (1, 4, 0, 5, 0), (2, 5, 7, 0, 9), (2, 6, 7, 2, 0)]
    found = sessions.session_outcomes(spark.createDataFrame(rows, "shard_id long, idx long, client_id long, series_id long, responded_to long")).collect()
    assert sorted((r.shard_id, r.idx, r.outcome) for r in found) == [
        (1, 1, "applied"), (1, 2, "cached"), (1, 3, "applied"), (1, 4, "applied"), (2, 1, "applied"), (2, 2, "cached"), (2, 5, "applied"), (2, 6, "applied")]


def test_a_repeated_register_counts_as_use():
    table = sessions.SessionTable(2)
    table.step("register", 1, 0, 0, 0), table.step("register", 2, 0, 0, 0)
    assert table.step("register", 1, 0, 0, 0) == ("rejected", 0)
    table.step("register", 3, 0, 0, 0)
    assert table.step("update", 2, 1, 0, 5) == ("rejected", 0) and table.step("update", 1, 1, 0, 5) == ("applied", 5)


def test_machine_goes_on_from_its_snapshot(spark):
    log = events_log(read(spark, DATA, "events")).select("shard_id", "idx", "k", "v")
    image = sessions.run_machine(log.where("idx <= 40"), sessions.LastValue)
    whole = sessions.run_machine(log, sessions.LastValue)
    assert sorted(map(str, sessions.run_machine(log, sessions.LastValue, image).collect())) == sorted(map(str, whole.collect()))
    results = sessions.run_machine(log, sessions.LastValue, results=True)
    assert {(r.shard_id, r.idx, r.result) for r in results.collect()} == {(r.shard_id, r.idx, len(r.k)) for r in log.collect()}
    hashes = sessions.state_hashes(sessions.kv_state(log)).collect()
    assert sorted(map(str, hashes)) == sorted(map(str, sessions.state_hashes(whole.repartition(7)).collect())) and len({r.state_hash for r in hashes}) == len(hashes)


def test_running_frames_are_in_proportion(spark):
    """Reads of one long shard: eight times the rows take far less than sixty-four times the time."""
    took = []
    for n in (20_000, 160_000):
        asks = spark.range(n).select(F.lit(1).cast("long").alias("shard_id"), F.col("id").alias("queue_pos"), F.col("id").alias("read_idx"))
        began = time.time()
        commit.release_reads(asks, asks.where("queue_pos % 3 = 0").select("shard_id", "queue_pos", (F.col("queue_pos") + 5).alias("confirm_time"))).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 20 * took[0] + 5


def test_stored_log_is_pruned(spark, tmp_path):
    log = events_log(read(spark, DATA, "events"))
    path = str(tmp_path / "log")
    write_log(log.where("idx <= 50"), path, buckets=4)
    write_log(log.where("idx > 50"), path, buckets=4)
    one = read_log(spark, path, shard_id=5, buckets=4).where("idx between 10 and 60")
    assert sorted(r.key for r in one.collect()) == sorted(r.key for r in log.where("shard_id = 5 and idx between 10 and 60").collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "GreaterThanOrEqual(idx,10)" in plan
    assert len(one.inputFiles()) and all("bucket=1" in f for f in {r.f for r in one.select(F.input_file_name().alias("f")).collect()})


def test_session_eviction():
    table = sessions.SessionTable(3)
    for c in (1, 2, 3):
        assert table.step("register", c, 0, 0, 0) == ("applied", c)
    assert table.step("update", 1, 1, 0, 5) == ("applied", 5)
    table.step("register", 4, 0, 0, 0)
    assert table.step("update", 2, 1, 0, 5) == ("rejected", 0)
    assert table.step("update", 1, 1, 0, 9) == ("cached", 5)
    assert table.step("update", 1, 2, 1, 7) == ("applied", 7) and table.step("update", 1, 1, 0, 7) == ("ignored", 0)
    assert table.step("unregister", 1, 0, 0, 0) == ("applied", 1) and table.step("unregister", 1, 0, 0, 0) == ("rejected", 0)
    assert table.step("noop", 9, 0, 0, 3) == ("applied", 3)


def test_membership_rules():
    m = membership.Members()
    assert m.step(1, 0, "AddNode", 1, "a:1", True) and m.step(2, 0, "AddNonVoting", 2, "b:1", False)
    assert not m.step(3, 0, "AddNode", 2, "c:1", False)  # a promotion keeps its address
    assert m.step(4, 0, "AddNode", 2, " B:1 ", False) and 2 in m.voters and not m.non_voting
    assert not m.step(5, 0, "AddWitness", 2, "b:1", False) and not m.step(6, 0, "AddNode", 3, "A:1", False)
    assert m.step(7, 0, "RemoveNode", 1, "", False) and not m.step(8, 0, "AddNode", 1, "a:1", False)
    assert not m.step(9, 0, "RemoveNode", 2, "", False)  # the last voter
    ordered = membership.Members(ordered=True)
    assert ordered.step(5, 9, "AddNode", 1, "a:1", True)
    assert not ordered.step(6, 4, "AddNode", 2, "b:1", False) and ordered.step(7, 5, "AddNode", 2, "b:1", False)


def test_folds_equal_plain_loops(spark):
    """Ordered folds over many shards, in batches of a few rows so that shards go on from batch to batch."""
    rng = random.Random(9)
    log, changes = [], []
    for shard in range(12):
        for idx in range(1, rng.randint(2, 60)):
            log.append((shard, idx, rng.choice(["register", "update", "update", "unregister", "noop"]), rng.randint(1, 5), rng.randint(1, 6), rng.randint(0, 2), rng.randint(0, 9)))
            changes.append((shard, idx, rng.randint(0, idx), rng.choice(["AddNode", "AddNonVoting", "AddWitness", "RemoveNode"]), rng.randint(1, 6), f"h{rng.randint(1, 6)}:1", idx < 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sessions.fold_sessions(spark.createDataFrame(log, "shard_id long, idx long, kind string, client_id long, series_id long, responded_to long, cmd_len long").repartition(5), capacity=3).collect()
        members = {o: membership.fold_changes(spark.createDataFrame(changes, "shard_id long, idx long, config_change_id long, type string, replica_id long, address string, initialize boolean").repartition(5), o).collect() for o in (False, True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tables, wanted = {}, set()
    for shard, idx, *row in log:
        wanted.add((shard, idx, *tables.setdefault(shard, sessions.SessionTable(3)).step(*row)))
    assert {tuple(r) for r in found} == wanted and {r.outcome for r in found} == {"applied", "cached", "ignored", "rejected"}
    for ordered, rows in members.items():
        state, wanted = {}, set()
        for shard, idx, *row in changes:
            m = state.setdefault(shard, membership.Members(ordered))
            wanted.add((shard, idx, m.step(idx, *row), len(m.voters), len(m.non_voting), len(m.witnesses), len(m.removed)))
        assert {tuple(r) for r in rows} == wanted and {r.accepted for r in rows} == {True, False}


def test_views_model(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for shard in range(60):
        replicas, ci, leader, term = None, 0, 0, 0
        for seq in range(rng.randint(1, 8)):
            u = (f"r{seq}", rng.randint(0, 3), rng.randint(0, 2), rng.randint(1, 3))
            rows.append((shard, seq, *u))
            if u[1] > ci:
                replicas, ci = u[0], u[1]
            if u[2] and (not leader or u[3] > term):
                leader, term = u[2], u[3]
        want[shard] = (ci, replicas, leader, term)
    found = overwrite.merge_views(spark.createDataFrame(rows, "shard_id long, seq long, replicas string, config_index long, leader_id long, term long")).collect()
    assert {r.shard_id: (r.config_index, r.replicas, r.leader_id, r.term) for r in found} == want


def test_chunk_assembly(spark):
    rows = [(1, 1, 5, 0, 3, 0, "aa"), (1, 1, 5, 1, 3, 1, "b"), (1, 1, 6, 2, 3, 2, "x"), (1, 1, 5, 2, 3, 3, "c"), (2, 1, 5, 0, 2, 0, "q"), (2, 1, 5, 0, 2, 1, "zz"), (2, 1, 5, 1, 2, 2, "y"), (3, 1, 5, 1, 2, 0, "late")]
    found = streaming.assemble_chunks(spark.createDataFrame(rows, "shard_id long, replica_id long, sender long, chunk_id long, chunk_count long, seq long, data string")).collect()
    assert {r.shard_id: (r.n_chunks, r.n_chars, r.complete) for r in found} == {1: (3, 4, True), 2: (2, 3, True), 3: (0, 0, False)}


def test_rate_limit_hysteresis(spark):
    sizes = [50, 101, 80, 71, 69, 69, 69, 69, 102, 50]
    found = streaming.rate_limit(spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(sizes)], "shard_id long, tick long, size double"), 100.0, hold=3).collect()
    assert [r.limited for r in sorted(found, key=lambda r: r.tick)] == [False, True, True, True, True, False, False, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    log = events_log(read(spark, DATA, "events")).select("shard_id", "idx", "k", "v")
    source = str(tmp_path / "in")
    for part in range(3):  # one file a micro-batch; the second repeats rows of the first
        low, high = (part * 40 - 10 if part else 0), part * 40 + 40 if part < 2 else 10**9
        log.where(f"idx > {low} and idx <= {high}").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming.apply_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(streaming.upsert_state(str(tmp_path / "state"))).trigger(availableNow=True).start()
    query.awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    found = streaming.read_state(spark, str(tmp_path / "state"))
    assert sorted(map(str, found.collect())) == sorted(map(str, streaming.batch_state(log).select("shard_id", "k", "v", "n", "last_idx").collect()))
