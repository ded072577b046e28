"""Exactly-once application by client session, and state folds."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_SESSIONS
from .folds import ordered_fold


def session_outcomes(log: DataFrame) -> DataFrame:
    """Outcome of every update of registered clients: ignored, cached or applied.

    responded_to takes effect before the check. A session belongs to a shard, and an entry outside
    sessions is applied as it is. Within one registration and without eviction this is two windows
    by shard and client; the first entry of a series above all responses before it is the applied one.
    """
    managed = (F.col("client_id") != 0) & (F.col("series_id") != 0)
    w = Window.partitionBy("shard_id", "client_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_r", F.max(F.when(managed, F.col("responded_to"))).over(w))
    open_ = F.col("series_id") > F.col("_r")
    nth = F.count_if(open_).over(Window.partitionBy("shard_id", "client_id", "series_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(~managed, "applied").when(~open_, "ignored").when(F.col("_n") > 1, "cached").otherwise("applied")
    return rows.withColumn("_n", nth).withColumn("outcome", outcome).drop("_r", "_n")


class SessionTable:
    """Client sessions of one shard in order of use; the least recently used goes beyond ``capacity``."""

    def __init__(self, capacity: int = MAX_SESSIONS) -> None:
        self.capacity = capacity
        self.clients: OrderedDict[int, tuple[int, dict[int, int]]] = OrderedDict()

    def step(self, kind: str, client: int, series: int, responded: int, result: int) -> tuple[str, int]:
        """Outcome and result of one entry."""
        if kind == "noop":
            return "applied", result
        if kind == "register":
            if client in self.clients:
                self.clients.move_to_end(client)  # the lookup counts as use
                return "rejected", 0
            self.clients[client] = (0, {})
            if len(self.clients) > self.capacity:
                self.clients.popitem(last=False)
            return "applied", client
        if kind == "unregister":
            return ("applied", client) if self.clients.pop(client, None) else ("rejected", 0)
        if client not in self.clients:
            return "rejected", 0
        self.clients.move_to_end(client)
        upto, history = self.clients[client]
        if responded > upto:
            upto, history = responded, {s: r for s, r in history.items() if s > responded}
            self.clients[client] = (upto, history)
        if series <= upto:
            return "ignored", 0
        if series in history:
            return "cached", history[series]
        history[series] = result
        return "applied", result


class _Sessions:
    def __init__(self, capacity: int) -> None:
        self.table = SessionTable(capacity)

    def step(self, row) -> list[tuple]:
        return [(row.shard_id, row.idx, *self.table.step(row.kind, row.client_id, row.series_id, row.responded_to, row.cmd_len))]

    def end(self) -> list[tuple]:
        return []


def fold_sessions(log: DataFrame, capacity: int = MAX_SESSIONS) -> DataFrame:
    """The same with registration, closing and eviction: an ordered fold by shard (log with a ``kind`` column)."""
    rows = log.select("shard_id", "idx", "kind", "client_id", "series_id", "responded_to", "cmd_len")
    return ordered_fold(rows, ["shard_id"], ["idx"], lambda key: _Sessions(capacity), "shard_id long, idx long, outcome string, result long")


def save_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions (shard_id, client_id, responded_to, history) as the JSON text that a snapshot keeps."""
    return sessions.select("shard_id", "client_id", F.to_json(F.struct("client_id", "responded_to", "history")).alias("image"))


def recover_sessions(images: DataFrame) -> DataFrame:
    """Sessions of their images. Images of the first version keep a session's results as numbers, those of the second with their data."""
    common = "client_id long, responded_to long"
    first, second = F.from_json("image", f"{common}, history map<string,long>"), F.from_json("image", f"{common}, history map<string,struct<value:long,data:string>>")
    old = first["history"].isNotNull() & ~F.exists(F.map_values(first["history"]), lambda x: x.isNull())
    rows = images.select("shard_id", old.alias("_old"), first.alias("_a"), second.alias("_b"))
    new = F.when(F.col("_old"), F.transform_values("_a.history", lambda k, v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("data")))).otherwise(F.col("_b.history"))
    return rows.select("shard_id", F.coalesce("_a.client_id", "_b.client_id").alias("client_id"), F.coalesce("_a.responded_to", "_b.responded_to").alias("responded_to"), new.alias("history"))


def match_batch(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of a vectorised update beside their entries, by index; an index on one side only is a fault of the state machine."""
    both = inputs.select("shard_id", "idx", F.lit(True).alias("_in")).join(results.select("shard_id", "idx", "result", F.lit(True).alias("_out")), ["shard_id", "idx"], "full")
    return both.select("shard_id", "idx", "result", (F.col("_in").isNull() | F.col("_out").isNull()).alias("fault"))


def kv_state(log: DataFrame) -> DataFrame:
    """Key-value state of each shard: last value by index, count of writes."""
    return log.groupBy("shard_id", "k").agg(F.max_by("v", "idx").alias("v"), F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def merge_state(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """State after a snapshot and the entries above it."""
    both = snapshot.unionByName(kv_state(tail))
    return both.groupBy("shard_id", "k").agg(F.max_by("v", "last_idx").alias("v"), F.sum("n").alias("n"), F.max("last_idx").alias("last_idx"))


class StateMachine:
    """A user's deterministic fold over one shard's entries."""

    def update(self, idx: int, key: str, value: float) -> int:
        """Apply one entry; the number is its result."""
        raise NotImplementedError

    def lookup(self) -> Iterator[tuple[str, float]]:
        """All that the machine holds, which is also its snapshot."""
        raise NotImplementedError

    def recover(self, image: Iterator[tuple[str, float]]) -> None:
        """Take the state of a snapshot."""
        raise NotImplementedError


class LastValue(StateMachine):
    """The state machine that tests use: last value of each key."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {}

    def update(self, idx: int, key: str, value: float) -> int:
        self.values[key] = value
        return len(key)

    def lookup(self) -> Iterator[tuple[str, float]]:
        yield from sorted(self.values.items())

    def recover(self, image: Iterator[tuple[str, float]]) -> None:
        self.values.update(image)


class _Machine:
    """Snapshot rows of a shard (idx 0) come before its entries."""

    def __init__(self, shard: int, machine: type[StateMachine], results: bool) -> None:
        self.shard, self.machine, self.results, self.applied = shard, machine(), results, 0

    def step(self, row) -> list[tuple]:
        if not row.kind:
            self.machine.recover(iter([(row.k, row.v)]))
            self.applied = max(self.applied, row.idx)
            return []
        if row.idx <= self.applied:
            return []
        self.applied, result = row.idx, self.machine.update(row.idx, row.k, row.v)
        return [(self.shard, row.idx, result)] if self.results else []

    def end(self) -> list[tuple]:
        return [] if self.results else [(self.shard, k, v, self.applied) for k, v in self.machine.lookup()]


def run_machine(log: DataFrame, machine: type[StateMachine], snapshot: DataFrame | None = None, results: bool = False) -> DataFrame:
    """State of each shard under a user's machine, or with ``results`` each entry's result.

    ``snapshot`` (what an earlier run returned) is recovered first, and entries up to its applied
    index are skipped, so a state on disk goes on from where it was. The fold streams a shard's
    entries in order; folds that are sums or last values have ``kv_state``.
    """
    rows = log.select("shard_id", F.lit(1).alias("kind"), "idx", "k", "v")
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select("shard_id", F.lit(0).alias("kind"), F.col("applied").alias("idx"), "k", "v"))
    schema = "shard_id long, idx long, result long" if results else "shard_id long, k string, v double, applied long"
    return ordered_fold(rows, ["shard_id"], ["kind", "idx"], lambda key: _Machine(key[0], machine, results), schema)


def state_hashes(state: DataFrame) -> DataFrame:
    """A hash of each shard's key-value state, equal for equal states however they came about."""
    entry = F.concat_ws("=", "k", F.format_string("%.6f", F.col("v")))
    return state.groupBy("shard_id").agg(F.sum(F.xxhash64(entry).cast("decimal(38,0)")).cast("string").alias("state_hash"), F.count("*").alias("n_keys"))
