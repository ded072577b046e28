"""Membership: accepted config changes and the members they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digest_long
from .folds import ordered_fold


def _same(a: str, b: str) -> bool:
    return a.strip().lower() == b.strip().lower()


class Members:
    """Roles of one shard's replicas."""

    def __init__(self, ordered: bool = False) -> None:
        self.ordered, self.change_id = ordered, 0
        self.voters: dict[int, str] = {}
        self.non_voting: dict[int, str] = {}
        self.witnesses: dict[int, str] = {}
        self.removed: set[int] = set()

    def accepts(self, change_id: int, kind: str, replica: int, address: str, initialize: bool) -> bool:
        everyone = [*self.voters.items(), *self.non_voting.items(), *self.witnesses.items()]
        adds = kind in ("AddNode", "AddNonVoting", "AddWitness")
        if self.ordered and not initialize and self.change_id != change_id:
            return False
        if kind == "RemoveNode":
            return not (len(self.voters) == 1 and replica in self.voters)
        if not adds or replica in self.removed:
            return adds and replica not in self.removed
        if kind == "AddNode" and replica in self.non_voting:
            return _same(self.non_voting[replica], address)  # a promotion keeps its address
        return not any(r == replica or _same(a, address) for r, a in everyone)

    def step(self, idx: int, change_id: int, kind: str, replica: int, address: str, initialize: bool) -> bool:
        if not self.accepts(change_id, kind, replica, address, initialize):
            return False
        self.change_id = idx
        for role in (self.voters, self.non_voting, self.witnesses):
            role.pop(replica, None)
        if kind == "RemoveNode":
            self.removed.add(replica)
        else:
            {"AddNode": self.voters, "AddNonVoting": self.non_voting, "AddWitness": self.witnesses}[kind][replica] = address
        return True


class _Changes:
    def __init__(self, ordered: bool) -> None:
        self.members = Members(ordered)

    def step(self, r) -> list[tuple]:
        m, ok = self.members, self.members.step(r.idx, r.config_change_id, r.type, r.replica_id, r.address, r.initialize)
        return [(r.shard_id, r.idx, ok, len(m.voters), len(m.non_voting), len(m.witnesses), len(m.removed))]

    def end(self) -> list[tuple]:
        return []


def fold_changes(changes: DataFrame, ordered: bool = False) -> DataFrame:
    """Every change with accepted and the members after it. Acceptance depends on earlier ones: an ordered fold by shard."""
    return ordered_fold(changes, ["shard_id"], ["idx"], lambda key: _Changes(ordered), "shard_id long, idx long, accepted boolean, voters long, non_voting long, witnesses long, removed long")


def new_member_faults(old: DataFrame, members: DataFrame) -> DataFrame:
    """New voters (shard_id, replica_id, address) that a repaired shard may not have, by its old members (with ``role``; removed ones too)."""
    known = old.select("shard_id", "replica_id", "role", F.col("address").alias("_before"))
    fault = (F.when((F.col("role") != "removed") & (F.col("_before") != F.col("address")), "address_changed").when(F.col("role") == "non_voting", "was_non_voting")
             .when(F.col("role") == "witness", "was_witness").when(F.col("role") == "removed", "was_removed"))
    return members.join(known, ["shard_id", "replica_id"]).select("shard_id", "replica_id", fault.alias("fault")).where("fault is not null")


def bootstrap_faults(records: DataFrame, recorded: DataFrame, incoming: DataFrame) -> DataFrame:
    """First fault of each start: records (shard_id, join, machine, now_join, now_machine), addresses recorded and incoming (shard_id, replica_id, address).

    Incoming addresses are compared trimmed and in lower case, as records keep them.
    """
    clean = incoming.select("shard_id", "replica_id", F.lower(F.trim("address")).alias("_now"))
    both = recorded.join(clean, ["shard_id", "replica_id"], "full").groupBy("shard_id").agg(
        F.count("address").alias("_recorded"), F.count("_now").alias("_incoming"), F.count_if(~F.col("address").eqNullSafe(F.col("_now"))).alias("_differ"))
    rows = records.join(both, "shard_id", "left").na.fill(0, ["_recorded", "_incoming", "_differ"])
    fault = (F.when((F.col("machine") != "unknown") & (F.col("machine") != F.col("now_machine")), "machine").when(~F.col("join") & (F.col("_recorded") == 0), "no_address")
             .when(F.col("join") & (F.col("_incoming") > 0), "members_of_joined").when(F.col("now_join") & (F.col("_recorded") > 0), "joins_as_initial")
             .when((F.col("_incoming") > 0) & (F.col("_differ") > 0), "members_differ"))
    return rows.select("shard_id", fault.alias("fault"))


def self_removed(replicas: DataFrame, members: DataFrame) -> DataFrame:
    """Replicas that are no longer members of their shard."""
    return replicas.join(members.select("shard_id", "replica_id").distinct(), ["shard_id", "replica_id"], "left_anti")


def member_hashes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """A hash of each shard's voters and last config change, equal for equal memberships."""
    ids = members.where("role = 'voter'").groupBy("shard_id").agg(F.array_join(F.sort_array(F.collect_list("replica_id")), ",").alias("_ids"))  # a handful of replicas
    return ids.join(changes.select("shard_id", "config_change_id"), "shard_id").select("shard_id", digest_long(F.concat_ws(";", "_ids", "config_change_id")).alias("member_hash"))
