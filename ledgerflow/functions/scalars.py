"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BATCH_SIZE, CHUNK_BYTES


def quorum(members: Column) -> Column:
    return F.shiftright(members.cast("long"), 1) + 1


def batch_id(idx: Column, size: int = BATCH_SIZE) -> Column:
    return F.call_function("div", idx, F.lit(size))


def batch_range(low: Column, high: Column, size: int = BATCH_SIZE) -> tuple[Column, Column]:
    """Half-open range of the batches that hold the half-open index range."""
    last = batch_id(high, size)
    return batch_id(low, size), F.when(high % size == 0, last).otherwise(last + 1)


def address_equal(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def snapshot_dir(idx: Column) -> Column:
    return F.concat(F.lit("snapshot-"), F.lpad(F.hex(idx), 16, "0"))


def snapshot_index(name: Column) -> Column:
    return F.conv(F.regexp_extract(name, r"^snapshot-([0-9A-F]{16})$", 1), 16, 10).cast("long")


def log_file(number: Column) -> Column:
    """Six digits at least; ``lpad`` alone would cut a longer number."""
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")), F.lit(".log"))


def log_file_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\d+)\.log$", 1).cast("long")


def partition_of(shard: Column, workers: int, capacity: int | None = None) -> Column:
    """Worker of a shard; with a capacity the storage part of that worker."""
    own = F.pmod(shard, F.lit(workers))
    return own if capacity is None else F.pmod(own, F.lit(capacity))


def header_fields(byte: Column) -> list[Column]:
    """Version, compression and session flag of an encoded payload's first byte."""
    return [F.shiftright(byte, 4).alias("version"), F.shiftright(byte.bitwiseAND(F.lit(14)), 1).alias("compression"), (byte.bitwiseAND(F.lit(1)) == 1).alias("has_session")]


def varint_bytes(value: Column) -> Column:
    """Bytes of a value in base-128 varint form."""
    return F.ceil(F.greatest(F.length(F.bin(value)), F.lit(1)) / 7).cast("long")


def snappy_bound(size: Column) -> Column:
    return 32 + size + (size / 6).cast("long")


def valid_address(address: Column) -> Column:
    """host:port, host a name or an IPv4 address, port 1 to 65535."""
    port = F.regexp_extract(address, r":(\d{1,5})$", 1).cast("int")
    return address.rlike(r"^[A-Za-z0-9]([A-Za-z0-9.\-]*[A-Za-z0-9])?:\d{1,5}$") & port.between(1, 65535)


def digest_long(text: Column) -> Column:
    """First eight bytes of an MD5 digest as sixteen hex digits, least byte first."""
    digits = F.md5(text.cast("binary"))
    return F.concat(*(F.substring(digits, at, 2) for at in range(15, 0, -2)))


def election_timeout(base: int, draw: Column) -> Column:
    """A timeout in [base, 2 * base) from a draw in [0, 1)."""
    return base + F.floor(draw * base)


def chunk_key(shard: Column, replica: Column, idx: Column) -> Column:
    return F.concat_ws(":", shard, replica, idx)


def external_file(file_id: Column) -> Column:
    return F.concat(F.lit("external-file-"), file_id)


def stored_payload(size: Column, block: int = CHUNK_BYTES) -> Column:
    """Bytes of a payload with a checksum of four bytes a block and a tail of sixteen."""
    return F.ceil(size / block) * 4 + size + 16


# --- entry, message and session predicates

PROPOSALS = ("Application", "Encoded", "Metadata")
# Message names by class, and results after which a request may be tried again.
NEVER_DROPPED = ("InstallSnapshot", "Unreachable", "SnapshotStatus")
LOCAL_MESSAGES = ("Election", "LeaderHeartbeat", "Unreachable", "SnapshotStatus", "CheckQuorum", "LocalTick", "BatchedReadIndex")
RESPONSES = ("ReplicateResp", "RequestVoteResp", "HeartbeatResp", "ReadIndexResp", "Unreachable", "SnapshotStatus", "LeaderTransfer")
FREE_ORDER = ("Replicate", "Ping")
TEMPORARY = ("SystemBusy", "ShardClosed", "ShardNotInitialized", "ShardNotReady", "Timeout", "Closed", "Aborted")
#: Sentinels that exceed a signed long, as the same bits say them: series to register and to close a session, counts of a stream's last and of a poisoned chunk.
REGISTER, UNREGISTER, LAST_CHUNK, POISON_CHUNK = -2, -1, -1, -2


def is_proposal() -> Column:
    return F.col("type").isin(*PROPOSALS)


def is_config_change() -> Column:
    return F.col("type") == "ConfigChange"


def is_session_managed() -> Column:
    return ~is_config_change() & (F.col("client_id") != 0)


def is_empty() -> Column:
    return ~is_config_change() & ~is_session_managed() & (F.col("cmd_len") == 0)


def entry_kind() -> Column:
    """register, unregister, update, noop session or other; sentinels are told by name, since they exceed a signed long."""
    return (F.when(is_config_change(), "config").when(F.col("client_id") == 0, "noop").when((F.col("cmd_len") == 0) & (F.col("series_id") == -2), "register")
            .when((F.col("cmd_len") == 0) & (F.col("series_id") == -1), "unregister").otherwise("update"))


def up_to_date(term: Column, idx: Column, own_term: Column, own_idx: Column) -> Column:
    """A candidate's last (term, index) is at least ours."""
    return (term > own_term) | ((term == own_term) & (idx >= own_idx))


def can_grant_vote(vote: Column, candidate: Column, term: Column, own_term: Column) -> Column:
    return (vote == 0) | (vote == candidate) | (term > own_term)


def snapshot_required(applied: Column, pushed: Column, last: Column, requested: Column, every: int) -> Column:
    """``every`` entries since the last snapshot and since the last request for one; 0 turns snapshots off."""
    return (F.lit(every) > 0) & (applied > last + every) & (pushed > last + every) & (applied > requested + every)


def compaction_index(idx: Column, override: Column, upto: Column, overhead: Column, default: int) -> Column:
    """Index up to which a log may go after a snapshot at ``idx``; null where nothing may."""
    keep = F.when(override, overhead).otherwise(default)
    return F.when(override & (upto > 0), F.when(idx >= upto + 1, upto)).when(idx > keep, idx - keep)


def can_drop(message: Column) -> Column:
    return ~message.isin(*NEVER_DROPPED)


def is_local_message(message: Column) -> Column:
    return message.isin(*LOCAL_MESSAGES)


def is_response(message: Column) -> Column:
    return message.isin(*RESPONSES)


def is_free_order(message: Column) -> Column:
    return message.isin(*FREE_ORDER)


def is_temporary(error: Column) -> Column:
    return error.isin(*TEMPORARY)


def is_empty_state(term: Column, vote: Column, commit: Column) -> Column:
    return (term == 0) & (vote == 0) & (commit == 0)


def same_state(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Term, vote and commit are all equal."""
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])


def is_last_chunk(count: Column, chunk: Column) -> Column:
    return (count == LAST_CHUNK) | (count == chunk + 1)


def is_last_file_chunk(count: Column, chunk: Column) -> Column:
    return count == chunk + 1


def is_poison_chunk(count: Column) -> Column:
    return count == POISON_CHUNK


def session_fault(client: Column, series: Column, responded: Column, shard: Column, wanted: Column) -> Column:
    """What forbids a session to propose to the wanted shard: null where it may; a response beyond the series is a broken session."""
    return (F.when((shard != wanted) | (client == 0) | series.isin(REGISTER, UNREGISTER), "invalid").when(responded > series, "broken"))


def valid_for_session_op(client: Column, series: Column, shard: Column, wanted: Column) -> Column:
    return (shard == wanted) & (client != 0) & series.isin(REGISTER, UNREGISTER)


def drops_vote_request(message_term: Column, own_term: Column, hint: Column, sender: Column, leader: Column, tick: Column, timeout: Column) -> Column:
    """A vote of a higher term is ignored while a leader was heard within the timeout, unless leadership is handed over."""
    return (message_term > own_term) & (hint != sender) & (leader != 0) & (tick < timeout)


def is_paused(state: Column) -> Column:
    """Followers that are waited for, or get a snapshot, are sent no entries."""
    return state.isin("wait", "snapshot")


def update_fault(commit: Column, last_apply: Column, last_save: Column) -> Column:
    """What forbids an update to be applied: uncommitted or unsaved entries, else null. A null index is of an empty list."""
    return F.when((commit > 0) & (last_apply > commit), "not_committed").when(last_apply > last_save, "not_saved")


def fast_apply(snapshot_idx: Column, last_apply: Column, first_save: Column, last_save: Column) -> Column:
    """Whether entries may be applied before others are saved: no snapshot, and the last one applied is not being saved."""
    return (snapshot_idx == 0) & ~F.coalesce(last_apply.between(first_save, last_save), F.lit(False))


def needs_sync(term: Column, vote: Column, before_term: Column, before_vote: Column) -> Column:
    """Hard state must reach the disk when term or vote changed."""
    return (term != before_term) | (vote != before_vote)
