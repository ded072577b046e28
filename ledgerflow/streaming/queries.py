"""Structured Streaming forms: stateful apply, chunk assembly, timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ordered_fold
from ..operators.sessions import kv_state


class Apply(StatefulProcessor):
    """Applies each shard's entries once, in index order: an index at or below the applied one is a duplicate."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.applied = handle.getValueState("applied", "idx long")
        self.values = handle.getMapState("values", "k string", "v double, n long, last_idx long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values("idx")
        at = self.applied.get()[0] if self.applied.exists() else 0
        changed = {}
        for idx, k, v in zip(part["idx"], part["k"], part["v"], strict=True):
            if idx <= at:
                continue
            if idx != at + 1:
                raise ValueError(f"shard {key[0]}: entry {idx} follows {at}")
            at = idx
            seen = changed.get(k) or (self.values.getValue((k,)) if self.values.containsKey((k,)) else None)
            changed[k] = (v, (seen[1] if seen else 0) + 1, idx)
        self.applied.update((int(at),))
        for k, value in changed.items():
            self.values.updateValue((k,), (float(value[0]), int(value[1]), int(value[2])))
        yield pd.DataFrame([(key[0], k, *v) for k, v in changed.items()], columns=["shard_id", "k", "v", "n", "last_idx"])

    def close(self) -> None:
        pass


def apply_stream(log: DataFrame) -> DataFrame:
    """Changed keys of each shard's state after each micro-batch; needs the RocksDB state store."""
    return log.groupBy("shard_id").transformWithStateInPandas(Apply(), outputStructType="shard_id long, k string, v double, n long, last_idx long", outputMode="Update", timeMode="None")


def upsert_state(state_path: str):
    """A ``foreachBatch`` sink that keeps one row a key: newest index wins, so a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return write


def read_state(spark, state_path: str) -> DataFrame:
    rows = spark.read.parquet(state_path)
    return rows.groupBy("shard_id", "k").agg(F.max_by(F.struct("v", "n"), "last_idx").alias("x"), F.max("last_idx").alias("last_idx")).select("shard_id", "k", "x.v", "x.n", "last_idx")


def batch_state(log: DataFrame) -> DataFrame:
    """What the stream converges to."""
    return kv_state(log)


def idle_periods(events: DataFrame, ticks: int, key: str = "shard_id") -> DataFrame:
    """Activity sessions of each shard: a gap of ``ticks`` seconds is quiescence. Works on streams with a watermark."""
    return events.groupBy(key, F.session_window("ts", f"{ticks} seconds")).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Stream:
    def __init__(self, key: tuple) -> None:
        self.key, self.sender, self.n, self.chars, self.done = key, None, None, 0, 0

    def step(self, r) -> list[tuple]:
        if r.chunk_id == 0:
            self.sender, self.n, self.chars = r.sender, 1, len(r.data)
        elif self.n is None or r.chunk_id != self.n or r.sender != self.sender:
            return []
        else:
            self.n, self.chars = self.n + 1, self.chars + len(r.data)
        if self.n != r.chunk_count:
            return []
        out, self.n, self.done = [(*self.key, self.n, self.chars, True)], None, self.done + 1
        return out

    def end(self) -> list[tuple]:
        return [] if self.done else [(*self.key, self.n or 0, self.chars if self.n else 0, False)]


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """Snapshot streams put together: a chunk counts only if it is the next one of its sender; chunk 0 starts anew."""
    return ordered_fold(chunks, ["shard_id", "replica_id"], ["seq"], _Stream, "shard_id long, replica_id long, n_chunks long, n_chars long, complete boolean")


class _Limit:
    def __init__(self, limit: float, leave: float, hold: int) -> None:
        self.limit, self.leave, self.hold, self.limited, self.since = limit, leave, hold, False, None

    def step(self, r) -> list[tuple]:
        wanted = r.size > self.limit if not self.limited else r.size >= self.leave * self.limit
        if wanted != self.limited and (self.since is None or r.tick - self.since > self.hold):
            self.limited, self.since = wanted, r.tick
        return [(r.shard_id, r.tick, self.limited)]

    def end(self) -> list[tuple]:
        return []


def rate_limit(samples: DataFrame, limit: float, leave: float = 0.7, hold: int = 10) -> DataFrame:
    """Whether each shard is limited after each sample: enters above the limit, leaves below ``leave`` of it, holds for more than ``hold`` ticks."""
    return ordered_fold(samples, ["shard_id"], ["tick"], lambda key: _Limit(limit, leave, hold), "shard_id long, tick long, limited boolean")
