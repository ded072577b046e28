"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, portions
from .common import documents, stored

END_OF_TEXT = 50256
ROUNDS = 6
#: slot, document id, sequence number within the document, tokens in use, 1 where the id is null; all big-endian
HEADER_BYTES = 8 + 8 + 4 + 4 + 4
SEQUENCE = "shard_id int, slot long, doc_id long, seq_no int, n_tokens int, tokens binary"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(ordinals: np.ndarray, size: int, key: int) -> np.ndarray:
    """Slots of ``ordinals`` under a keyed permutation of range(size).

    A balanced Feistel network permutes the smallest even-bit power of two that holds ``size``;
    values beyond ``size`` walk along their cycle until they fall within it.
    """
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = ordinals.astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            left, right = out[walking] >> shift, out[walking] & low
            for turn in range(ROUNDS):
                left, right = right, left ^ (_mix(right + np.uint64(turn << 40), key) & low)
            out[walking] = left << shift | right
            walking = walking[out[walking] >= size]
    return out.astype(np.int64)


@cache
def _encoder(name: str) -> Encoder:
    """The encoder of a rank file; a worker that runs several tasks keeps it."""
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in file)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Encoder(lambda texts: [encode(x) for x in texts])


def _counter(name: str, seq_len: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = _encoder(name), 0
        for batch in batches:
            for _, texts in portions(batch):
                n = encoder.counts(texts)
                total += int((-(-(n + 1) // seq_len))[n > 0].sum())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [total]})

    return count


def _sequencer(name: str, seq_len: int, shared, size: int, key: int, rows_per_shard: int):
    def emit(ids: list, numbers: list, lengths: list, payloads: list, first: int) -> pa.RecordBatch:
        slots = permute(np.arange(first, first + len(ids)), size, key)
        return pa.RecordBatch.from_arrays(
            [pa.array((slots // rows_per_shard).astype(np.int32)), pa.array(slots), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lengths, pa.int32()), pa.array(payloads, pa.binary())],
            ["shard_id", "slot", "doc_id", "seq_no", "n_tokens", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (first, end) = _encoder(name), shared.value[TaskContext.get().partitionId()]
        at, rows = first, ([], [], [], [])
        for batch in batches:
            for start, texts in portions(batch):
                tokens, edges = encoder.ids(texts)
                packed, edges = tokens.astype("<u2").tobytes(), (2 * edges).tolist()
                for doc_id, lo, hi in zip(batch.column("doc_id").slice(start, len(texts)).to_pylist(), edges, edges[1:], strict=False):
                    if lo == hi:
                        continue
                    own = packed[lo:hi] + END_OF_TEXT.to_bytes(2, "little")
                    for k in range(0, len(own), 2 * seq_len):
                        piece = own[k:k + 2 * seq_len]
                        for x, y in zip(rows, (doc_id, k // (2 * seq_len), len(piece) // 2, piece), strict=True):
                            x.append(y)
                if len(rows[0]) >= 8192:
                    yield emit(*rows, at)
                    at, rows = at + len(rows[0]), ([], [], [], [])
        if at + len(rows[0]) != end:
            raise ValueError("the input's partitions changed between the two passes; call with stable=False")
        if rows[0]:
            yield emit(*rows, at)

    return run


def stride(seq_len: int) -> int:
    """Bytes of a record: header, token ids of two bytes each, and a line feed."""
    return HEADER_BYTES + 2 * seq_len + 1


def materialise(docs: DataFrame, out: str, key: int = 0x5EED, seq_len: int = 256, rows_per_shard: int = 8192,
                tokenizer: str = "byte_bpe_50k.tiktoken", stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all token sequences of ``docs`` below ``out`` in training order; returns their number.

    A text gives sequences of ``seq_len`` tokens, the last one shorter and closed by end-of-text.
    One pass counts each partition's sequences (one number a partition reaches the driver), so
    that each sequence has a dense ordinal; a Feistel permutation makes it a global slot. Slot
    ranges of ``rows_per_shard`` are the partitions of the only shuffle, and each is one file of
    records of equal length, written by Spark's text sink (binary as text, a line feed as the last
    byte of the record), so it goes to any store and commits like any other output. Tokens are
    encoded twice rather than kept: that is cheaper in disk than a copy of the corpus.

    ``stable`` says that two scans of ``docs`` give the same partitions, as plain file scans do;
    otherwise the input is first stored. A pass that finds another count fails. Null and empty
    texts give no sequence, a null id is kept by a flag, repeated rows each have their own slots.
    Other columns are not used; an empty table writes a manifest and no shard.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    if not stable:
        rows = stored(rows, "sequence_input")
    counts = {r.part: r.n for r in rows.mapInArrow(_counter(tokenizer, seq_len), "part long, n long").collect()}
    places, size = {}, 0
    for part in sorted(counts):
        places[part], size = (size, size + counts[part]), size + counts[part]
    if size:
        shards = -(-size // rows_per_shard)
        placed = rows.mapInArrow(_sequencer(tokenizer, seq_len, spark.sparkContext.broadcast(places), size, key, rows_per_shard), SEQUENCE)
        number = lambda x, digits: F.unhex(F.lpad(F.hex(x.cast("long") if digits == 16 else x), digits, "0"))
        record = F.concat(
            number(F.col("slot"), 16), number(F.coalesce("doc_id", F.lit(0)), 16), number(F.col("seq_no"), 8), number(F.col("n_tokens"), 8),
            number(F.col("doc_id").isNull().cast("int"), 8), F.rpad(F.col("tokens"), 2 * seq_len, F.lit(b"\0")))
        (placed.repartitionById(shards, F.col("shard_id")).sortWithinPartitions("shard_id", "slot")
         .select("shard_id", record.cast("string").alias("record"))
         .write.partitionBy("shard_id").option("compression", "none").option("lineSep", "\n").text(f"{out}/shards"))
    about = [(size, seq_len, rows_per_shard, stride(seq_len), str(key), tokenizer)]
    spark.createDataFrame(about, "size long, seq_len int, rows_per_shard int, stride int, key string, tokenizer string").coalesce(1).write.json(f"{out}/manifest")
    return size


def _parser(record: int, rows_per_shard: int, start: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard_id").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw.size % record:
                    raise ValueError(f"shard {shard}: {raw.size} bytes are no whole records of {record}")
                data = np.frombuffer(raw, np.uint8).reshape(-1, record)
                first = max(0, start - shard * rows_per_shard)
                for at in range(first, len(data), 4096):
                    part = data[at:at + 4096]
                    field = lambda lo, hi, kind, part=part: np.ascontiguousarray(part[:, lo:hi]).view(kind)[:, 0]
                    slot, doc, null, n = field(0, 8, ">i8"), field(8, 16, ">i8"), field(24, 28, ">i4"), field(20, 24, ">i4")
                    used = np.arange(record - 1 - HEADER_BYTES) < 2 * n[:, None]
                    ends = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                    tokens = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(part[:, HEADER_BYTES:-1][used])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), shard, np.int32)), pa.array(slot.astype(np.int64)), pa.array(doc.astype(np.int64), mask=null == 1), pa.array(field(16, 20, ">i4").astype(np.int32)), pa.array(n.astype(np.int32)), tokens],
                        ["shard_id", "slot", "doc_id", "seq_no", "n_tokens", "tokens"])

    return parse


def read_shards(spark: SparkSession, out: str, start: int = 0) -> DataFrame:
    """The sequences below ``out`` from slot ``start`` on; shards before it are not opened.

    A record's place is its slot: shard ``slot // rows_per_shard``, byte ``slot % rows_per_shard *
    stride``. So a reader resumes anywhere without an index.
    """
    about = spark.read.schema("size long, seq_len int, rows_per_shard int, stride int").json(f"{out}/manifest").first()
    if not about.size:
        return spark.createDataFrame([], SEQUENCE)
    files = spark.read.format("binaryFile").load(f"{out}/shards").where(F.col("shard_id") >= start // about.rows_per_shard)
    return files.select(F.col("shard_id").cast("int").alias("shard_id"), "content").mapInArrow(_parser(about.stride, about.rows_per_shard, start), SEQUENCE)
