"""SimHash near-duplicates: fingerprints joined with themselves by a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, row_key, stored
from .components import connected_components

SHINGLE_WORDS = 3
MAX_DIFFERENCE = 2
SEED = 42
BLOCKS = 4
#: Node pairs that one step of the traversal holds at most before it works through them in parts.
FRONTIER = 400_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of one text; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = SHINGLE_WORDS
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(found.view(np.int64))], [*others, "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of each row; the long has the fingerprint's 64 bits."""
    return documents(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fingerprint long")


def trie_pairs(values: np.ndarray, starts: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in at most ``budget`` of their low ``bits`` bits.

    ``values`` is sorted within each group; ``starts`` are the groups' offsets and the end. Each
    group is a binary trie whose nodes are ranges of the sorted array. Pairs of nodes of one depth
    are traversed together; a pair whose paths differ in more than ``budget`` bits is pruned, and a
    pair of single values is settled by counting the bits that remain. The group's number above the
    value's bits makes one sorted array of all groups, in which a node's halves are found by search.
    """
    keys = values | np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts)) << np.uint64(bits)
    lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while todo:
        depth, al, ah, bl, bh, diff = todo.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            todo += [(depth, *(x[half:] for x in (al, ah, bl, bh, diff))), (depth, *(x[:half] for x in (al, ah, bl, bh, diff)))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            if near.any():
                yield a[near], b[near]
            al, ah, bl, bh, diff = (x[~single] for x in (al, ah, bl, bh, diff))
        if not len(al) or depth == bits:
            continue
        bit = np.uint64(1 << (bits - 1 - depth))
        middle = lambda low, bit=bit: np.searchsorted(keys, (keys[low] & ~(bit * np.uint64(2) - np.uint64(1))) | bit)
        am, bm, same = middle(al), middle(bl), al == bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        parts.append(tuple(x[~same] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        if keep.any():
            todo.append((depth + 1, *(x[keep] for x in (al, ah, bl, bh, diff))))


class LocalForest:
    """Smallest reachable index of each index, over pairs that arrive in parts."""

    def __init__(self, size: int) -> None:
        self.low = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.low[a], self.low[b]
            open_ = x != y
            if not open_.any():
                return
            x, y = x[open_], y[open_]
            np.minimum.at(self.low, np.maximum(x, y), np.minimum(x, y))
            while True:  # shorten paths
                nxt = self.low[self.low]
                if (nxt == self.low).all():
                    break
                self.low = nxt


#: The 64 bits as four blocks; each pair of blocks with the bits of the other two.
KEYS = [tuple(p) for p in combinations(range(BLOCKS), 2)]


def _halves(fps: np.ndarray, kept: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    width = 64 // BLOCKS
    block = lambda k: (fps >> np.uint64(width * k)) & np.uint64((1 << width) - 1)
    rest = [k for k in range(BLOCKS) if k not in kept]
    shift = np.uint64(width)
    return block(kept[0]) << shift | block(kept[1]), block(rest[0]) << shift | block(rest[1])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fingerprint) six times: two fingerprints that differ in two bits or fewer share two of four blocks."""
    for batch in batches:
        signed = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for which, kept in enumerate(KEYS):
            key, _ = _halves(signed.view(np.uint64), kept)
            bucket = (key | np.uint64(which) << np.uint64(32)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(signed)], ["bucket", "fingerprint"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (fingerprint, smallest linked fingerprint of the bucket) of rows sorted by bucket; carries the open bucket over."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the open bucket, put together once it ends

    def joined(buckets: np.ndarray, signed: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = np.flatnonzero(np.diff(buckets) == 0)
        if not len(same):
            return
        use = np.zeros(len(buckets), bool)  # a bucket of one has no pair
        use[same] = use[same + 1] = True
        buckets, signed = buckets[use], signed[use]
        which, fps, rest = buckets >> 32, signed.view(np.uint64), np.empty(len(buckets), np.uint64)
        for k, kept in enumerate(KEYS):
            mine = which == k
            rest[mine] = _halves(fps[mine], kept)[1]
        order = np.lexsort((rest, buckets))
        buckets, signed, rest = buckets[order], signed[order], rest[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        forest = LocalForest(len(buckets))
        for a, b in trie_pairs(rest, starts, 64 - 2 * (64 // BLOCKS), MAX_DIFFERENCE):
            forest.add(a, b)
        linked = np.flatnonzero(forest.low != np.arange(len(buckets)))
        yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[forest.low[linked]])], ["a", "b"])

    def whole() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        buckets, signed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fingerprint"))
        if not len(buckets):
            continue
        first = int(np.searchsorted(buckets, held[0][0][0], side="right")) if held else 0
        if first:
            held.append((buckets[:first], signed[:first]))
        if first < len(buckets):
            if held:
                yield from joined(*whole())
            last = int(np.searchsorted(buckets, buckets[-1]))
            yield from joined(buckets[first:last], signed[first:last])
            held = [(buckets[last:], signed[last:])]
    if held:
        yield from joined(*whole())


def _labels(marked: DataFrame) -> DataFrame:
    """(leaf, root, component_id) of each distinct fingerprint of ``marked``; component_id is the least id of the component."""
    nodes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "trie_leaves")
    # more partitions than cores: a bucket is small, and many near copies then share a task with little else
    links = (nodes.mapInArrow(_bucketed, "bucket long, fingerprint long").repartition("bucket")
             .sortWithinPartitions("bucket", "fingerprint").mapInArrow(_links, "a long, b long"))
    reached = connected_components(links)
    rooted = nodes.join(reached, nodes.fingerprint == reached.node, "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(lowest, "root").select(F.col("fingerprint").alias("leaf"), "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Fingerprints link at two or fewer differing bits; component_id is the smallest id that links
    reach. Rows with one fingerprint become one trie leaf before anything is joined, so groups of
    copies of any size cost one row. Distinct fingerprints are dealt to buckets by every pair of
    their four 16-bit blocks (two of four blocks are equal at two differing bits), and each bucket
    is joined with itself by a trie over the other 32 bits. A bucket yields a spanning forest, not
    its pairs. A bucket holds 8 bytes a distinct fingerprint, whatever the number of copies.

    A null or empty text has fingerprint zero and links like any other. A null id is returned and
    is never a component's id unless all ids of the component are null. Repeated rows are each
    returned. An empty table gives no rows; further columns of ``docs`` are not used.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    labels = _labels(marked).drop("root")
    return marked.join(labels, marked.fingerprint == labels.leaf, "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with its columns: the first by id, nulls last.

    Rows are ranked by their ids and 64-bit keys, so a null or repeated id decides nothing for other
    rows that have it. Of rows with equal id and text one is left; they are reduced within their tasks first.
    """
    keyed = documents(docs).select("doc_id", "text", row_key().alias("row_key"))
    marked = stored(keyed.mapInArrow(_fingerprints, "doc_id long, row_key long, fingerprint long"), "fingerprints")
    rows = marked.groupBy("fingerprint", "doc_id", "row_key").agg(F.count("*").alias("n"))
    labels = _labels(marked)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "n")).alias("first")
    members = stored(rows.join(labels, rows.fingerprint == labels.leaf).select("root", "doc_id", "row_key", "n"), "component_rows")
    kept = stored(members.groupBy("root").agg(first, F.sum("n").alias("size")).where("size > 1").select("root", F.col("first.row_key").alias("kept_key"), F.col("first.n").alias("n")), "kept_rows")
    # what goes is written and small where copies are few: Spark then broadcasts it, and the texts stay where they are
    gone = stored(members.join(kept.select("root", "kept_key", F.col("n").alias("kept_n")), "root").where("row_key <> kept_key or kept_n > 1").select(F.col("row_key").alias("gone_key")).distinct(), "dropped_rows")
    names = docs.columns
    once = docs.join(gone, row_key() == gone["gone_key"], "left_anti")
    if kept.where("n > 1").isEmpty():
        return once
    equal = docs.join(kept.where("n > 1"), row_key() == kept["kept_key"]).groupBy("kept_key").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return once.unionByName(equal.select("row.*"))
