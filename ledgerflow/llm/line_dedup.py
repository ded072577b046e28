"""Fuzzy line dedup by MinHash: banding, exact Jaccard verification and distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound, documents, stored
from .components import connected_components

SHINGLE = 8
SIMILARITY = 0.8
#: 12 bands of 4: a pair of similarity 0.8 shares a band with probability 0.998, one of 0.9 with 0.99999.
BANDS, ROWS = 12, 4
#: Lines of fewer words are left alone where not all lines are wanted: headings and short phrases repeat without being copies.
MIN_WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines laid end to end, and the lines' lengths; a line's last places run on into the next."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        power, width = _ODD, 1
        while width < SHINGLE:  # rolling hashes of 2, 4, 8 characters
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        return _mix(h), lengths


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash [line, BANDS * ROWS] of the character shingles of lines of at least ``SHINGLE`` characters.

    Each shingle falls in one bin by its hash and each bin keeps its least hash; an empty bin takes
    the next filled one's, with its distance mixed in, so that equal sets give equal signatures.
    """
    bins = BANDS * ROWS
    hashed, lengths = _hashes(lines)
    with np.errstate(over="ignore"):
        slot = ((hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
        slot += np.repeat(np.arange(len(lines)) * bins, lengths)[:len(slot)]
        seams = np.cumsum(lengths)[:-1]
        for back in range(1, SHINGLE):  # shingles that run on into the next line go to a spare bin
            slot[seams - back] = len(lines) * bins
        out = np.full(len(lines) * bins + 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(out, slot, hashed)
        out = out[:-1].reshape(len(lines), bins)
        own = np.arange(bins)
        filled = np.where(out == np.iinfo(np.uint64).max, 2 * bins, own)
        filled = np.concatenate([filled, filled + bins], axis=1)
        filled = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :bins]  # this bin or the next filled one
        return np.take_along_axis(out, filled % bins, axis=1) + (filled - own).astype(np.uint64) * _ODD


def band_keys(lines: list[str]) -> np.ndarray:
    """Band hashes [line, BANDS]."""
    rows = signatures(lines).reshape(len(lines), BANDS, ROWS)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, rows.shape[:2]).copy()
        for k in range(ROWS):
            out = _mix(out * _ODD + rows[:, :, k])
    return out.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key) of each distinct line of a batch."""
    for batch in batches:
        keys, first = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True)
        if not len(keys):
            continue
        norms, bands = batch.column("norm").take(pa.array(first)).to_pylist(), np.empty((len(keys), BANDS), np.int64)
        for at in range(0, len(keys), 512):  # what a turn works on stays in the processor's cache
            bands[at:at + 512] = band_keys(norms[at:at + 512])
        yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(keys, BANDS))], ["band", "key"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, center, key) for each key of a bucket but its center; rows come sorted by band alone, so a bucket is never held.

    The center is the least key of a bucket's first batch. A key that comes in several batches may be given again.
    """
    band, center, last = None, 0, 0
    for batch in batches:
        bands, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key"))
        if not len(bands):
            continue
        starts = np.concatenate([[bands[0] != band], bands[1:] != bands[:-1]])
        several = ~(starts & np.concatenate([starts[1:], [False]]))  # most keys are alone in their bucket; the last bucket may go on
        bands, keys = bands[several], keys[several]
        order = np.lexsort((keys, bands))  # bands are in order, so this only orders the keys of each
        bands, keys = bands[order], keys[order]
        starts = np.concatenate([[bands[0] != band], bands[1:] != bands[:-1]])
        centers = np.concatenate([[center], keys[starts]])[np.cumsum(starts)]
        more = (keys != centers) & np.concatenate([[starts[0] or keys[0] != last], (keys[1:] != keys[:-1]) | (bands[1:] != bands[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(bands[more]), pa.array(centers[more]), pa.array(keys[more])], ["band", "center", "key"])
        band, center, last = bands[-1], centers[-1], keys[-1]


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of two lines' character shingles."""
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x or y else float(a == b)


def _distinct(lines: list[str]) -> Iterator[np.ndarray]:
    """Each line's different shingle hashes in order."""
    hashes, lengths = _hashes(lines)
    ends = np.cumsum(lengths)
    for start, end in zip(ends - lengths, ends, strict=True):
        own = np.sort(hashes[start:end - SHINGLE + 1])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])]


def _alike(a: str, b: str, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two lines, whose different hashes are ``x`` and ``y``, reach the similarity.

    What their hashes share settles what is clear, with room for a hash that two shingles have; near
    the limit the shingle sets decide.
    """
    both = np.sort(np.concatenate([x, y]))
    total, common = len(x) + len(y), int(np.count_nonzero(both[1:] == both[:-1]))
    if common + 1 < SIMILARITY * (total - common - 1):
        return False
    return common - 1 >= SIMILARITY * (total + 2 - common + 1) or jaccard(a, b) >= SIMILARITY


#: Pairs that are verified at a time.
TURN = 64


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for at in range(0, len(batch), TURN):
            ones, others = (batch.column(c)[at:at + TURN].to_pylist() for c in ("norm_a", "norm_b"))
            lines = list(dict.fromkeys(ones + others))
            of = dict(zip(lines, _distinct(lines), strict=True))
            good += [_alike(a, b, of[a], of[b]) for a, b in zip(ones, others, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _split(batches: Iterator[pa.RecordBatch], all_lines: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
        rows = ([], [], [], [])
        for doc_id, text_hash, text in zip(ids, hashes, batch.column("text"), strict=True):
            if (text := text.as_py()) is None:
                continue
            own = [" ".join(line.lower().split()) for line in text.split("\n")]
            for column, values in zip(rows, ([doc_id] * len(own), [text_hash] * len(own), range(len(own)), own), strict=True):
                column.extend(values)
            if len(rows[0]) >= 8192:
                yield _line_batch(*rows, all_lines)
                rows = ([], [], [], [])
        if rows[0]:
            yield _line_batch(*rows, all_lines)


def _line_batch(ids: list, hashes: list, numbers: list[int], norms: list[str], all_lines: bool) -> pa.RecordBatch:
    keys = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in norms), np.uint64, len(norms)).view(np.int64)
    fit = [(all_lines or x.count(" ") >= MIN_WORDS - 1) and len(x) >= SHINGLE for x in norms]
    exact = [x != "" for x in norms] if all_lines else fit
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(norms, pa.string()), pa.array(keys), pa.array(fit, pa.bool_()), pa.array(exact, pa.bool_())],
        ["doc_id", "text_hash", "line_no", "norm", "key", "fit", "exact"])


def lines_of(docs: DataFrame, all_lines: bool = True) -> DataFrame:
    """(doc_id, text_hash, line_no, norm, key, fit, exact) of every line, written once; fit: long enough to be compared, exact: may equal another."""
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(rows.mapInArrow(partial(_split, all_lines=all_lines), "doc_id long, text_hash long, line_no int, norm string, key long, fit boolean, exact boolean"), "lines")


#: Bits of the map by which lines are sifted before a shuffle: 8 MB, whatever the number of lines.
SIEVE_BITS = 26


def _sieve(wanted: DataFrame) -> np.ndarray:
    """A bit map of the keys in ``wanted``. When it fills up it passes more lines on, never fewer."""
    bit = F.col("key").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    words = wanted.select(F.shiftrightunsigned(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits")).toArrow()
    out = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _sifted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            bit = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << SIEVE_BITS) - 1)
            yield batch.filter(pa.array((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return run


def _texts(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, norm) of the keys in ``wanted``, written."""
    sieve = wanted.sparkSession.sparkContext.broadcast(_sieve(wanted))
    some = lines.mapInArrow(_sifted(sieve), "key long, norm string")
    return stored(some.groupBy("key").agg(F.first("norm").alias("norm")).join(wanted, "key", "left_semi"), "candidate_lines")


def _verified(candidates: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of ``candidates`` whose lines reach the similarity, written, and the texts of all lines in ``candidates``."""
    candidates = stored(candidates, "line_pairs")
    wanted = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
    texts = _texts(wanted, lines)
    one, other = (texts.select(F.col("key").alias(c), F.col("norm").alias(f"norm_{c}")) for c in "ab")
    return stored(candidates.join(other, "b").join(one, "a").mapInArrow(_verify, "a long, b long"), "line_links"), texts


#: Lines of a bucket that one group compares; a larger bucket is compared block by block.
BLOCK = 4096
#: Bits of the map of a line's shingles.
MAP_BITS = 2048


def _shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def _maps(lines: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bit map [line, word] of each line's hashed shingles, and each line's different hashes in order."""
    out, hashed = np.zeros((len(lines), MAP_BITS), np.uint8), []
    for at in range(0, len(lines), 64):
        for i, own in enumerate(_distinct(lines[at:at + 64]), at):
            out[i, (own & np.uint64(MAP_BITS - 1)).view(np.int64)] = 1
            hashed.append(own)
    return np.packbits(out, axis=1).view(np.uint64), hashed


def cross_links(keys: list[int], components: list[int], sides: list[int], norms: list[str]) -> list[tuple[int, int]]:
    """Links that join lines of different components, enough of them to connect whatever the group connects.

    Pairs on one side only are left to the group that has them on both (sides are equal there). Maps
    of hashed shingles bound what two lines can share from above, so a pair that they rule out is
    not similar; ``_alike`` settles the others.
    """
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    lines = [norms[i] for i in order]
    keys, sides = [keys[i] for i in order], np.array([sides[i] for i in order])
    own = np.unique([components[i] for i in order], return_inverse=True)[1]
    across = len(set(sides.tolist())) > 1
    maps, hashed = _maps(lines)
    sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
    lost = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64) + 1
    found = []
    for i in range(len(keys) - 1):
        apart = own[i + 1:] != own[i]
        if across:
            apart &= sides[i + 1:] != sides[i]
        rest = np.flatnonzero(apart) + i + 1
        if len(rest):
            most = np.bitwise_count(maps[rest] & maps[i]).sum(axis=1, dtype=np.int64) + np.minimum(lost[rest], lost[i])
            rest = rest[most >= SIMILARITY * (sizes[rest] + sizes[i] - most)]
        for j in rest.tolist():
            if own[j] != own[i] and _alike(lines[i], lines[j], hashed[i], hashed[j]):
                found.append((keys[i], keys[j]))
                own[own == own[j]] = own[i]
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of components that a group links; groups come sorted by (band, x, y), only the open one is held, and its size is bounded."""
    names = ("key", "c", "side", "norm")
    held, group = [], None

    def joined() -> set[tuple[int, int]]:
        of = {row[0]: row[1] for row in held}
        return {(of[a], of[b]) for a, b in cross_links(*map(list, zip(*held, strict=True)))} if held else set()

    for batch in batches:
        places = list(zip(*(batch.column(c).to_pylist() for c in ("band", "x", "y")), strict=True))
        rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        links = set()
        for place, row in zip(places, rows, strict=True):
            if place != group:
                links |= joined()
                held, group = [], place
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
    links = joined()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def line_links(lines: DataFrame) -> DataFrame:
    """(node, component) of lines that have a verified near-duplicate.

    Each band bucket is first a star around one of its keys: star pairs are verified and united.
    Where all lines of a bucket are then connected it holds no further link between components, and
    a bucket of two lines has no pair but the star's. The
    other buckets, each set of lines once, get their lines' texts and are compared in full, except for
    pairs that are connected already; what leaves a task are links between components, not pairs,
    and the second union-find runs over components. A bucket of more than ``BLOCK`` lines
    is dealt as pairs of blocks. So no pair of a bucket that could join two components is left out,
    no bucket is capped, and no task holds more than two blocks.
    """
    fit = lines.where("fit").select("key", "norm")
    stars = stored(
        fit.mapInArrow(_bands, "band long, key long").repartition("band").sortWithinPartitions("band").mapInArrow(_stars, "band long, center long, key long"),
        "line_buckets")
    edges, texts = _verified(stars.select(F.least("center", "key").alias("a"), F.greatest("center", "key").alias("b")).distinct(), fit)
    groups = stored(connected_components(edges), "line_groups")
    members = stars.select("band", "key").unionByName(stars.select("band", F.col("center").alias("key"))).distinct()
    labelled = members.join(groups, members.key == groups.node, "left").select("band", "key", F.coalesce("component", "key").alias("c"))
    # bands that have the same lines together need one comparison: their sets are told by size and a sum of hashes
    lines_of_band = F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("lines")
    several = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), lines_of_band).where("low <> high and n > 2")
    several = several.groupBy("n", "lines").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = stored(labelled.join(several, "band"), "open_buckets")
    if members.isEmpty():
        return groups
    own = F.pmod(F.xxhash64("key"), F.col("blocks"))
    dealt = members.select("band", "key", "c", own.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.join(texts, "key")
    dealt = dealt.select("band", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "key", "c", "side", "norm")
    found = dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_compared, "a long, b long")
    united = connected_components(found)  # of components, so the stars' edges are not walked again
    alone = united.select("node", F.col("node").alias("component"))
    now, above = groups.unionByName(alone).distinct(), united.select(F.col("node").alias("of"), F.col("component").alias("root"))
    return stored(now.join(above, now.component == above.of, "left").select("node", F.coalesce("root", "component").alias("component")), "line_groups")


def dedup_lines(docs: DataFrame, all_lines: bool = True) -> DataFrame:
    """(doc_id, text_hash, line_no, class_doc_id, class_line_no, kept) of every line of every document.

    Lines are compared in lower case with white space collapsed. Lines that are equal, or whose
    8-character shingles have a Jaccard similarity of 0.8 or more, are linked, and linked lines are a
    class; its first line by (doc_id, line_no) is kept and names the class. Empty lines are always
    kept and are their own class; every other line is in the class of its equals, and lines of eight
    characters or more are compared, however few blanks they have. Without ``all_lines`` lines of
    fewer than five words or eight characters are left alone like empty ones. Equal lines are one node (a 64-bit hash of the line), counted within each task before the shuffle.

    A null text has no lines, an empty one has one empty line. A null id comes after all others.
    Repeated rows share the place of their lines, so copies of one row under one id are treated
    alike. Other columns are not used; an empty table gives no rows.
    """
    lines = lines_of(docs, all_lines)
    groups = line_links(lines)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "text_hash")
    firsts = lines.where("exact").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classes = firsts.join(groups, firsts.key == groups.node, "left").select("key", "first", "n", F.coalesce("component", "key").alias("class"))
    keepers = classes.groupBy("class").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")  # a class of one line decides nothing
    known = classes.join(keepers.drop("n"), "class").select(F.col("key").alias("line_key"), "keep")
    found = lines.select("doc_id", "text_hash", "line_no", "key", "exact").join(known, F.col("exact") & (F.col("key") == F.col("line_key")), "left")
    itself = F.col("keep").isNull()
    return found.select(
        "doc_id", "text_hash", "line_no", F.when(itself, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_doc_id"),
        F.when(itself, F.col("line_no")).otherwise(F.col("keep.line_no")).alias("class_line_no"),
        (itself | F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no")) & (F.col("text_hash") == F.col("keep.text_hash"))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, all_lines: bool = True) -> DataFrame:
    """``docs`` with the lines that are not kept taken out of their texts; a document that loses all its lines goes."""
    dropped = dedup_lines(docs, all_lines).where("not kept").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("lines"))
    dropped = dropped.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "lines")
    hits = docs["doc_id"].cast("long").eqNullSafe(dropped["of_doc"]) & (F.xxhash64(docs["text"].cast("string")) == dropped["of_text"])
    names = docs.columns
    # numbers that stay are a set difference, in proportion to a text's lines however many of them go
    stay = lambda split: F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "lines"), lambda i: F.get(split, i))
    left = bound(F.split("text", "\n"), stay)
    joined = docs.join(dropped, hits, "left").withColumn("left_lines", F.when(F.col("lines").isNotNull(), left))
    joined = joined.where("left_lines is null or exists(left_lines, x -> trim(x) <> '')")
    text = F.when(F.col("left_lines").isNull(), F.col("text")).otherwise(F.array_join("left_lines", "\n"))
    return joined.select(*(text.alias(c) if c == "text" else docs[c] for c in names))
