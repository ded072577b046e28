"""Scores of the bigram model in which every bigram counts: near ones by a broadcast filter, far ones where their tokens meet.

Tokens travel as packs, arrays of integers of many tokens; a pack's columns are laid out byte by byte,
so that Spark's compression finds the bytes that are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom_lm as lm
from .bpe import portions
from .common import id_remainder, stored

#: Bigrams that are near at most, occurrences in ``FLUSH`` tokens that make one a candidate, and far tokens of a part.
NEAR_PAIRS, OFTEN, PART = 250_000, 4, 1_000_000
#: Bits of a known word's place, of the near bigrams' first look, of a block of rows and of contexts that are summed together.
PLACE_BITS, LOOK_BITS, BLOCK_BITS, SLICE_BITS = 20, 22, 12, 16
WORD, CANDIDATE, FLUSHED = 0, 1, 2
#: Kinds of packs: both words of a bigram known, the second or the first one rare or both; counts of near bigrams; masses of contexts.
BOTH, RARE_WORD, RARE_CONTEXT, RARE, NEAR, MASS = range(6)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(*columns: np.ndarray) -> tuple:
    """(type, bytes) of each column, first bytes of all values first."""
    return tuple((x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) for x in columns)


def unpack(columns: tuple) -> list[np.ndarray]:
    out = []
    for kind, data in columns:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def _joined(packs: list[tuple], types: str) -> list[np.ndarray]:
    """Columns of packs laid end to end; without packs, empty columns of ``types``."""
    return [np.concatenate(x) for x in zip(*map(unpack, packs), strict=True)] if packs else [np.zeros(0, t) for t in types.split()]


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, of bigrams that are frequent among the tokens counted at once, and of such countings."""

    def counts() -> Iterator[pa.RecordBatch]:
        for kind, column, least in ((WORD, 0, 1), (CANDIDATE, 1, OFTEN)):
            keys, n = np.unique(np.concatenate([x[column] for x in held]), return_counts=True)
            keys, n = keys[n >= least], n[n >= least]
            for at in range(0, len(keys), 1 << 16):
                own = slice(at, at + (1 << 16))
                yield rows(kind, keys[own], n[own])
        yield rows(FLUSHED, np.zeros(1, np.uint64), np.ones(1, np.int64))

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    tokens, held, size = lm.Tokens(), [], 0
    for batch in batches:
        for _, texts in portions(batch, most=lm.TOGETHER):
            keys, sizes = tokens(texts)
            held.append((keys, lm.pairs_of(keys, sizes)[1]))
            size += len(keys)
            if size >= lm.FLUSH:
                yield from counts()
                held, size = [], 0
    if size:
        yield from counts()


class Near:
    """Ordered keys of known words and of near bigrams; numbers words by place, contexts too, of which the start is the last."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.words, self.pairs = words, pairs

    def tables(self) -> Near:
        if not hasattr(self, "look"):
            self.look = np.zeros(1 << LOOK_BITS, bool)
            self.look[self.pairs >> np.uint64(64 - LOOK_BITS)] = True
        return self

    def __call__(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's context and place, its context's place (-1: rare), the tokens whose bigrams are near, and places of these bigrams."""
        words, which = np.unique(tokens, return_inverse=True)
        place = lm._places(words, self.words)[which]
        before = lm._after_each(place, sizes, len(self.words))
        context, keys = lm.pairs_of(tokens, sizes)
        maybe = np.flatnonzero(self.look[keys >> np.uint64(64 - LOOK_BITS)] & (place >= 0) & (before >= 0))
        pair = lm._places(keys[maybe], self.pairs)
        return context, place, before, maybe[pair >= 0], pair[pair >= 0]


def _deal(near: Broadcast, parts: int):
    """Packs of the tokens whose bigrams are not near, by the part in which they meet, and training counts of near bigrams.

    A rare word's tokens meet by the word, others by the bigram: what is frequent is known and near, so no part is large.
    """

    def packs(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, tuple]]:
        context, word, before, place, row = map(np.concatenate, zip(*held, strict=True))
        base = int(row[0]) >> 1
        row = (row - 2 * base).astype(np.uint32)
        kind = np.where(before >= 0, np.where(place >= 0, BOTH, RARE_WORD), np.where(place >= 0, RARE_CONTEXT, RARE))
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            c = before[own].astype(np.uint32) if k in (BOTH, RARE_WORD) else context[own]
            w = place[own].astype(np.uint32) if k in (BOTH, RARE_CONTEXT) else word[own]
            with np.errstate(over="ignore"):
                if k == BOTH:
                    both = (c.astype(np.uint64) << np.uint64(PLACE_BITS)) | w
                    part = lm._within(lm._mix(both * _ODD), parts)
                    order = np.argsort((part << np.uint64(2 * PLACE_BITS)) | both)
                else:
                    part = lm._within(lm._mix((c if k == RARE_CONTEXT else w) * _ODD), parts)
                    order = np.argsort(part, kind="stable")
            part = part[order]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            c, w, r = c[order], w[order], row[own][order]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                first = np.diff(c[lo:hi], prepend=c.dtype.type(0)) if k == BOTH else c[lo:hi]  # ordered: steps are small
                yield int(part[lo]), (int(k), base, pack(first, w[lo:hi], r[lo:hi]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        table, tokens_of, held, size = near.value.tables(), lm.Tokens(), [], 0
        counts, contexts = np.zeros(len(table.pairs), np.int64), np.zeros(len(table.pairs), np.uint32)
        for batch in batches:
            rows = 2 * batch.column("row").to_numpy(zero_copy_only=False) + batch.column("held_out").to_numpy(zero_copy_only=False)
            for at, texts in portions(batch, most=lm.TOGETHER):
                tokens, sizes = tokens_of(texts)
                row = np.repeat(rows[at:at + len(texts)], sizes)
                context, place, before, at_, pair = table(tokens, sizes)
                learnt = row[at_] & 1 == 0
                counts += np.bincount(pair[learnt], minlength=len(counts))
                contexts[pair] = before[at_]
                far = np.ones(len(tokens), bool)
                far[at_] = False
                if held and int(row[0]) - int(held[0][-1][0]) >= 1 << 32:
                    yield from packs(held)
                    held, size = [], 0
                held.append((context[far], tokens[far], before[far], place[far], row[far]))
                size += len(held[-1][0])
                if not len(held[-1][0]):
                    held.pop()
                if size >= lm.FLUSH:
                    yield from packs(held)
                    held, size = [], 0
        if held:
            yield from packs(held)
        at = np.flatnonzero(counts)
        for own in np.split(at, np.flatnonzero(np.diff(at >> 12)) + 1) if len(at) else []:
            yield int(own[0] >> 12) % parts, (NEAR, 0, pack(own.astype(np.uint32), contexts[own], counts[own]))

    return run


def _binary(run):
    """``run`` as a function of Arrow batches whose result is (part, pickled pack)."""
    import pickle

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, value in run(given):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "pack": pa.array([pickle.dumps(value, 5)], pa.binary())})

    return batches


def _loaded(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    import pickle

    for row in rows:
        yield row[0], pickle.loads(row[1])


def _grouped(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one token, training count) of each different key, and each token's key."""
    keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first, np.bincount(which[learnt], minlength=len(keys)), which


def _levels(n: np.ndarray, least: float = 1.0) -> np.ndarray:
    """Levels of counts, 0 for 0."""
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.floor(np.log(n / least) / np.log(lm.LEVEL) + 1e-9) + 1, 0).astype(np.int64)


def _over(shown: np.ndarray) -> np.ndarray:
    return np.where(shown > 0, shown - lm.DISCOUNT, 0.0)


class Meeting:
    """Tokens of a part with their bigrams' quantised counts; contexts are places (both, rare_word) or keys (rare, rare_context)."""

    def __init__(self, packs: Iterator[tuple[int, tuple]]) -> None:
        kept: dict[int, list] = {k: [] for k in range(6)}
        for _, (kind, base, columns) in packs:
            columns = unpack(columns)
            if kind == BOTH:
                columns[0] = np.cumsum(columns[0], dtype=np.uint32)
            if kind != NEAR:
                columns[2] = columns[2].astype(np.int64) + 2 * base
            kept[kind].append(columns)
        laid = lambda k, types: [np.concatenate(x) for x in zip(*kept[k], strict=True)] if kept[k] else [np.zeros(0, t) for t in types.split()]
        self.near = laid(NEAR, "u4 u4 i8")
        self.both, self.rare_word = laid(BOTH, "u4 u4 i8"), laid(RARE_WORD, "u4 u8 i8")
        self.rare_context, self.rare = laid(RARE_CONTEXT, "u8 u4 i8"), laid(RARE, "u8 u8 i8")

    def bigrams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens' contexts, place of one token of each bigram, its quantised count, tokens' bigrams) of known contexts."""
        for c, w, row in (self.both, self.rare_word):
            with np.errstate(over="ignore"):
                keys = (c.astype(np.uint64) << np.uint64(PLACE_BITS)) | w if w.dtype == np.uint32 else lm._mix(w * _ODD + c)
            first, n, which = _grouped(keys, row & 1 == 0)
            yield c, first, lm.count_of(_levels(n), 1.0), which


def _masses(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
    """What the part's bigrams take of each known context, and the near bigrams' counts."""
    meeting = Meeting(packs)
    places, counts = meeting.near[0], meeting.near[2]
    if len(places):
        first, _, which = _grouped(places, np.zeros(len(places), bool))
        n = np.bincount(which, weights=counts).astype(np.int64)
        yield 0, (NEAR, 0, pack(places[first], meeting.near[1][first], n))
    taken = [(c[first], _over(shown)) for c, first, shown, _ in meeting.bigrams()]
    contexts, which = np.unique(np.concatenate([x[0] for x in taken]), return_inverse=True)
    mass = np.bincount(which, weights=np.concatenate([x[1] for x in taken]), minlength=len(contexts))
    for own in np.split(np.arange(len(contexts)), np.flatnonzero(np.diff(contexts >> np.uint32(SLICE_BITS))) + 1) if len(contexts) else []:
        yield int(contexts[own[0]] >> SLICE_BITS), (MASS, 0, pack(contexts[own], mass[own]))


def _added(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Sums of the masses of the contexts of some slices; counts of near bigrams as they are."""
    sums: dict[int, np.ndarray] = {}
    for key, (kind, _, columns) in packs:
        if kind == NEAR:
            yield NEAR, columns
            continue
        contexts, mass = unpack(columns)
        sums.setdefault(key, np.zeros(1 << SLICE_BITS))[contexts & np.uint32((1 << SLICE_BITS) - 1)] += mass
    for key, mass in sums.items():
        at = np.flatnonzero(mass)
        yield MASS, pack((at + (key << SLICE_BITS)).astype(np.uint32), mass[at])


class Shares:
    """What workers need for scores: of known words the probability and base score, of contexts what they give and a count's part, counts of near bigrams."""

    def __init__(self, p: np.ndarray, base: np.ndarray, give: np.ndarray, part: np.ndarray, shown: np.ndarray, total: float) -> None:
        self.p, self.base, self.give, self.part, self.shown, self.total = p, base, give, part, shown, total


def _log(p: np.ndarray, give: np.ndarray, part: np.ndarray, shown: np.ndarray) -> np.ndarray:
    return np.log10(np.minimum(1.0, p * give + part * _over(shown)))


def _sums(rows: np.ndarray, far: np.ndarray, base: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """Packs of the sums of each row, by blocks of rows."""
    rows, which = np.unique(rows, return_inverse=True)
    sums = [np.bincount(which, weights=x, minlength=len(rows)) for x in (far, base, known)]
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows >> BLOCK_BITS)) + 1) if len(rows) else []:
        block = int(rows[own[0]]) >> BLOCK_BITS
        extra = (sums[1][own], sums[2][own].astype(np.uint32)) if sums[1][own].any() else ()  # few have rare words
        yield block, pack((rows[own] - (block << BLOCK_BITS)).astype(np.uint16), sums[0][own], *extra)


def _rare_words(meeting: Meeting, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability, base score and training count of the rare words of the part's tokens, those after known contexts first."""
    words = np.concatenate([meeting.rare_word[1], meeting.rare[1]])
    _, n, which = _grouped(words, np.concatenate([meeting.rare_word[2], meeting.rare[2]]) & 1 == 0)
    return ((lm.count_of(_levels(n), 1.0) + 0.5) / total)[which], np.log10((n + 0.5) / total)[which], n[which]


def _scored(shares: Broadcast):
    """Sums of the part's tokens with known contexts, and base scores of rare words."""

    def run(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        x, meeting = shares.value, Meeting(packs)
        p, base, n = _rare_words(meeting, x.total)
        (c, _, shown, bigram), (c_, _, shown_, bigram_) = meeting.bigrams()
        far = _log(x.p[meeting.both[1]], x.give[c], x.part[c], shown[bigram])
        zero = np.zeros(len(c))
        yield from _sums(meeting.both[2] >> 1, far, zero, zero)
        far = _log(p[:len(c_)], x.give[c_], x.part[c_], shown_[bigram_])
        yield from _sums(np.concatenate([meeting.rare_word[2], meeting.rare[2]]) >> 1, np.concatenate([far, np.zeros(len(p) - len(far))]), base, n > 0)

    return run


def _onward(shares: Broadcast, parts: int):
    """Packs of the tokens whose contexts are rare, with their words' probabilities, by the part in which a context's tokens meet."""

    def run(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        x, meeting = shares.value, Meeting((key, value) for key, value in packs if value[0] in (RARE_WORD, RARE_CONTEXT, RARE))
        p, _, _ = _rare_words(meeting, x.total)
        for (c, w, row), given in ((meeting.rare_context, x.p[meeting.rare_context[1]]), (meeting.rare, p[len(meeting.rare_word[0]):])):
            with np.errstate(over="ignore"):
                part = lm._within(lm._mix(c * _ODD), parts)
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(c) else []:
                yield int(part[own[0]]), pack(c[own], w[own].astype(np.uint64), row[own], given[own])

    return run


def _scored_rare(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
    """Sums of the tokens whose contexts are rare: all of such a context's tokens meet."""
    c, w, row, p = _joined([x for _, x in packs], "u8 u8 i8 f8")
    learnt = row & 1 == 0
    _, n, context = _grouped(c, learnt)
    with np.errstate(over="ignore"):
        first, count, bigram = _grouped(lm._mix(c * _ODD + w), learnt)
    shown = lm.count_of(_levels(count), 1.0)
    taken = np.bincount(context[first], weights=_over(shown), minlength=len(n))
    give, part = 1.0 - np.minimum(0.98, taken / np.maximum(n, 1)), np.where(n > 0, 1.0 / np.maximum(n, 1), 0.0)
    zero = np.zeros(len(c))
    yield from _sums(row >> 1, _log(p, give[context], part[context], shown[bigram]), zero, zero)


def _by_row(packs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[bytes]]:
    """Sums of the rows of some blocks, as Arrow data."""
    blocks: dict[int, np.ndarray] = {}
    for block, columns in packs:
        at, *sums = unpack(columns)
        held = blocks.setdefault(block, np.zeros((4, 1 << BLOCK_BITS)))
        held[3, at] = 1
        for k, values in enumerate(sums):
            held[k, at] += values
    for block, (far, base, known, some) in blocks.items():
        at = np.flatnonzero(some)
        yield (b"".join([((block << BLOCK_BITS) + at).astype(np.int64).tobytes(), far[at].tobytes(), base[at].tobytes(), known[at].tobytes()]),)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            row, far, base, known = np.frombuffer(data, np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(far.view(np.float64)), pa.array(base.view(np.float64)), pa.array(known.view(np.float64).astype(np.int64))], ["row", "far", "rare", "n_rare"])


def _near_scores(near: Broadcast, shares: Broadcast):
    """Each row's tokens, and the sums of those whose words and bigrams are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, x, tokens_of = near.value.tables(), shares.value, lm.Tokens()
        for batch in batches:
            for at, texts in portions(batch, most=lm.TOGETHER):
                tokens, sizes = tokens_of(texts)
                owner = np.repeat(np.arange(len(texts)), sizes)
                _, place, before, at_, pair = table(tokens, sizes)
                known = place >= 0
                add = lambda who, what: np.bincount(who, weights=what, minlength=len(texts)).astype(np.float64)  # noqa: E731  # whole numbers where there is nothing
                score = add(owner[at_], _log(x.p[place[at_]], x.give[before[at_]], x.part[before[at_]], x.shown[pair]))
                base = add(owner[known], x.base[place[known]])
                columns = [pa.array(sizes.astype(np.int64)), pa.array(np.bincount(owner[known], minlength=len(texts)).astype(np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, len(texts)) for c in ("row", "doc_id", "held_out")), *columns], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def _spread(key: int) -> int:
    """Deals blocks of rows evenly, whose numbers have gaps."""
    return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33


def score(rows: DataFrame) -> DataFrame:
    """``bloom_lm.score`` of (doc_id, text) rows, with every bigram of the training texts.

    Words and candidates for the near bigrams are counted first. Tokens whose bigrams are not near
    are dealt once to parts, by bigram or rare word, where their bigrams' training counts are plain
    to see; one job over the dealt tokens sums what bigrams take of their contexts, the next one
    scores them and sends sums back by row. Tokens after a rare word go on to where that word's
    followers meet. The rows must come in the same order when they are read again.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", (id_remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    counted = stored(rows.where(~F.col("held_out")).select("text").mapInArrow(_first, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    counts, candidates = (counted.where(F.col("kind") == kind).select("key", "n") for kind in (WORD, CANDIDATE))
    tokens, types, flushes, starts = counted.agg(
        *(F.coalesce(F.sum(F.when(c, n)), F.lit(0)) for c, n in ((F.col("kind") == WORD, F.col("n")), (F.col("kind") == WORD, F.lit(1)), (F.col("kind") == FLUSHED, F.col("n")))),
        F.coalesce(F.sum(F.when((F.col("kind") == WORD) & (F.col("key") == int(np.uint64(lm.END).view(np.int64))), F.col("n"))), F.lit(0))).first()
    total, parts = tokens + 0.5 * (types + 1), max(12, -(-tokens // PART))

    def ordered(df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        least = lm._least_count(df, most)
        found = df.where(F.col("n") >= least).toArrow()
        keys = found.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return keys[order], found.column("n").to_numpy()[order].astype(np.float64), least

    words, exact, least = ordered(counts, min(lm.KNOWN_WORDS, (1 << PLACE_BITS) - 1))
    pairs, n, _ = ordered(candidates, NEAR_PAIRS)
    word_levels = _levels(exact, least)
    # the filter is bounded: of a candidate's count at most OFTEN - 1 are missing from each counting
    often = np.argsort(-n, kind="stable")
    room = lm.FILTER_BITS // lm.BITS - int(word_levels.sum())
    near = context.broadcast(Near(words, np.sort(pairs[often[np.cumsum(_levels(n[often] + (OFTEN - 1) * flushes)) <= room]])))
    pairs = near.value.pairs

    dealt: RDD = rows.select("row", "held_out", "text").mapInArrow(_binary(_deal(near, parts)), "part int, pack binary").rdd.mapPartitions(_loaded).partitionBy(parts, int)
    taken, n_near, of_near = np.zeros(len(words) + 1), np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    for kind, columns in dealt.mapPartitions(_masses).partitionBy(1 + (len(words) >> SLICE_BITS), int).mapPartitions(_added).collect():
        first, *more = unpack(columns)
        if kind == MASS:
            taken[first] += more[0]
        else:
            of_near[first], n_near[first] = more
    levels = _levels(n_near)
    filled = levels > 0
    kept = spark.createDataFrame(pa.table({"key": pa.array(pairs[filled].view(np.int64)), "level": pa.array(levels[filled])}))
    made = lm.build_filter(counts.where(F.col("n") >= least).select(F.lit(lm.UNIGRAM).alias("order"), "key", lm._level(F.col("n"), least).alias("level")).unionByName(
        kept.select(F.lit(lm.BIGRAM).alias("order"), "key", "level")))
    probed = lambda order, keys: np.concatenate([np.zeros(0, np.int64), *(made.levels(order, keys[at:at + 50_000]) for at in range(0, len(keys), 50_000))])
    shown = lm.count_of(probed(lm.BIGRAM, pairs), 1.0)
    taken += np.bincount(of_near[filled], weights=_over(lm.count_of(levels[filled], 1.0)), minlength=len(taken))
    n = np.append(exact, max(1.0, starts))
    shares = context.broadcast(Shares(
        (lm.count_of(probed(lm.UNIGRAM, words), float(least)) + 0.5) / total, np.log10((exact + 0.5) / total), 1.0 - np.minimum(0.98, taken / n), 1.0 / n, shown, total))

    after_rare = dealt.mapPartitions(_onward(shares, parts)).partitionBy(parts, int).mapPartitions(_scored_rare)
    sums = dealt.mapPartitions(_scored(shares)).union(after_rare).partitionBy(parts, _spread).mapPartitions(_by_row)
    far = spark.createDataFrame(sums, "data binary", verifySchema=False).mapInArrow(_rows, "row long, far double, rare double, n_rare long")
    own = rows.mapInArrow(_near_scores(near, shares), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    each = own.unionByName(far, allowMissingColumns=True).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n_known", "n_rare", "base", "rare", "score", "far")))
    return each.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("n_rare")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare")).alias("base_score"), (F.col("score") + F.col("far")).alias("score"))
