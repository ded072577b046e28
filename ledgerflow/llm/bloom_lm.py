"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import portions
from .common import id_remainder, stored

#: Most frequent words that are broadcast with their counts (32 bytes each), words whose bigrams are counted and
#: their least count unless all bigrams are, and bits of the filter at most (16 MB).
KNOWN_WORDS, CONTEXT_WORDS, LEAST_PAIR, FILTER_BITS = 1_000_000, 1 << 16, 2, 1 << 27
#: Growth of the count from one level to the next, bits for each level that is set, hash functions.
LEVEL, BITS, HASHES = 1.3, 10, 6
#: Parts of the filter, each built by one task.
SEGMENTS = 64
DISCOUNT = 0.75
#: Tokens counted at once in a task.
FLUSH = 1_000_000
END, START = 0x1D3A5F7C9B2E4680, 0x6C8E944D1F27A5B3
_ODD = np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, BIGRAM = 1, 2
#: Characters that are worked on together, bytes that are hashed together, bytes of a word that is hashed with others.
TOGETHER, BLOCK, LONGEST = 300_000, 1 << 18, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """Keys of the words of many texts at once; knows ASCII letters and white space only."""

    def __init__(self) -> None:
        codes = np.arange(256, dtype=np.uint8)
        self.white = np.isin(codes, [9, 10, 11, 12, 13, 32])
        self.lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint8)
        self.random = np.random.default_rng(0x5EED).integers(0, 1 << 64, 256, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(BLOCK + LONGEST, _ODD))
            self.back = np.cumprod(np.full(BLOCK + LONGEST, pow(int(_ODD), -1, 1 << 64), np.uint64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the texts' words, an end after each text, and the number of each text's tokens.

        A word's key is a sum of random numbers times powers by place, mixed, for all words of a
        block at once; a long word has a library's hash.
        """
        encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
        data = self.lower[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        inside = np.concatenate([[False], ~self.white[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        keys = np.empty(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for base in range(0, len(data), BLOCK):
                one, last = np.searchsorted(starts, (base, base + BLOCK))
                part = self.random[data[base:base + BLOCK + LONGEST]]
                part *= self.power[:len(part)]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
                first = starts[one:last] - base
                keys[one:last] = _mix((sums[np.minimum(ends[one:last] - base, len(part))] - sums[first]) * self.back[first])
        for i in np.flatnonzero(ends - starts > LONGEST).tolist():
            keys[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
        places = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in encoded)]))
        words = np.diff(places)
        out = np.full(len(keys) + len(texts), END, np.uint64)
        out[np.arange(len(keys)) + np.repeat(np.arange(len(texts)), words)] = keys
        return out, words + 1


def _counts(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    keys, *more = map(np.concatenate, zip(*parts, strict=True))
    keys, first, n = np.unique(keys, return_index=True, return_counts=True)
    columns = [keys, *(x[first] for x in more)]
    for at in range(0, len(keys), 1 << 16):  # small batches: Spark holds each outside its heap
        own = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[own].view(np.int64)) for x in columns), pa.array(n[own].astype(np.int64))], [*names, "n"])


def _counting(keys_of, names: list[str]):
    """A task that counts the keys that ``keys_of`` makes of tokens and the texts' sizes, ``FLUSH`` at a time; what else it makes is the same for equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(), [], 0
        for batch in batches:
            for _, texts in portions(batch, most=TOGETHER):
                held.append(keys_of(*tokens(texts)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from _counts(held, names)
                    held, size = [], 0
        if size:
            yield from _counts(held, names)

    return run


def _places(words: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each word in an ordered array; -1 where it isn't in it."""
    if not len(ordered):
        return np.full(len(words), -1)
    place = np.minimum(np.searchsorted(ordered, words), len(ordered) - 1)
    return np.where(ordered[place] == words, place, -1)


def _after_each(values: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The value before each of texts laid end to end, ``start`` before each text's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(sizes) - sizes] = start
    return out


def pairs_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, key of the bigram) of each token of texts laid end to end."""
    before = _after_each(tokens, sizes, np.uint64(START))
    with np.errstate(over="ignore"):
        return before, _mix(before * _ODD + tokens)


def _pair_keys(shared):
    """Keys and contexts of all bigrams, or of those between the broadcast words."""

    def keys_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, keys = pairs_of(tokens, sizes)
        if shared is None:
            return keys, before
        words, at = np.unique(tokens, return_inverse=True)
        inside = (_places(words, shared.value) >= 0)[at]
        inside &= _after_each(inside, sizes, True)
        return keys[inside], before[inside]

    return keys_of


def count_of(level: np.ndarray, least: float) -> np.ndarray:
    """The count that stands for a level, each ``LEVEL`` times the one before from ``least`` on: the middle of its range; 0 for level 0."""
    return np.where(level > 0, least * LEVEL ** (level - 0.5), 0.0)


def _within(h: np.ndarray, size: int) -> np.ndarray:
    """Places below ``size`` by the upper half of hashes: a product is much faster than a remainder."""
    return (h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)


class Filter:
    """Bloom filter of (n-gram, level) for every level up to the n-gram's own; bits lie in segments by key."""

    def __init__(self, bits: np.ndarray, segment_bits: int) -> None:
        self.bits, self.segment_bits = bits, segment_bits

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int, segment_bits: int) -> Iterator[np.ndarray]:
        """Bits within the key's segment, one for each hash function."""
        with np.errstate(over="ignore"):
            h = _mix(keys + np.asarray(level).astype(np.uint64) * _ODD)
            step = _mix(h) | np.uint64(1)
            for _ in range(HASHES):
                yield _within(h, segment_bits)
                h = h + step

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram: membership is probed for one level after the other until it fails."""
        with np.errstate(over="ignore"):
            keys = keys * np.uint64(2 * order + 1)
        out = np.zeros(len(keys), np.int64)
        base = (keys % np.uint64(SEGMENTS)) * np.uint64(self.segment_bits)
        open_, level = np.arange(len(keys)), 1
        with np.errstate(over="ignore"):
            while len(open_):
                h = _mix(keys[open_] + np.uint64(level) * _ODD)
                step = _mix(h) | np.uint64(1)
                for _ in range(HASHES):  # those that miss a bit drop out at once
                    bit = base[open_] + _within(h, self.segment_bits)
                    hit = ((self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    open_, h, step = open_[hit], h[hit], step[hit]
                    h = h + step
                out[open_] = level
                level += 1
        return out


def _fill(segment_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            levels = batch.column("level").to_numpy(zero_copy_only=False)
            owner = batch.column("segment").to_numpy(zero_copy_only=False)
            for segment in np.unique(owner):
                own, top = keys[owner == segment], levels[owner == segment]
                bits = segments.setdefault(int(segment), np.zeros(segment_bits // 8, np.uint8))
                for level in range(1, int(top.max()) + 1):
                    for place in Filter.places(own[top >= level], level, segment_bits):
                        np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        for segment, bits in segments.items():
            yield pa.RecordBatch.from_pydict({"segment": [segment], "bits": [bits.tobytes()]})

    return run


def build_filter(entries: DataFrame) -> Filter:
    """The filter of ``entries`` (order, key, level), built by segments in tasks; the caller bounds the sum of levels."""
    total = entries.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
    segment_bits = max(64, -(-total * BITS // SEGMENTS // 64) * 64)
    bits = np.zeros(SEGMENTS * segment_bits // 8, np.uint8)
    keyed = entries.mapInArrow(_keyed, "key long, level long, segment int").repartition(SEGMENTS, "segment")
    for row in keyed.mapInArrow(_fill(segment_bits), "segment long, bits binary").collect():
        at = row.segment * segment_bits // 8
        bits[at:at + segment_bits // 8] |= np.frombuffer(row.bits, np.uint8)
    return Filter(bits, segment_bits)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        order = batch.column("order").to_numpy(zero_copy_only=False).astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64) * (2 * order + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("level"), pa.array((keys % np.uint64(SEGMENTS)).astype(np.int32))], ["key", "level", "segment"])


class Model:
    """What the workers get: the filter, exact counts of the most frequent words, and what they leave and give as contexts."""

    def __init__(self, filter_: Filter, known: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], tokens: int, types: int, least: dict[int, float], all_pairs: bool, rest: bool) -> None:
        self.filter, self.least, self.total = filter_, least, tokens + 0.5 * (types + 1)
        self.known_keys, self.known_counts = known
        #: share that the unigram gets and inverse count of each known word, of the start, and of what is no context
        self.give, self.part = contexts
        #: whether all bigrams are counted, and whether some are not in the filter
        self.all_pairs, self.rest = all_pairs, rest

    def count(self, order: int, keys: np.ndarray) -> np.ndarray:
        return count_of(self.filter.levels(order, keys), self.least[order])

    @cached_property
    def word_counts(self) -> np.ndarray:
        """The filter's counts of the broadcast words, probed once a worker."""
        return np.concatenate([np.zeros(0), *(self.count(UNIGRAM, self.known_keys[at:at + 50_000]) for at in range(0, len(self.known_keys), 50_000))])

    def parts(self, tokens: np.ndarray, sizes: np.ndarray, at: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
        """What the probabilities of tokens of texts laid end to end are made of: p * give + part * max(0, shown - DISCOUNT).

        Half a count is added to every word and to one unseen word (p). Bigrams are discounted and
        interpolated with the unigram: what a context's bigrams leave goes to the unigram (give).
        ``place`` is that of the different words among the broadcast ones, ``at`` each token's word.
        """
        each = np.zeros(len(place))
        each[place >= 0] = (self.word_counts[place[place >= 0]] + 0.5) / self.total
        rare = (place < 0)[at]
        before = _after_each(place[at], sizes, len(self.known_keys))  # -1, the last, is no context
        context, keys = pairs_of(tokens, sizes)
        part = self.part[before]
        # of a limited vocabulary only bigrams between its words are looked up
        asked = np.flatnonzero(np.ones(len(tokens), bool) if self.all_pairs else (part > 0) & ((place >= 0) & (self.part[place] > 0))[at])
        distinct, which = np.unique(keys[asked], return_inverse=True)
        shown = np.zeros(len(tokens))
        shown[asked] = self.count(BIGRAM, distinct)[which]
        lost = np.zeros(len(tokens), bool)
        lost[asked] = self.rest
        return {"p": each[at], "give": self.give[before], "part": part, "shown": shown, "key": keys, "context": context, "rare": rare,
                "rare_context": (before < 0) & self.all_pairs, "lost": lost & (shown == 0)}


def _score(shared):
    """Rows of two kinds: a document's own (doc is set), and one for each token that needs counts which are not broadcast (key is set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens_of = shared.value, Tokens()
        for batch in batches:
            for at, texts in portions(batch, most=TOGETHER):
                ids, rows = batch.column("doc_id").slice(at, len(texts)), batch.column("row").slice(at, len(texts)).to_numpy(zero_copy_only=False)
                tokens, sizes = tokens_of(texts)
                owner = np.repeat(np.arange(len(texts)), sizes)
                words, which = np.unique(tokens, return_inverse=True)
                place = _places(words, model.known_keys)
                base = np.zeros(len(words))
                base[place >= 0] = np.log10((model.known_counts[place[place >= 0]] + 0.5) / model.total)
                x = model.parts(tokens, sizes, which, place)
                far = x["rare"] | x["rare_context"] | x["lost"]
                near = np.where(far, 1.0, x["p"] * x["give"] + x["part"] * np.maximum(0.0, x["shown"] - DISCOUNT))
                sums = [np.bincount(owner, weights=w, minlength=len(texts)) for w in (np.log10(np.minimum(1.0, near)), base[which], ~x["rare"])]
                doc = pa.StructArray.from_arrays(
                    [ids, pa.array(sizes), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "n_tokens", "n_known", "base", "score"])
                columns = {"row": pa.array(rows), "doc": doc}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(rows), f.type)) for f in SPREAD], schema=SPREAD)
                far = np.flatnonzero(far)
                for at_ in range(0, len(far), 1 << 16):
                    own = far[at_:at_ + (1 << 16)]
                    columns = {"row": pa.array(rows[owner[own]]), "key": pa.array(x["key"][own].view(np.int64)), "doc": pa.nulls(len(own), doc.type)}
                    columns |= {name: pa.array(x[name][own]) for name in ("p", "give", "part", "shown")}
                    columns |= {name: pa.array(values[own].view(np.int64), mask=~mask[own]) for name, values, mask in (("context", x["context"], x["rare_context"]), ("word", tokens, x["rare"]))}
                    yield pa.RecordBatch.from_arrays([columns[f.name] for f in SPREAD], schema=SPREAD)

    return run


#: Columns of ``_score``.
SPREAD = pa.schema({
    "row": pa.int64(), "key": pa.int64(), "p": pa.float64(), "give": pa.float64(), "part": pa.float64(), "shown": pa.float64(), "context": pa.int64(), "word": pa.int64(),
    "doc": pa.struct({"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()})})


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` keys reach; one row for each different count reaches the driver, the square root of twice their sum at most."""
    held, least = 0, None
    for row in counts.groupBy("n").agg(F.count("*").alias("keys")).orderBy(F.desc("n")).toLocalIterator():
        if (held := held + row["keys"]) > most:
            return least or row.n + 1
        least = row.n
    return least or 1


def _level(n: Column, least: float) -> Column:
    return (F.floor(F.log(n / F.lit(float(least))) / float(np.log(LEVEL)) + 1e-9) + 1).cast("long")


def _shown(level: Column, least: float) -> Column:
    """The count that stands for a level."""
    return float(least) * F.pow(F.lit(LEVEL), level - 0.5)


def fit(training: DataFrame, counts: DataFrame, tokens: int, types: int, all_pairs: bool = False) -> tuple[Model, int, DataFrame, DataFrame]:
    """The model of ``training`` texts, whose word counts are ``counts`` (key, n), and what is not broadcast.

    That is the least count of a broadcast word, the bigrams that the filter has no room for (key,
    count) and the contexts that are not broadcast (context, n, mass).
    """
    spark = training.sparkSession
    least = _least_count(counts, KNOWN_WORDS)
    known = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(keys := known.column("key").to_numpy().view(np.uint64))
    keys, exact = keys[order], known.column("n").to_numpy()[order].astype(np.float64)
    limit = np.sort(exact)[-CONTEXT_WORDS - 1] + 1 if len(exact) > CONTEXT_WORDS and not all_pairs else least
    starts = exact[keys == np.uint64(END)]  # every text has one end

    counted = training.mapInArrow(_counting(_pair_keys(None if all_pairs else spark.sparkContext.broadcast(keys[exact >= limit])), ["key", "context"]), "key long, context long, n long")
    least_pair = 1 if all_pairs else LEAST_PAIR
    pairs = stored(counted.groupBy("key").agg(F.max("context").alias("context"), F.sum("n").alias("n")).where(F.col("n") >= least_pair).select(
        "key", "context", _level(F.col("n"), least_pair).cast("int").alias("level")), "bigrams")
    words = counts.where(F.col("n") >= least).select(F.lit(UNIGRAM).alias("order"), "key", _level(F.col("n"), least).alias("level"))
    # the filter's size is bounded: where all bigrams are too many, those of the lowest levels stay out of it and are joined
    room = FILTER_BITS // BITS - words.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
    held = {r.level: r["count"] for r in pairs.groupBy("level").count().collect()}  # a few dozen levels
    raised = 0
    while sum(n * max(0, level - raised) for level, n in held.items()) > room and raised < max(held, default=0):
        raised += 1
    kept = pairs.where(F.col("level") > raised).select(F.lit(BIGRAM).alias("order"), "key", (F.col("level") - raised).cast("long").alias("level"))
    rest = pairs.where(F.col("level") <= raised).select("key", _shown(F.col("level"), least_pair).alias("count"))
    masses = pairs.groupBy("context").agg(F.sum(_shown(F.col("level"), least_pair) - DISCOUNT).alias("mass"))
    contexts = stored(masses.join(counts.withColumnRenamed("key", "context"), "context", "left"), "contexts")
    near = contexts.where(F.col("n").isNull() | (F.col("n") >= least)).select("context", "mass").toArrow()  # the start and broadcast words
    taken, total = np.zeros(len(keys) + 2), np.concatenate([exact, starts if len(starts) else [0.0], [0.0]])
    at = _places(own := near.column("context").to_numpy().view(np.uint64), keys)
    taken[np.where(own == np.uint64(START), len(keys), at)] = near.column("mass").to_numpy()
    total = np.maximum(total, 1.0)
    part = np.where(np.append(exact >= limit, [True, False]), 1.0 / total, 0.0)
    give = 1.0 - np.minimum(0.98, taken / total)
    model = Model(build_filter(stored(words.unionByName(kept), "filter_entries")), (keys, exact), (give, part), tokens, types,
                  {UNIGRAM: float(least), BIGRAM: least_pair * LEVEL ** raised}, all_pairs, raised > 0)
    return model, least, rest, contexts.where(F.col("n") < least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_pairs: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    The model learns from all documents that are not held out. Word counts are exact, by 64-bit
    hashes of the words (two of 10^8 words meet with probability 0.0003), and grow with the input.
    The ``KNOWN_WORDS`` most frequent words are broadcast; the other words of a document are joined
    with their counts by shuffle, for the base score and for the unigram probability, so no word is
    left out at any size. Quantised counts of the broadcast words and of bigrams fill a
    log-frequency Bloom filter (Talbot and Osborne, 2007): an n-gram of level q is a member with each
    of 1..q, so its quantised count is read by probing until a probe fails, and an error can only
    raise it. The filter has ``FILTER_BITS`` bits at most; bigrams of the lowest levels that it has no
    room for are joined by shuffle, with the same quantised counts.

    The bigrams are those between the ``CONTEXT_WORDS`` most frequent words that occur
    ``LEAST_PAIR`` times, or with ``all_pairs`` every bigram of the training texts (``all_pairs.score``).

    A null or empty text is one end token. A null id counts as the empty text in the fold's hash.
    Repeated rows are each returned; no training document leaves an empty model, under which
    every token is unseen. Other columns are not used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if all_pairs:
        from . import all_pairs as every

        return every.score(rows)
    training = rows.where(id_remainder(F.col("doc_id"), 5) != 1).select("text")
    counts = stored(training.mapInArrow(_counting(lambda tokens, sizes: (tokens,), ["key"]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "word_counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, least, rest, contexts = fit(training, counts, tokens, types, all_pairs)

    spread = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _score(spark.sparkContext.broadcast(model)),
        "row long, key long, p double, give double, part double, shown double, context long, word long, doc struct<doc_id:bigint,n_tokens:bigint,n_known:bigint,base:double,score:double>"), "scores")
    share = lambda n: (n + 0.5) / F.lit(float(model.total))
    no_key = F.xxhash64("row", "key")  # rows without a word or context to look up are dealt evenly and find nothing
    rare = counts.where(F.col("n") < least).select(F.col("key").alias("own_word"), F.col("n").alias("word_n"))
    far = contexts.select(F.col("context").alias("own_context"), F.col("n").alias("context_n"), "mass")
    odd = spread.where(F.col("word").isNotNull() | F.col("context").isNotNull()).join(rare, F.coalesce("word", no_key) == F.col("own_word"), "left")
    if all_pairs:
        odd = odd.join(far, F.coalesce("context", no_key) == F.col("own_context"), "left")
    else:
        odd = odd.select("*", F.lit(None).cast("long").alias("context_n"), F.lit(None).cast("double").alias("mass"))
    n = F.coalesce("word_n", F.lit(0))
    p = F.when(F.col("word").isNotNull(), share(F.coalesce(_shown(_level(F.col("word_n"), 1), 1), F.lit(0.0)))).otherwise(F.col("p"))
    give = F.when(F.col("context_n").isNotNull(), 1 - F.least(F.lit(0.98), F.col("mass") / F.col("context_n"))).otherwise(F.col("give"))
    odd = odd.select(
        "row", "key", (p * give).alias("x"), F.coalesce(1 / F.col("context_n"), F.col("part")).alias("part"), "shown",
        F.col("word_n").isNotNull().cast("long").alias("n_rare"), F.when(F.col("word").isNotNull(), F.log10(share(n))).otherwise(0.0).alias("rare"))
    lost = spread.where(F.col("key").isNotNull() & F.col("word").isNull() & F.col("context").isNull()).select(
        "row", "key", (F.col("p") * F.col("give")).alias("x"), "part", "shown", F.lit(0).cast("long").alias("n_rare"), F.lit(0.0).alias("rare"))
    follow = F.greatest(F.lit(0.0), F.coalesce("count", "shown") - DISCOUNT)
    own = spread.where(F.col("doc").isNotNull()).select("row", "doc", F.lit(0).cast("long").alias("n_rare"), F.lit(0.0).alias("rare"), F.lit(0.0).alias("far"))
    each = odd.unionByName(lost).join(rest, "key", "left").select(
        "row", F.lit(None).cast(own.schema["doc"].dataType).alias("doc"), "n_rare", "rare", F.log10(F.least(F.lit(1.0), F.col("x") + F.col("part") * follow)).alias("far"))
    each = own.unionByName(each).groupBy("row").agg(F.max("doc").alias("doc"), *(F.sum(c).alias(c) for c in ("n_rare", "rare", "far")))
    return each.select(
        "doc.doc_id", (id_remainder(F.col("doc.doc_id"), 5) == 1).alias("held_out"), "doc.n_tokens", (F.col("doc.n_known") + F.col("n_rare")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("doc.base") + F.col("rare")).alias("base_score"), (F.col("doc.score") + F.col("far")).alias("score"))
