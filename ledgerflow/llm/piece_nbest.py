"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A* search over the piece lattice."""

from __future__ import annotations

import array
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .bpe import LONGEST, PieceTable, portions
from .common import documents

SPACE = "▁"
NBEST = 4
#: Characters of the texts that a task works on together, and segments whose n best a worker keeps.
TOGETHER, SEARCHED = 300_000, 10_000
#: Arrow types of the columns of a result; a text without pieces has sums that are whole numbers to Python.
TYPES = {
    "n_pieces": pa.int64(), "score": pa.float64(), "nbest_scores": pa.list_(pa.float64()), "nbest_sizes": pa.list_(pa.int64()), "ids_sha256": pa.string(), "round_trip": pa.bool_(),
    "decoded": pa.string(), "nbest_sha256": pa.list_(pa.string()), "ids": pa.list_(pa.list_(pa.int32()))}
#: Bits of the hashes of pieces' beginnings.
BEGIN_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces and scores of a SentencePiece model, with its byte pieces for characters that no piece covers."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        text = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = (model.get_score(i), i)
                text[i] = piece.encode()
        assert not any(SPACE in p.lstrip(SPACE) for p in self.score), "a piece spans a space"
        self.longest = max(map(len, self.score))
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_size = np.fromiter(map(len, text), np.int64, len(text))
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.unknown = min(s for s, _ in self.score.values() if s > -1e8) - 10.0
        self._table()

    def _table(self) -> None:
        """Pieces by a 64-bit hash of their characters, in a table with a few probes."""
        names = list(self.score)
        with np.errstate(over="ignore"):
            hashes = np.array([self._hash(p) for p in names], np.uint64)
        assert len(set(hashes.tolist())) == len(names), "two pieces share a hash"
        self.slot_bits, self.probes = 20, 1
        self.slots = np.zeros(1 << self.slot_bits, np.int32)  # 0: free, else 1 + the piece's row
        for row, h in enumerate(hashes.tolist()):
            at = h >> (64 - self.slot_bits)
            probe = 1
            while self.slots[at]:
                at, probe = (at + 1) % len(self.slots), probe + 1
            self.slots[at], self.probes = row + 1, max(self.probes, probe)
        self.row_hash = np.concatenate([[np.uint64(0)], hashes])
        self.row_score = np.array([-np.inf, *(self.score[p][0] for p in names)])
        self.row_id = np.array([-1, *(self.score[p][1] for p in names)], np.int32)
        self.begins = np.zeros(1 << BEGIN_BITS, bool)  # whether some piece goes on after characters with such a hash
        with np.errstate(over="ignore"):
            for begin in {p[:n] for p in names for n in range(1, len(p))}:
                self.begins[self._hash(begin) >> np.uint64(64 - BEGIN_BITS)] = True

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = (h + np.uint64(ord(c))) * _ODD
        return h

    def _rows(self, h: np.ndarray) -> np.ndarray:
        """Row of the piece with each hash; 0 where there is none."""
        at = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        found = self.slots[at]
        found = np.where(self.row_hash[found] == h, found, 0)
        for step in range(1, self.probes):
            more = self.slots[(at + step) & (len(self.slots) - 1)]
            found = np.where((found == 0) & (self.row_hash[more] == h), more, found)
        return found

    def forward_many(self, words: list[str]) -> Iterator[tuple[str, tuple[float, tuple[int, ...], float]]]:
        """(segment, (score, best ids, loss)) of many segments: the forward pass for all at once, longest first."""
        words = sorted(words, key=len, reverse=True)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 400_000)))
            yield from zip(words[at:end], self._forward(words[at:end]), strict=True)
            at = end

    def _lattice(self, codes: np.ndarray, first: np.ndarray, many: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the last character, characters, row) of each piece in the segments, by its end and then the longest first."""
        last, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for size in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h = (h + codes[last]) * _ODD
            rows = self._rows(h)
            hit = np.flatnonzero(rows) if size > 1 else last
            found.append((last[hit].astype(np.int32), np.full(len(hit), size, np.int8), rows[hit]))
            # on to the next character, where there is one and some piece begins like this
            on = np.flatnonzero(self.begins[(h >> np.uint64(64 - BEGIN_BITS)).astype(np.int64)])
            after = np.minimum(place[last[on]] + 1, len(many) - 1)
            inside = (word[last[on]] < many[after]) & (place[last[on]] + 1 < len(many))
            on, after = on[inside], after[inside]
            last, h = first[after] + word[last[on]], h[on]
            if not len(last):
                break
        last, size, row = map(np.concatenate, zip(*reversed(found), strict=True))
        order = np.argsort(last, kind="stable")
        return last[order], size[order], row[order]

    def _forward(self, words: list[str]) -> Iterator[tuple[float, tuple[int, ...], float]]:
        """Characters lie by place, of each place by segment: the segments, longest first, that reach a place are the first ones.

        Node ``i`` is the start of segment i, node ``m + c`` the end of the character c.
        """
        m, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        many = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # segments with a character at each place
        first = np.cumsum(many) - many
        place = np.repeat(np.arange(len(many)), many)
        word = np.arange(len(place)) - first[place]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)[(np.cumsum(lengths) - lengths)[word] + place].astype(np.uint64)
        last, size, row = self._lattice(codes, first, many, place, word)
        score, piece = self.row_score[row], self.row_id[row]
        free = row == 0
        score[free], piece[free] = self.unknown, -1 - codes[last[free]].astype(np.int32)  # a negative id: the bytes of this character
        before = place[last] - size  # place of the character before the piece
        start = np.where(before < 0, word[last], m + first[before] + word[last])
        group = np.searchsorted(last, np.arange(len(codes) + 1))  # every character ends a piece of its own at least
        best, sums = np.zeros(m + len(codes)), np.empty(len(last))
        for lo, hi in zip(first.tolist(), (first + many).tolist(), strict=True):
            one, end = group[lo], group[hi]
            sums[one:end] = best[start[one:end]] + score[one:end]
            best[m + lo:m + hi] = np.maximum.reduceat(sums[one:end], group[lo:hi] - one)
        high = np.flatnonzero(sums == best[m + last])
        via = high[np.flatnonzero(np.diff(last[high], prepend=-1))]  # the longest of equal ones
        score_of = best[m + first[lengths - 1] + np.arange(m)]
        sums[via] = -np.inf
        gap = best[m:] - np.maximum.reduceat(sums, group[:-1])
        at, open_, loss, steps = first[lengths - 1] + np.arange(m), np.arange(m), np.full(m, np.inf), []
        while len(open_):  # best paths from the end
            loss[open_] = np.minimum(loss[open_], gap[at])
            edge = via[at]
            steps.append((open_, piece[edge]))
            on = start[edge] >= m
            at, open_ = start[edge][on] - m, open_[on]
        owner, ids = map(np.concatenate, zip(*reversed(steps), strict=True))
        ids = ids[np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=m))
        odd = np.zeros(m, bool)
        odd[owner[np.concatenate([x for _, x in reversed(steps)]) < 0]] = True
        flat, done = ids.tolist(), 0
        for value, end, bytes_, lost in zip(score_of.tolist(), ends.tolist(), odd.tolist(), loss.tolist(), strict=True):
            own = flat[done:end]
            if bytes_:
                own = chain.from_iterable([x] if x >= 0 else [self.byte[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")] for x in own)
            yield value, tuple(own), lost
            done = end

    def edges(self, segment: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the lattice's edges that end at ``end``; a character without a piece is its bytes."""
        for start in range(max(0, end - self.longest), end):
            if hit := self.score.get(segment[start:end]):
                yield start, hit[0], (hit[1],)
        if segment[end - 1] not in self.score:
            yield end - 1, self.unknown, tuple(self.byte[x] for x in segment[end - 1].encode("utf-8", "surrogatepass"))

    def forward(self, segment: str) -> tuple[list[float], tuple[int, ...], float]:
        """Best score to each position, the ids of the best path, and how much the second-best path loses at least.

        The loss is the least difference between the two best edges into a node of the best path:
        these are the first alternatives that the backward search puts on its heap.
        """
        get, longest, n = self.score.get, self.longest, len(segment)
        best, back, gap = [0.0] * (n + 1), [None] * (n + 1), [float("inf")] * (n + 1)
        for end in range(1, n + 1):
            high = second = float("-inf")
            via = None
            for start in range(end - longest if end > longest else 0, end):
                hit = get(segment[start:end])
                if hit is not None:
                    s = best[start] + hit[0]
                    if s > high:
                        second, high, via = high, s, (start, hit[1])
                    elif s > second:
                        second = s
            if segment[end - 1] not in self.score:
                s = best[end - 1] + self.unknown
                if s > high:
                    second, high, via = high, s, (end - 1, None)
                elif s > second:
                    second = s
            best[end], back[end], gap[end] = high, via, high - second
        ids, at, loss = [], n, float("inf")
        while at:
            if gap[at] < loss:
                loss = gap[at]
            start, piece = back[at]
            ids += [piece] if piece is not None else [self.byte[x] for x in reversed(segment[at - 1].encode("utf-8", "surrogatepass"))]
            at = start
        return best, tuple(reversed(ids)), loss

    def search(self, segment: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``count`` best paths of a segment, best first.

        A hypothesis is a path from some position to the end; its priority is its own score plus
        the forward score of that position, which is exactly what the best completion adds. So
        hypotheses leave the heap in order, and each one that reaches the start is the next best.
        Hypotheses are links to the one that they extend. Of equal ones the one nearest to the start
        goes first, and a position is left for the start ``count`` times at most, since what comes
        later there can't be among the best: the work is in proportion to the segment.
        """
        best, _, _ = self.forward(segment)
        heap, turn, left = [(-best[-1], len(segment), 0, 0.0, None)], 0, [0] * (len(segment) + 1)
        found = []
        while heap and len(found) < count:
            priority, at, _, own, link = heapq.heappop(heap)
            if at == 0:
                ids = []
                while link:
                    ids += link[0]
                    link = link[1]
                found.append((-priority, tuple(ids)))
                continue
            if left[at] == count:
                continue
            left[at] += 1
            for start, score, piece in self.edges(segment, at):
                turn += 1
                heapq.heappush(heap, (-(own + score + best[start]), start, turn, own + score, (piece, link)))
        return found

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """What pieces say, laid end to end, and the place of each piece's first byte, with the end."""
        sizes = self.text_size[ids]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return self.text[np.repeat(self.text_start[ids] - sums[:-1], sizes) + np.arange(sums[-1])].tobytes(), sums

    def raw(self, ids: tuple[int, ...] | list[int]) -> str:
        """What the pieces say, spaces visible."""
        return self.bytes_of(np.array(ids, np.int64))[0].decode("utf-8", "surrogatepass")

    def decode(self, ids: tuple[int, ...] | list[int]) -> str:
        """The text of a segmentation."""
        return plain(self.raw(ids))


def marked(text: str) -> str:
    """Text as the lattice sees it: a leading space, and spaces visible."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def plain(raw: str) -> str:
    """The text that visible spaces and a leading space stand for."""
    text = raw.replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


class Segments(PieceTable):
    """Best path of each segment, with its score and loss; the n best of those that a text may change."""

    def __init__(self, pieces: Pieces) -> None:
        kind, cut = np.zeros(0x110000, np.uint8), np.zeros((8, 8), bool)
        kind[ord(SPACE)], cut[0, 1] = 1, True  # before a space that follows other text: no piece spans such a place
        super().__init__(kind, cut.ravel(), self._solve, more=2)
        self.of, self.searched = pieces, {}

    def _solve(self, segments: list[str]) -> tuple[list[tuple[int, ...]], list[float], list[float]]:
        known = dict(self.of.forward_many([s for s in segments if len(s) <= LONGEST]))
        for s in segments:
            if s not in known:
                best, ids, loss = self.of.forward(s)
                known[s] = best[-1], ids, loss
        score, ids, loss = zip(*map(known.__getitem__, segments), strict=True)
        return list(ids), list(score), list(loss)

    def choices(self, segment: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """``Pieces.search``, remembered for short segments."""
        if (found := self.searched.get((segment, count))) is None:
            found = self.of.search(segment, count)
            if len(segment) <= LONGEST:
                if len(self.searched) >= SEARCHED:
                    self.searched.clear()
                self.searched[segment, count] = found
        return found

    def choose(self, segment_of, own_of, scores: np.ndarray, losses: np.ndarray, count: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The ``count`` best segmentations of a whole text, best first, as score and the segments that differ from the best.

        Segments are independent, so a text's n-best are its best path with at most ``count`` - 1
        segments changed, and those are among the segments that lose least. They get the full search,
        and a heap puts their choices in order.
        """
        few = min(count - 1, len(losses))
        among = np.flatnonzero(losses <= np.partition(losses, few - 1)[few - 1]) if few else np.zeros(0, np.int64)
        open_ = [i for i in among[np.argsort(losses[among], kind="stable")][:few].tolist() if losses[i] < float("inf")]
        choices = []
        for i in open_:  # of equal sums the forward pass may have picked another path than the search
            own = own_of(i)
            choices.append([(float(scores[i]), own), *[x for x in self.choices(segment_of(i), count) if x[1] != own][:count - 1]])
        start = (0,) * len(open_)
        heap, seen, found = [(-float(scores.sum()), start)], {start}, []
        while heap and len(found) < count:
            loss, chosen = heapq.heappop(heap)
            found.append((-loss, {open_[k]: choices[k][c][1] for k, c in enumerate(chosen) if c}))
            for k, c in enumerate(chosen):
                further = (*chosen[:k], c + 1, *chosen[k + 1:])
                if c + 1 < len(choices[k]) and further not in seen:
                    seen.add(further)
                    heapq.heappush(heap, (loss + choices[k][c][0] - choices[k][c + 1][0], further))
        return found

    def segmented(self, texts: list[str], count: int) -> Iterator[tuple[str, bool, list[tuple[float, int, bytes]]]]:
        """(decoded, round trip, [(score, pieces, 32-bit ids)], best first) of each text."""
        lattices = [marked(t) for t in texts]
        whole = "".join(lattices)
        rows, places, edges = self.pieces(lattices)
        scores, losses = self.numbers[rows, 0], self.numbers[rows, 1]
        ids, sums = self.ids_of(rows)
        packed, (said, ends) = ids.tobytes(), self.of.bytes_of(ids)
        for text, lo, hi in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            segment_of = lambda i, lo=lo: whole[places[lo + i]:places[lo + i + 1]]
            own_of = lambda i, lo=lo: tuple(ids[sums[lo + i]:sums[lo + i + 1]].tolist())
            found = self.choose(segment_of, own_of, scores[lo:hi], losses[lo:hi], count)
            first, last = int(sums[lo]), int(sums[hi])
            decoded = plain(said[ends[first]:ends[last]].decode("utf-8", "surrogatepass"))
            same, every = decoded == text, []
            for score, changed in found:  # another segmentation differs from the best one in the changed segments only
                parts, done = [], first
                for i, other in sorted(changed.items()):
                    parts += [packed[4 * done:4 * int(sums[lo + i])], array.array("i", other).tobytes()]
                    done = int(sums[lo + i + 1])
                    same = same and self.of.raw(other) == segment_of(i)
                one = b"".join([*parts, packed[4 * done:4 * last]])
                every.append((score, len(one) // 4, one))
            yield decoded, same, every


def id_lists(rows: list[list[bytes]]) -> pa.Array:
    """Lists of lists of 32-bit ids, from their bytes."""
    flat = list(chain.from_iterable(rows))
    inner = np.cumsum([0, *(len(x) // 4 for x in flat)])
    outer = np.cumsum([0, *map(len, rows)])
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists)


@cache
def _segments(model: str) -> Segments:
    """The table of a model; a worker that runs several tasks keeps it."""
    return Segments(Pieces(public_tokenizers.path(model)))


def _segmenter(model: str, count: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _segments(model)
        for batch in batches:
            for at, texts in portions(batch, most=TOGETHER):
                columns = {name: [] for name in TYPES}
                for decoded, same, every in segments.segmented(texts, count):
                    scores, sizes, ids = zip(*every, strict=True)
                    hashes = [hashlib.sha256(x).hexdigest() for x in (ids if with_ids else ids[:1])]
                    values = (sizes[0], scores[0], scores, sizes, hashes[0], same, decoded, hashes, ids)
                    for column, value in zip(columns.values(), values, strict=True):
                        column.append(value)
                columns = columns | {"ids": id_lists(columns["ids"])} if with_ids else {c: v for c, v in columns.items() if c not in ("decoded", "nbest_sha256", "ids")}
                schema = pa.schema([("doc_id", pa.int64()), *((c, TYPES[c]) for c in columns)])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(texts))} | columns, schema=schema)

    return run


def segment_nbest(docs: DataFrame, model: str = "piece_bpe_32k.model", count: int = NBEST, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, score, nbest_scores, nbest_sizes, ids_sha256, round_trip) of each row, and on demand
    ``decoded`` (the text that the best one's pieces give), ``nbest_sha256`` and ``ids`` of every segmentation.

    The ``count`` segmentations of the whole text with the highest sums of piece scores, best
    first; n_pieces, score and ids_sha256 (of the ids as 32-bit integers) are the best one's. round_trip says
    that every one decodes to the text. Byte pieces stand in only for characters that no piece
    covers. Equal sums are told apart by the piece ids of the changed segments.

    A null or empty text has one segmentation, of no pieces. Ids may be null or repeat; other
    columns are not used. Documents are independent: no shuffle.
    """
    schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_sizes array<long>, ids_sha256 string, round_trip boolean"
    return documents(docs).mapInArrow(_segmenter(model, count, with_ids), schema + (", decoded string, nbest_sha256 array<string>, ids array<array<int>>" if with_ids else ""))
