"""Byte-pair encoding of many texts at once: each different piece of text is encoded by the library once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: White space of Unicode, as the tokenizers' split pattern has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Longest piece that is kept, different pieces that are kept, characters worked on together.
LONGEST, ROOM, TOGETHER = 64, 500_000, 1 << 18
SLOT_BITS = 20
_ODD = 0x9E3779B97F4A7C15


def _kinds() -> np.ndarray:
    """Kind of each character: 1 letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 beyond ASCII, 6 white space."""
    out = np.full(0x110000, 5, np.uint8)
    out[:128] = 4
    for kind, chars in ((1, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, "'"), (6, WHITE)):
        out[[ord(c) for c in chars]] = kind
    return out


def _cuts() -> np.ndarray:
    """Whether text falls apart between characters of two kinds, by 8 * first + second.

    The pattern's matches are runs of letters, of digits, or of other characters, with a space before
    them, contractions, and runs of white space. None goes on from other text into white space, or
    between a letter, a digit and another ASCII character, except from an apostrophe. Of characters
    beyond ASCII nothing is assumed but whether they are white space.
    """
    out = np.zeros((8, 8), bool)
    out[1:6, 6] = True
    out[1, [2, 3, 4]] = out[2, [1, 3, 4]] = out[4, [1, 2]] = True
    return out.ravel()


class PieceTable:
    """Token ids of the pieces that texts fall into, each different piece worked out once a worker.

    Texts are cut between characters whose kinds say so, all at once. The pieces' ids are kept in a
    table by a 64-bit hash of the characters (random multipliers, so two of half a million pieces meet
    with probability 7e-9); new pieces and those longer than ``LONGEST`` go to ``solve``, which gives
    the ids and further numbers of each. What the table holds is bounded: when full it starts anew with
    the pieces that came in several calls.
    """

    def __init__(self, kind: np.ndarray, cut: np.ndarray, solve: Callable[[list[str]], tuple], more: int = 0) -> None:
        self.kind, self.cut, self.solve, self.more = kind, cut, solve, more
        self.random = np.random.default_rng(0x5EED).integers(0, 1 << 64, 0x110000, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(TOGETHER + LONGEST, _ODD, np.uint64))
            self.back = np.cumprod(np.full(TOGETHER + LONGEST, pow(_ODD, -1, 1 << 64), np.uint64))
        self._clear()

    def _clear(self) -> None:
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)  # 0: free, else the piece's row
        self.key, self.start, self.size = np.zeros(ROOM, np.uint64), np.zeros(ROOM, np.int64), np.zeros(ROOM, np.int32)
        self.numbers, self.again = np.zeros((ROOM, self.more)), np.zeros(ROOM, bool)  # again: looked up since the table started
        self.rows, self.flat, self.used = 1, np.zeros(1 << 19, np.int32), 0
        self.kept = self.rows, self.used

    def _renew(self) -> None:
        """Start anew with the pieces that were looked up again, if these leave half of the room."""
        rows = np.flatnonzero(self.again[:self.rows])
        ids, sums = self.ids_of(rows)
        keys, numbers = self.key[rows], self.numbers[rows]
        self._clear()
        if not 0 < len(rows) < ROOM // 2 or len(ids) > 8 * ROOM:
            return
        self.flat = np.concatenate([ids, np.zeros(1 << 19, np.int32)])
        self.start[1:len(sums)], self.size[1:len(sums)], self.numbers[1:len(sums)] = sums[:-1], np.diff(sums), numbers
        self._insert(keys, np.arange(1, len(sums)))
        self.rows, self.used = len(sums), len(ids)
        self.kept = self.rows, self.used

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Rows of new pieces, whose ids go to the end of the table."""
        found, *numbers = self.solve(pieces)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        rows, total = np.arange(self.rows, self.rows + len(found)), int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
        if rows[-1] >= len(self.start):
            longer = lambda x: np.concatenate([x, np.zeros((max(len(found), len(x)), *x.shape[1:]), x.dtype)])
            self.key, self.start, self.size, self.numbers, self.again = map(longer, (self.key, self.start, self.size, self.numbers, self.again))
        self.flat[self.used:self.used + total] = [x for ids in found for x in ids]
        self.start[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        for k, values in enumerate(numbers):
            self.numbers[rows, k] = values
        self.rows, self.used = self.rows + len(found), self.used + total
        return rows

    def _insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.key[rows] = keys
        at = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(rows):
            free = self.slot[at] == 0
            self.slot[at[free]] = rows[free]
            left = self.slot[at] != rows
            rows, at = rows[left], (at[left] + 1) & (len(self.slot) - 1)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Row of the piece with each key; 0 where there is none."""
        at = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        rows = self.slot[at]
        open_ = np.flatnonzero((rows != 0) & (self.key[rows] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slot) - 1)
            rows[open_] = self.slot[at[open_]]
            open_ = open_[(rows[open_] != 0) & (self.key[rows[open_]] != keys[open_])]
        return rows

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of pieces of at most ``LONGEST`` characters: sums of random numbers times powers by place."""
        out = np.empty(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for base in range(0, len(codes), TOGETHER):
                one, end = np.searchsorted(starts, (base, base + TOGETHER))
                part = self.random[codes[base:base + TOGETHER + LONGEST]]
                part *= self.power[:len(part)]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
                first = starts[one:end] - base
                h = (sums[ends[one:end] - base] - sums[first]) * self.back[first]
                h ^= h >> np.uint64(32)
                out[one:end] = h * np.uint64(0xD6E8FEB86659FD93)
        return out

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end: table rows of the pieces, their places, and the number of each text's first piece, with the end."""
        self.rows, self.used = self.kept  # without the long pieces of the last call
        if self.rows > ROOM or self.used > 16 * ROOM:
            self._renew()
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[codes]
        begin = np.zeros(len(codes) + 1, bool)
        begin[1:-1] = self.cut[kinds[:-1] * np.uint8(8) + kinds[1:]]
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        begin[edges] = True
        places = np.flatnonzero(begin)
        starts, ends = places[:-1], places[1:]
        short = ends - starts <= LONGEST
        rows = np.zeros(len(starts), np.int64)
        keys = self._hashes(codes, starts[short], ends[short])
        rows[short] = found = self._lookup(keys)
        self.again[found] = True
        self.again[0] = False
        if not found.all():
            lost = np.flatnonzero(found == 0)
            fresh, first, which = np.unique(keys[lost], return_index=True, return_inverse=True)
            at = np.flatnonzero(short)[lost]
            added = self._add([whole[s:e] for s, e in zip(starts[at[first]].tolist(), ends[at[first]].tolist(), strict=True)])
            self._insert(fresh, added)
            rows[at] = added[which]
        self.kept = self.rows, self.used
        if not short.all():  # these have a row for this call only: no slot leads to it
            rows[~short] = self._add([whole[s:e] for s, e in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True)])
        return rows, places, np.searchsorted(starts, edges)

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in table rows laid end to end, and the place of each piece's first one, with the end."""
        sizes = self.size[rows]
        sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return self.flat[np.repeat(self.start[rows] - sums[:-1], sizes) + np.arange(sums[-1])], sums


class Encoder(PieceTable):
    """Token ids of texts by a library's function for lists of texts, whose split pattern is that of GPT-2."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        super().__init__(_kinds(), _cuts(), lambda pieces: (encode(pieces),))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        rows, _, edges = self.pieces(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.size[rows], dtype=np.int64)])[edges])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts laid end to end, and the place of each text's first one, with the end."""
        rows, _, edges = self.pieces(texts)
        ids, sums = self.ids_of(rows)
        return ids, sums[edges]


def portions(batch: pa.RecordBatch, column: str = "text", most: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in parts of about ``most`` characters; null is the empty text."""
    at = 0
    while at < batch.num_rows:
        texts, size = [], 0
        while at + len(texts) < batch.num_rows and size < most:
            texts.append(batch.column(column)[at + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield at, texts
        at += len(texts)
