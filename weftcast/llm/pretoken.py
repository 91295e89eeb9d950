"""Splitting texts into pre-tokens, and encoding each distinct one once.

The pattern is that of ``public_tokenizers.PATTERN``: contractions, letters, numbers
and other marks, each with one leading space at most, and white space. It is
evaluated on arrays of code points instead of by a regular-expression engine.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from .scan import U64, Texts, gathered, same_slices, slice_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, from Unicode's own properties."""
    global _classes
    if _classes is None:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text, points = "".join(map(chr, points)), np.array(points)
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        _classes = table
    return _classes


def pretokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, and each row's first one (with one more at the end)."""
    size = texts.data.size
    if not size:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(texts.n + 1, np.int64)
    points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = points.size
    if n == size:
        byte_at, row_at = None, texts.at
    else:
        byte_at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=byte_at[1:])
        row_at = np.searchsorted(byte_at, texts.at)
    kind = classes()[points]
    begins = np.zeros(n + 3, bool)  # of a row; what stands behind the end counts as one
    begins[row_at[row_at < n]] = True
    begins[n:] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # A run of white space gives its last member away: a space to what follows it, anything else to itself.
    after = np.flatnonzero(start[:n] & ~begins[:n] & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # Contractions: a lone apostrophe that takes one or two letters along.
    quote = np.flatnonzero((points == 39) & start[:n])
    if quote.size:
        def at(k: int) -> np.ndarray:
            """The letter k places on, or 0 where the row has ended before."""
            where = np.minimum(quote + k, n - 1)
            live = ~begins[quote + 1] if k == 1 else ~begins[quote + 1] & ~begins[quote + 2]
            return np.where(live, points[where], 0)

        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, taken in ((quote[one], 1), (quote[two], 2)):
            start[found + 1] = False
            rest = found + taken + 1
            start[rest] |= kind[np.minimum(rest, n - 1)] == LETTER
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    first = np.searchsorted(starts, row_at)
    return (starts, ends, first) if byte_at is None else (byte_at[starts], byte_at[ends], first)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct slice, and which of them every slice is. Hashes tell the slices apart and their bytes decide: what has the hash of another slice without being equal to it becomes one of its own."""
    n = starts.size
    places = U64((1 << int(n).bit_length()) - 1)
    ordered = np.sort(slice_hash(data, starts, ends) & ~places | np.arange(n, dtype=U64))  # of one value: the hash without its last bits, the place in their stead
    order = (ordered & places).astype(np.int64)
    new = np.append(True, ordered[1:] & ~places != ordered[:-1] & ~places)[:n]
    where, inverse = order[new], np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    size, first = ends - starts, where[inverse]
    odd = np.flatnonzero((size != size[first]) | ~same_slices(data, starts, starts[first], np.minimum(size, size[first])))
    if odd.size:
        own: dict[bytes, int] = {}
        for k in odd.tolist():
            inverse[k] = own.setdefault(data[starts[k] : ends[k]].tobytes(), where.size + len(own))
        some, at = np.unique(inverse[odd], return_index=True)
        where = np.append(where, odd[at])
    return where, inverse


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids, joined, and their lengths."""
    return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))


class PieceEncoder:
    """Encodes texts pre-token by pre-token; what a pre-token gives is kept, by its bytes, until ``limit`` of them are held.

    ``encode`` takes distinct pre-tokens and returns the ids of all, joined, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends = np.zeros(1 << 14, np.int64)  # ends[k + 1] is the end of slot k

    def _add(self, keys: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        have, used = len(self.slot), self.used
        while self.flat.size < used + ids.size:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.ends.size < have + lens.size + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + ids.size] = ids
        self.ends[have + 1 : have + lens.size + 1] = used + np.cumsum(lens)
        self.slot.update(zip(keys, range(have, have + len(keys))))
        self.used += ids.size

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, joined, and how many each row has."""
        starts, ends, first = pretokens(texts)
        if not starts.size:
            return np.empty(0, np.uint32), np.zeros(texts.n, np.int64)
        where, inverse = distinct(texts.data, starts, ends)
        if len(self.slot) > self.limit:
            self.clear()
        blob = texts.data.tobytes()
        pieces = [blob[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        slots = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(slots < 0)
        if new.size:
            fresh = [pieces[k] for k in new.tolist()]
            have = len(self.slot)
            self._add(fresh, *self.encode(fresh))
            slots[new] = np.arange(have, have + new.size)
        ids, lens = gathered(self.flat, self.ends, slots[inverse])
        sums = np.zeros(lens.size + 1, np.int64)
        np.cumsum(lens, out=sums[1:])
        return ids, np.diff(sums[first])
