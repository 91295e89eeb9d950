"""Vectorised scanning of Arrow string columns inside a task.

A text column is one UTF-8 buffer with offsets. The helpers here find words in
that buffer, hash byte slices and slide windows over word hashes, all with
numpy and without one Python object per word. They keep no state between
calls and hold a few arrays of the size of one chunk (``CHUNK_BYTES`` of text, or
one text if it is longer).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are taken together up to this size; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Odd multipliers of the hashes, one for each kind of window hash.
BYTE_FACTOR = U64(0x9E3779B97F4A7C15)
WINDOW_FACTORS = (U64(0xD1B54A32D192ED03), U64(0xA0761D6478BD642F))
#: Words over this many bytes are hashed one by one; shorter ones together, eight bytes at a time.
LONG_WORD = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Texts:
    """Some rows of a string column: ``data`` holds their UTF-8 bytes, row k is data[at[k]:at[k+1]]. Null counts as empty."""

    __slots__ = ("at", "data", "first", "n")

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int = 0):
        self.data, self.at, self.n, self.first = data, at, at.size - 1, first

    def text(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k + 1]].tobytes()


def whole(column: pa.Array) -> Texts:
    """A string or binary column as one buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return Texts(data[at[0] : at[-1]], at - at[0])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of consecutive rows of about ``limit`` bytes; ``first`` is the row at which a run starts."""
    all_ = whole(column)
    k = 0
    while k < all_.n:
        end = int(np.searchsorted(all_.at, all_.at[k] + limit, "right")) - 1
        end = min(max(end, k + 1), all_.n)
        at = all_.at[k : end + 1]
        yield Texts(all_.data[at[0] : at[-1]], at - at[0], k)
        k = end


def byte_set(members: bytes) -> np.ndarray:
    """A table of 256 booleans."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Word separators: space and 0x09 to 0x0D.
SPACES = byte_set(b" \t\n\v\f\r")


def words(texts: Texts, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``texts.data``, and for each row the index of its first word (with one more at the end)."""
    inside = ~separators[texts.data]
    size = inside.size
    if not size:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(texts.n + 1, np.int64)
    prev = np.empty(size, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    cut = texts.at[1:-1]
    cut = cut[cut < size]
    prev[cut] = False
    starts = np.flatnonzero(inside & ~prev)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.at)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number, zeros behind the end; a view of a copy, not eight times the size."""
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (data.size + 1,), (1,))


#: For a length of 0 to 8 bytes: the bits that belong to it.
_of_length = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def slice_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of ``data``; equal slices have equal hashes wherever they stand. The function is fixed, so slices can be made that meet in it: where a result rests on two slices being the same, compare their bytes or use ``keyed_hash``."""
    size = ends - starts
    at8 = eights(data)
    out = mixed(size.astype(U64) * BYTE_FACTOR + U64(1))
    if not size.size:
        return out
    out = mixed(out ^ (at8[starts] & _of_length[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while live.size:
        part = at8[starts[live] + done] & _of_length[np.minimum(size[live] - done, 8)]
        out[live] = mixed(out[live] * BYTE_FACTOR + part)
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


class Keys:
    """The random numbers of a keyed hash, made of ``seed``; the same seed gives the same hash in all tasks."""

    def __init__(self, seed: bytes):
        drawn = hashlib.shake_256(seed).digest(16 * (LONG_WORD // 4 + 4))
        numbers = np.frombuffer(drawn, "<u8").reshape(2, -1)
        self.secret, self.add, self.by = hashlib.blake2b(seed, digest_size=32).digest(), numbers[:, 0], numbers[:, 1:]

    @classmethod
    def drawn(cls) -> Keys:
        """Keys that nobody knows beforehand: made by the driver, once a job."""
        return cls(secrets.token_bytes(32))


def keyed_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: Keys) -> np.ndarray:
    """64-bit hashes of slices of ``data``: twice the upper half of a sum of the length and the slice's 32-bit numbers, each times a random number of its own. Whatever two different slices are, as long as they don't depend on the keys, they meet with a probability of 2**-64 (multilinear hashing is strongly universal); slices of over LONG_WORD bytes go through a keyed cryptographic hash. Equal slices have equal hashes wherever they stand."""
    size = ends - starts
    one, two = (a + b * size.astype(U64) for a, b in zip(keys.add, keys.by[:, 0]))
    if not size.size:
        return one
    at8, low = eights(data), U64(0xFFFFFFFF)
    live, done, some = None, 0, 1
    while live is None or live.size:
        begin, left = (starts, size) if live is None else (starts[live] + done, size[live] - done)
        part = at8[begin] & _of_length[np.minimum(left, 8)]
        first, second = part & low, part >> U64(32)
        more = [b[some] * first + b[some + 1] * second for b in keys.by]
        if live is None:
            one += more[0]
            two += more[1]
            live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        else:
            one[live] += more[0]
            two[live] += more[1]
        done, some = done + 8, some + 2
        live = live[size[live] > done]
    out = mixed((one & ~low) | (two >> U64(32)))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=keys.secret).digest(), "little")
    return out


def same_slices(data: np.ndarray, starts: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``starts`` and from ``others`` on agree over ``size`` bytes."""
    at8 = eights(data)
    out = np.ones(size.size, bool)
    live, done = np.flatnonzero((starts != others) & (size > 0)), 0
    while live.size:
        if done >= LONG_WORD:
            for k in live.tolist():
                out[k] = np.array_equal(data[starts[k] + done : starts[k] + size[k]], data[others[k] + done : others[k] + size[k]])
            break
        differ = (at8[starts[live] + done] ^ at8[others[live] + done]) & _of_length[np.minimum(size[live] - done, 8)]
        out[live] &= differ == 0
        done += 8
        live = live[size[live] > done]
    return out


def window_hash(hashes: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Hashes of every n consecutive entries, put together from windows of 1, 2, 4 and so on entries, each mixed."""
    size, factor = hashes.size - n + 1, WINDOW_FACTORS[kind]
    if size <= 0:
        return np.empty(0, U64)
    out, part, length, at = None, hashes, 1, 0  # part: windows of ``length`` entries
    while True:
        if n & length:
            own = part[at : at + size]
            out = mixed(own ^ factor) if out is None else mixed(out * factor + own)
            at += length
        if 2 * length > n:
            return out
        part = mixed(part[:-length] * factor + part[length:])
        length *= 2


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """True where n words from a word on belong to one row; of length max(words - n + 1, 0)."""
    total = int(first[-1])
    if total < n:
        return np.empty(0, bool)
    row_end = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(n, total + 1) <= row_end


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the given lengths over ``values``."""
    at = np.zeros(counts.size + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values, kind))


def gathered(flat: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[k]:at[k+1]] for each k of ``pick``, joined; and the lengths."""
    lens = at[pick + 1] - at[pick]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if ends.size else 0
    where = np.repeat(at[pick] - (ends - lens), lens)
    where += np.arange(total)
    return flat[where], lens


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys``, from batches in which equal keys stand together."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)
