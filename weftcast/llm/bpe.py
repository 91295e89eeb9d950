"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is
itself a vocabulary entry with one probe. Any other pre-token is merged over its
linked bytes, a heap giving the pair of least rank and, among equals, the leftmost;
so a pre-token of n bytes costs O(n log n).

Null and empty texts have no tokens. Very long texts are encoded whole, each as a chunk of its
own. Repeated rows each give a row, and so does a null doc_id. Columns of the
input besides doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of
from .pretoken import PieceEncoder, flattened
from .scan import U64, chunks, gathered, mixed, slice_hash


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file (base64 and rank on each line), by rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """A minimal perfect hash of n distinct 64-bit keys onto 0..n-1: each bucket of about two keys has a displacement under which its keys fall on free places; buckets of one key name their place outright."""

    def __init__(self, keys: np.ndarray):
        n = keys.size
        if np.unique(keys).size != n:
            raise ValueError("keys repeat")
        self.n, self.buckets = n, max(1, n // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key = np.zeros(n, U64)
        self.origin = np.zeros(n, np.int64)
        bucket = (keys % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(at)
        taken = np.zeros(n, bool)
        largest_first = np.argsort(-sizes, kind="stable")
        for b in largest_first[: int((sizes > 1).sum())].tolist():
            members = order[at[b] : at[b + 1]]
            for d in range(0, 1 << 62, 64):  # 64 displacements at a time
                places = self._place(keys[members], np.arange(d, d + 64)[:, None])
                ordered = np.sort(places, axis=1)
                fits = np.flatnonzero(~taken[places].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if fits.size:
                    break
            self._put(places[fits[0]], members, keys, taken)
            self.shift[b] = d + fits[0]
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self._put(free, order[at[single]], keys, taken)
        self.shift[single] = -free - 1

    def _put(self, places: np.ndarray, members: np.ndarray, keys: np.ndarray, taken: np.ndarray) -> None:
        taken[places] = True
        self.key[places], self.origin[places] = keys[members], members

    def _place(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ (shift.astype(U64) * U64(0xBF58476D1CE4E5B9))) % U64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key among those given, or -1."""
        shift = self.shift[(keys % U64(self.buckets)).astype(np.int64)]
        places = np.where(shift < 0, -shift - 1, self._place(keys, np.maximum(shift, 0)))
        return np.where(self.key[places] == keys, self.origin[places], -1)


def slices(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=at[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), at


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token. Its parts are linked by their ends; a heap entry counts while both parts are as they were."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it was merged into the one before
    before = list(range(-1, n))  # start of the part before the one that starts here
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, start, middle, stop = heappop(heap)
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        before[stop] = start
        left = before[start]
        if left >= 0 and (r := get(piece[left:stop])) is not None:
            heappush(heap, (r, left, start, stop))
        if stop < n and (r := get(piece[start : end[stop]])) is not None:
            heappush(heap, (r, start, stop, end[stop]))
    out, start = [], 0
    while start < n:
        out.append(ranks[piece[start : end[start]]])
        start = end[start]
    return out


class ByteBpe:
    """Encoder and decoder over the entries of a rank file."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.flat, self.at = slices(tokens)
        self.table = PerfectHash(slice_hash(self.flat, self.at[:-1], self.at[1:]))
        self.ranks: dict[bytes, int] | None = None

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.ranks is None:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
        tokens, ranks = self.tokens, self.ranks
        flat, at = slices(pieces)
        return flattened([[r] if r >= 0 and tokens[r] == p else merged(p, ranks) for p, r in zip(pieces, self.table.find(slice_hash(flat, at[:-1], at[1:])).tolist())])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, joined, and the length of each."""
        return gathered(self.flat, self.at, ids.astype(np.int64))


_encoders: dict[int, tuple[ByteBpe, PieceEncoder]] = {}


def encode_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids (list of int) and decoded (bytes) for each row; no shuffle, one pass. The vocabulary is broadcast: its size is the rank file's, whatever the data."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(read_ranks(rank_file)))
    schema = "doc_id long, n_tokens long, ids array<int>, decoded binary"

    def run(batches):
        for doc_id, ids, counts, decoded, at in _encoded(shared, batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int32))), pa.array([decoded[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs_of(docs).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids (little-endian, 32 bits) and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(read_ranks(rank_file)))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(blob: memoryview, at: np.ndarray) -> pa.Array:
        return pa.array([hashlib.sha256(blob[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())

    def run(batches):
        for doc_id, ids, counts, decoded, at in _encoded(shared, batches):
            id_at = np.append(0, np.cumsum(counts)) * 4
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(counts, pa.int64()), digests(memoryview(ids.astype("<u4").tobytes()), id_at), digests(memoryview(decoded.tobytes()), at)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_of(docs).mapInArrow(run, schema)


def _encoded(shared, batches):
    """For runs of rows: their doc_id column, ids and counts, decoded bytes and their offsets."""
    bpe = shared.value
    if id(bpe) not in _encoders:  # a worker keeps what it knows from one task to the next
        _encoders.clear()
        _encoders[id(bpe)] = bpe, PieceEncoder(bpe.pieces)
    encoder = _encoders[id(bpe)][1]
    for batch in batches:
        for texts in chunks(batch.column(1)):
            ids, counts = encoder.ids(texts)
            decoded, lens = bpe.decode(ids)
            sums = np.append(0, np.cumsum(lens))
            at = sums[np.append(0, np.cumsum(counts))]
            yield batch.column(0).slice(texts.first, texts.n), ids, counts, decoded, at
