"""Token ids in binary files.

Ids are replaced by their rank of frequency and written in byte-aligned variable
length: two-bit length codes, four to a control byte, stand apart from the data
bytes. Decoding looks the control bytes up in numpy tables.

A file is one range of doc_id and, within one id or none, of the text's beginning. It is made of segments, rows of a Parquet table, of
about ``SEGMENT_TOKENS`` ids or one longer document; each has its own ranks, so no
count over the whole corpus comes first and a task holds one segment. Segments know
how many ids stand before them in their file, so only one number a file is ever
summed up on the driver.

Strings of a text that the definition lists as added tokens are one id each, as in the
library. Null and empty texts have the end id alone; a very long one is a segment. Rows with equal doc_id are ordered by
text; null ids come first. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, shuffle_parts, stored
from .pretoken import PieceEncoder, flattened
from .scan import Texts, chunks, gathered

SEGMENT_TOKENS = 1 << 21
#: Pre-tokens that go to the library as one text.
RUN = 400
SEGMENT_SCHEMA = "file int, segment int, before long, n_tokens long, doc_ids array<long>, lengths array<int>, ranked binary, control binary, data binary"

#: For every control byte: the lengths of its four values, where each starts, and their sum.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)])
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values; zeros fill the last four."""
    padded = np.zeros(-(-values.size // 4) * 4, "<u4")
    padded[: values.size] = values
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n values."""
    codes = np.frombuffer(control, np.uint8)
    ends = np.cumsum(TOTALS[codes])
    at = ((ends - TOTALS[codes])[:, None] + STARTS[codes]).ravel()[:n]
    lens = LENGTHS[codes].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(lens.max(initial=1))):
        wide = np.flatnonzero(lens > k)
        out[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class LibraryPieces:
    """Pre-tokens through the tokenizers library. Those of a space and other characters are encoded many to a call, as one text that the library splits into just these."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A space and a visible ASCII character: nothing that stands before or behind changes where the library cuts.
        joined = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] == 32 and 32 < p[1] < 127]
        order, ids, lens = [], [], []
        runs = [joined[a : a + RUN] for a in range(0, len(joined), RUN)]
        for run, done in zip(runs, self.tokenizer.encode_batch([b"".join([pieces[k] for k in run]).decode() for run in runs], add_special_tokens=False)):
            count = np.bincount(np.array(done.word_ids))
            if count.size == len(run):  # else each by itself, below
                order += run
                ids.append(np.array(done.ids, np.uint32))
                lens.append(count)
        rest = sorted(set(range(len(pieces))).difference(order))
        more, count = flattened([d.ids for d in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False)])
        place = np.empty(len(pieces), np.int64)
        place[np.array(order + rest, np.int64)] = np.arange(len(pieces))
        at = np.append(0, np.cumsum(np.concatenate([*lens, count])))
        return gathered(np.concatenate([*ids, more]), at, place)


class AddedTokenEncoder:
    """Takes a definition's added tokens out of the texts first, as the library does, and encodes the stretches between them by pre-tokens."""

    def __init__(self, definition: str):
        listed = [t for t in json.loads(definition).get("added_tokens") or [] if t["content"]]
        for t in listed:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError(f"added token {t['content']!r} takes its surroundings into account")
        self.id_of = {t["content"].encode(): t["id"] for t in listed}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.id_of, key=len, reverse=True))))
        self.encoder = PieceEncoder(LibraryPieces(definition).pieces)

    def found(self, texts: Texts) -> list[tuple[int, int]]:
        """The end in ``texts.data`` and the length of every added token, the longest of those that begin first; none lies in two rows."""
        blob, rows = texts.data.tobytes(), set()
        for token in self.id_of:
            p = blob.find(token)
            while p >= 0:
                rows.add(int(np.searchsorted(texts.at, p, "right")) - 1)
                p = blob.find(token, p + 1)
        return [(int(texts.at[row]) + m.end(), m.end() - m.start()) for row in sorted(rows) for m in self.pattern.finditer(texts.text(row))]

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, joined, and how many each row has."""
        found = self.found(texts)
        if not found:
            return self.encoder.ids(texts)
        ends, sizes = np.array(found, np.int64).T
        inside = np.zeros(texts.data.size + 1, np.int64)
        inside[ends - sizes] += 1
        np.subtract.at(inside, ends, 1)
        kept = np.cumsum(inside[:-1]) == 0
        # A stretch begins with each row and behind each token; a token that ends a row comes before the next row.
        cuts = np.concatenate([ends, texts.at])
        is_row = np.arange(cuts.size) >= ends.size
        order = np.lexsort((is_row, cuts))
        cuts, is_row = cuts[order], is_row[order]
        got, lens = self.encoder.ids(Texts(texts.data[kept], np.append(0, np.cumsum(kept))[cuts]))
        token = ~is_row[:-1]
        own = np.array([self.id_of[texts.data[e - n : e].tobytes()] for e, n in found], np.uint32)
        sums = np.append(0, np.cumsum(lens + token))
        return np.insert(got, (np.cumsum(lens) - lens)[token], own), np.diff(sums[is_row])


_encoders: dict[int, AddedTokenEncoder] = {}


def _segment(file: int, number: int, before: int, doc_ids: list, counts: list, ids: list) -> pa.RecordBatch:
    flat, lens = np.concatenate(ids), np.concatenate(counts)
    frequency = np.bincount(flat)
    ranked = np.argsort(-frequency, kind="stable")[: np.count_nonzero(frequency)].astype("<u4")
    rank = np.empty(frequency.size, np.uint32)
    rank[ranked] = np.arange(ranked.size)
    control, data = pack(rank[flat])
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays(
        [one(file, pa.int32()), one(number, pa.int32()), one(before, pa.int64()), one(flat.size, pa.int64()), one(pa.chunked_array(doc_ids).to_pylist(), pa.list_(pa.int64())), one(lens, pa.list_(pa.int32())), one(ranked.tobytes(), pa.binary()), one(control, pa.binary()), one(data, pa.binary())],
        names=["file", "segment", "before", "n_tokens", "doc_ids", "lengths", "ranked", "control", "data"],
    )


#: Rows of one doc_id, or of none, are dealt over files by so many characters of their text.
PREFIX = 256


def write_token_files(docs: DataFrame, definition: str, end_id: int, files: int | None = None) -> DataFrame:
    """Encodes by the tokenizer in the JSON file ``definition``, appends ``end_id`` to each document and writes ``files`` files in ascending doc_id order (by default as many as shuffle partitions). Returns the segments, read back."""
    spark = docs.sparkSession
    with open(definition) as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        key = id(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = AddedTokenEncoder(shared.value)
        encoder = _encoders[key]
        file, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, counts, ids = [], [], []
        for batch in batches:
            for texts in chunks(batch.column(1)):
                got, lens = encoder.ids(texts)
                doc_ids.append(batch.column(0).slice(texts.first, texts.n))
                counts.append(lens + 1)
                ids.append(np.insert(got, np.cumsum(lens), end_id).astype(np.uint32))
                held += ids[-1].size
                if held >= SEGMENT_TOKENS:
                    yield _segment(file, number, before, doc_ids, counts, ids)
                    number, before, held = number + 1, before + held, 0
                    doc_ids, counts, ids = [], [], []
        if held:
            yield _segment(file, number, before, doc_ids, counts, ids)

    ordered = docs_of(docs).repartitionByRange(files or shuffle_parts(spark), "doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, SEGMENT_SCHEMA), "token-files")


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document."""
    return _read(segments, "doc_id long, start long, ids array<int>", lambda ids, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), "ids")


def token_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (little-endian, 32 bits) of every document."""

    def crcs(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        blob, at = memoryview(ids.astype("<u4").tobytes()), (at * 4).tolist()
        return pa.array([zlib.crc32(blob[a:b]) for a, b in zip(at, at[1:])], pa.int64())

    return _read(segments, "doc_id long, start long, n_tokens long, ids_crc32 long", crcs, "ids_crc32")


def _read(segments: DataFrame, schema: str, digest, name: str) -> DataFrame:
    totals = sorted((r["file"], r["n"]) for r in segments.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # a number a file
    starts, total = {}, 0
    for file, n in totals:
        starts[file] = total
        total += n
    shared = segments.sparkSession.sparkContext.broadcast(starts)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda c: batch.column(batch.schema.get_field_index(c))[row]  # noqa: B023, E731
                n = cell("n_tokens").as_py()
                ranked = np.frombuffer(cell("ranked").as_py(), "<u4")
                ids = ranked[unpack(cell("control").as_py(), cell("data").as_py(), n)]
                lens = cell("lengths").values.to_numpy().astype(np.int64)
                at = np.append(0, np.cumsum(lens))
                columns = {"doc_id": cell("doc_ids").values, "start": pa.array(shared.value[cell("file").as_py()] + cell("before").as_py() + at[:-1]), "n_tokens": pa.array(lens), name: digest(ids, at)}
                wanted = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], names=wanted)

    return segments.select("file", "before", "n_tokens", "doc_ids", "lengths", "ranked", "control", "data").mapInArrow(run, schema)
