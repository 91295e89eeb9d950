"""Removal of passages that repeat, by fixed-block anchors.

Documents are cut into non-overlapping reference blocks of ``block`` words, and every
rolling window of that many words probes them. A window of ``2 * block - 1`` words
always holds a whole block, so each place of a passage that repeats over that length
has an anchor: a probe that meets a block. Around the anchors, and only there, windows
of full length are compared, by 96 bits beside their bucket; joined, the windows found are
the maximal exact repeats. Words are hashed with random keys drawn for the job, the two parts of a
window key with different ones, so no text can be written to make unlike windows meet.

How it moves: windows travel packed, per chunk of text and bucket, and a chunk sends
each distinct window once with a mark if it has it more than once. So a passage that a
third of all rows share gives its bucket one entry a chunk, not one a row, and nothing
is ever paired. A chunk's own record says which of its windows equal which. Text moves
only for documents that have an anchor.

Null and empty texts have no words. Texts shorter than a window lose nothing; very long ones
are chunks of their own and repeat within themselves too. Rows that repeat, even with the same
or a null doc_id, are separate places and lose their passages alike.
Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, shuffle_parts, stored
from .scan import U64, Keys, chunks, keyed_hash, window_hash, window_starts, words
from .tokenbin import pack, unpack

CHUNK = 4 << 20
PACKED = "bucket int, chunk long, n int, keys binary, control binary, data binary, doc_ids array<long>, text_keys array<long>, n_words array<int>, shas array<string>, copies array<int>"


def _packed_windows(words_of: np.ndarray, others: np.ndarray | None, first: np.ndarray, n: int, allowed: np.ndarray | None, buckets: int):
    """(bucket, n, keys, control, data) of the distinct n-word windows of a chunk, and pairs of a window and an equal earlier one. An entry is the way from the last position, with two marks: held more than once; a reference block. others: hashes of the words by keys of their own, for the second half of wide window keys."""
    ok = window_starts(first, n)
    if allowed is not None:
        ok &= allowed[: ok.size]
    at = np.flatnonzero(ok)
    hashes = window_hash(words_of, n)[at]
    if not at.size:
        return [], np.empty(0, np.int32)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    run = np.cumsum(new) - 1
    lead = at[order[new]]  # the earliest window of each distinct hash: the sort is stable
    many = np.bincount(run) > 1
    starts = at - np.repeat(first[:-1], np.diff(first))[at]
    block = np.zeros(lead.size, bool)
    np.logical_or.at(block, run, (starts % n == 0)[order])
    copies = np.stack([at[order[~new]], lead[run[~new]]], axis=1).astype(np.int32).ravel()
    value = ordered[new]
    bucket = (value % U64(buckets)).astype(np.int32)
    by = np.lexsort((lead, bucket))
    lead, many, block, value, bucket = lead[by], many[by], block[by], value[by] // U64(buckets), bucket[by]
    if others is not None:
        second = window_hash(others, n, 1)[lead]
        keys = np.concatenate([value.astype("<u8").view(np.uint8).reshape(-1, 8), second.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    else:
        keys = value.astype("<u4").view(np.uint8).reshape(-1, 4)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), bucket.size]):
        control, data = pack((np.diff(lead[a:b], prepend=0).astype(np.uint32) << 2) | (many[a:b] << 1) | block[a:b])
        out.append((int(bucket[a]), b - a, np.ascontiguousarray(keys[a:b]).tobytes(), control, data))
    return out, copies


def _emit(n: int, buckets: int, keys: list[Keys], candidates: int):
    """Packed windows of n words for each chunk, and one record of the chunk itself. candidates: over 0, only windows that hold an anchor of that length, from the column hits. keys: one or, for wide window keys, two."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.schema.names
            for texts in chunks(batch.column(names.index("text")), CHUNK):
                starts, ends, first = words(texts)
                hashes, *second = (keyed_hash(texts.data, starts, ends, k) for k in keys)
                chunk = part << 32 | number
                number += 1
                own = batch.slice(texts.first, texts.n)
                allowed = None
                if candidates:
                    hits = own.column(names.index("hits"))
                    lens = np.diff(np.frombuffer(hits.buffers()[1], np.int32)[hits.offset : hits.offset + texts.n + 1])
                    at = hits.flatten().to_numpy() + np.repeat(first[:-1], lens)
                    reach = np.zeros(hashes.size + 1, np.int64)  # window i holds the anchor p if i is from p + candidates - n to p
                    np.add.at(reach, np.maximum(at + candidates - n, 0), 1)
                    np.add.at(reach, at + 1, -1)
                    allowed = np.cumsum(reach[:-1]) > 0
                rows, copies = _packed_windows(hashes, second[0] if second else None, first, n, allowed, buckets)
                for a in range(0, len(rows), 4096):
                    some = rows[a : a + 4096]
                    none = [None] * len(some)
                    columns = [list(c) for c in zip(*some)]
                    yield _batch([columns[0], [chunk] * len(some), *columns[1:], none, none, none, none, none])
                counts = np.diff(first)
                if candidates:
                    shas = [""] * texts.n
                else:
                    shas = [hashlib.sha256(b" ".join(texts.text(k).split())).hexdigest() for k in range(texts.n)]
                yield _batch([[chunk % buckets], [chunk], [0], [None], [None], [None], [own.column(names.index("doc_id")).to_pylist()], [own.column(names.index("text_key")).to_pylist()], [counts.tolist()], [shas], [copies]])

    return run


def _batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def _met(held: list[tuple], wide: bool, blocks: bool) -> list[tuple[int, np.ndarray]]:
    """Of one bucket: the chunk and the positions of each entry whose window stands at two places or more (and at a reference block, if ``blocks``)."""
    width = 12 if wide else 4
    sizes = [n for _, n, *_ in held]
    raw = np.concatenate([np.frombuffer(keys, np.uint8).reshape(-1, width) for _, _, keys, _, _ in held])
    entries = [unpack(control, data, n) for _, n, _, control, data in held]
    marks = np.concatenate([e & 3 for e in entries])
    low = np.zeros((raw.shape[0], 8), np.uint8)
    low[:, : min(8, width)] = raw[:, :8]
    low = low.view("<u8").ravel()
    if wide:
        high = np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
        order = np.lexsort((high, low))
        new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
    else:
        order = np.argsort(low, kind="stable")
        new = np.append(True, low[order][1:] != low[order][:-1])
    run = np.cumsum(new) - 1
    good = (np.bincount(run) > 1) | (np.bincount(run, weights=marks[order] >> 1 & 1) > 0)
    if blocks:
        good &= np.bincount(run, weights=marks[order] & 1) > 0
    found = np.empty(order.size, bool)
    found[order] = good[run]
    out, a = [], 0
    for (chunk, *_), entry, n in zip(held, entries, sizes):
        where = np.cumsum((entry >> np.uint32(2)).astype(np.int64))[found[a : a + n]]
        if where.size:
            out.append((chunk, where.astype(np.int32)))
        a += n
    return out


def _meet(wide: bool, blocks: bool):
    """Buckets, one after the other, to positions by chunk; the chunks' records pass through."""
    kinds = {"chunk": pa.int64(), "at": pa.list_(pa.int32()), "doc_ids": pa.list_(pa.int64()), "text_keys": pa.list_(pa.int64()), "n_words": pa.list_(pa.int32()), "shas": pa.list_(pa.string()), "copies": pa.list_(pa.int32())}
    passed = list(kinds)[2:]

    def given(found):
        none = [None] * len(found)
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([p for _, p in found], pa.list_(pa.int32())), *[pa.array(none, kinds[k]) for k in passed]], names=list(kinds))

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            n = batch.column(2).to_numpy()
            for k in np.flatnonzero(n == 0).tolist():
                own = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([None], kinds["at"]), *[own.column(own.schema.get_field_index(c)) for c in passed]], names=list(kinds))
            buckets, chunk_ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.flatnonzero(n > 0).tolist():
                if buckets[k] != bucket and held:
                    if found := _met(held, wide, blocks):
                        yield given(found)
                    held = []
                bucket = buckets[k]
                held.append((int(chunk_ids[k]), int(n[k]), batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), batch.column(5)[k].as_py()))
        if held and (found := _met(held, wide, blocks)):
            yield given(found)

    return run, "chunk long, at array<int>, doc_ids array<long>, text_keys array<long>, n_words array<int>, shas array<string>, copies array<int>"


def _by_document(batches):
    """A chunk's positions, with those of equal windows, given to its documents."""
    for batch in batches:
        for row in batch.to_pylist():
            first = np.append(0, np.cumsum(np.array(row["n_words"], np.int64)))
            at = np.array(row["at"], np.int64)
            hit = np.zeros(int(first[-1]) + 1, bool)
            hit[at] = True
            copies = np.array(row["copies"], np.int64).reshape(-1, 2)
            hit[copies[hit[copies[:, 1]], 0]] = True
            at = np.flatnonzero(hit)
            cuts = np.searchsorted(at, first)
            per = [(at[a:b] - f).astype(np.int32) for a, b, f in zip(cuts, cuts[1:], first)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["text_keys"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(row["shas"], pa.string()), pa.array(per, pa.list_(pa.int32()))], names=["doc_id", "text_key", "n_words", "sha", "hits"])


def _repeats(rows: DataFrame, n: int, keys: list[Keys], candidates: int) -> DataFrame:
    """doc_id, text_key, n_words, sha and hits: the word positions of n-word windows that repeat."""
    parts = shuffle_parts(rows.sparkSession)
    buckets = 4 * parts
    packed = rows.mapInArrow(_emit(n, buckets, keys, candidates), PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    meet, schema = _meet(len(keys) > 1, blocks=not candidates)
    found = packed.mapInArrow(meet, schema)
    own = [F.max(F.struct(F.col("doc_ids").isNotNull(), *names)).alias("own") for names in [["doc_ids", "text_keys", "n_words", "shas", "copies"]]]
    chunks_ = found.groupBy("chunk").agg(F.flatten(F.collect_list("at")).alias("at"), *own)
    return chunks_.select("at", "own.*").mapInArrow(_by_document, "doc_id long, text_key long, n_words long, sha string, hits array<int>")


def _kept(length: int):
    """n_removed and the kept text of each row, from the starts of the windows that repeat."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            removed, kept = [], []
            hits = batch.column(names.index("hits")).to_pylist()
            for texts in chunks(batch.column(names.index("text")), CHUNK):
                for k in range(texts.n):
                    all_ = texts.text(k).split()
                    change = np.zeros(len(all_) + 1, np.int64)
                    at = np.array(hits[texts.first + k] or [], np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(all_, gone.tolist()) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("n_words")).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, block: int = 18) -> tuple[DataFrame, DataFrame]:
    """Documents without an anchor (doc_id, n_words, sha of the words joined by one space), and those with: doc_id, text, n_words, hits, the starts of the windows of 2 * block - 1 words that stand elsewhere too."""
    length, keys = 2 * block - 1, [Keys.drawn(), Keys.drawn()]
    keyed = docs_of(docs).withColumn("text_key", F.xxhash64("text"))
    anchored = stored(_repeats(keyed, block, keys[:1], candidates=0), "anchors")
    plain = anchored.where(F.size("hits") == 0).select("doc_id", "n_words", "sha")
    key = ["doc_id", "text_key"]
    some = anchored.where(F.size("hits") > 0).dropDuplicates(key).select("doc_id", "text_key", "n_words", "hits")
    left, right = keyed.alias("l"), some.alias("r")
    same = F.col("l.text_key").eqNullSafe(F.col("r.text_key")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    # Stored, so that a task that runs again sees its rows in the same order: places in a chunk are told by it.
    joined = stored(left.join(right, same).select("l.doc_id", "l.text", "l.text_key", "r.n_words", "r.hits"), "anchored-texts")
    full = _repeats(joined, length, keys, candidates=block).dropDuplicates(key).select("doc_id", "text_key", F.col("hits").alias("starts"))
    left, right = joined.alias("l"), full.alias("r")
    return plain, left.join(right, same).select("l.doc_id", "l.text", "l.n_words", F.col("r.starts").alias("hits"))


def without_repeats(docs: DataFrame, block: int = 18) -> DataFrame:
    """doc_id, n_words, n_removed and the text of the words kept, for documents with an anchor; others are unchanged and not returned."""
    _, some = repeated_windows(docs, block)
    return some.mapInArrow(_kept(2 * block - 1), "doc_id long, n_words long, n_removed long, kept string")


def removal_digests(docs: DataFrame, block: int = 18) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space, of every document."""
    plain, some = repeated_windows(docs, block)
    kept = some.mapInArrow(_kept(2 * block - 1), "doc_id long, n_words long, n_removed long, kept string")
    return plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")).unionByName(kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
