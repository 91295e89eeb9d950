"""Exact deduplication with owners in Patricia tries.

Texts are normalised by lower-casing A-Z alone. Each map task merges the equal texts of
a batch, so that a text which a third of all rows share is sent once a batch. Texts are
dealt out by length and content hash, and a partition inserts them in that order as full
byte strings into a compressed radix trie, whose terminal nodes hold the owner's
identifier (the smallest or the largest doc_id), the digest and the number of rows. The
sort is Spark's and spills. A trie that holds over ``TRIE_BYTES`` is emptied subtree by
subtree at the next change of length or hash, so equal texts always meet in one trie and
memory holds that many bytes and one text.

Null counts as empty; empty texts are equal. Very long texts are keys as any other, and memory
holds one of them at least. A null doc_id never owns a group that has
another. Rows that repeat a doc_id and its text stay or go together. Columns besides
doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, docs_of, shuffle_parts
from .scan import chunks


#: Bytes of distinct labels that a trie holds before it is emptied.
TRIE_BYTES = 32 << 20


def common_prefix(a: bytes, b: bytes) -> int:
    """How many leading bytes two strings share, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Patricia:
    """A radix trie over byte strings; a node is [label, children by first byte, terminal]. ``held`` is the bytes of all labels."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, key: bytes) -> list:
        """The node that ends ``key``, made if it's new."""
        node, at = self.root, 0
        while True:
            label = node[0]
            rest = key[at : at + len(label)]
            if rest != label:
                same = common_prefix(label, rest)
                node[:] = [label[:same], {label[same]: [label[same:], node[1], node[2]]}, None]
            at += len(node[0])
            if at == len(key):
                return node
            if key[at] not in node[1]:
                node[1][key[at]] = [key[at:], {}, None]
                self.held += len(key) - at
                return node[1][key[at]]
            node = node[1][key[at]]

    def emptied(self) -> Iterator:
        """The terminals, subtree by subtree; a subtree is let go as soon as it has been told."""
        todo = [self.root]
        while todo:
            _, children, held = todo.pop()
            if held is not None:
                yield held
            todo += children.values()
            children.clear()
        self.root, self.held = [b"", {}, None], 0


def _merged(keep: str, with_text: bool):
    """Equal texts of a batch as one row: with their text, owner and count, or else with all their doc_ids."""
    best = max if keep == "largest" else min

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found: dict[bytes, tuple[bytes, list]] = {}
            for texts in chunks(batch.column(1)):
                lower = texts.data.tobytes().lower()
                at = texts.at.tolist()
                for k, (a, b) in enumerate(zip(at, at[1:]), texts.first):
                    text = lower[a:b]
                    digest = hashlib.sha256(text).digest()
                    if digest in found:
                        found[digest][1].append(ids[k])
                    else:
                        found[digest] = (text if with_text else b"", [ids[k]])
            digests = pa.array(list(found), pa.binary())
            members = [m for _, m in found.values()]
            if with_text:
                named = [[i for i in m if i is not None] for m in members]
                columns = {"n_bytes": pa.array([len(t) for t, _ in found.values()], pa.int64()), "hash": pa.array([int.from_bytes(d[:8], "little", signed=True) for d in found], pa.int64()), "text": pa.array([t for t, _ in found.values()], pa.binary()), "owner": pa.array([best(m) if m else None for m in named], pa.int64()), "n": pa.array([len(m) for m in members], pa.int64())}
            else:
                columns = {"digest": digests, "members": pa.array(members, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _owners(keep: str, limit: int):
    best = max if keep == "largest" else min

    def run(batches):
        last, trie = None, Patricia()
        for batch in batches:
            lengths, hashes, owners, counts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            texts = batch.column(2)
            for k, key in enumerate(zip(lengths, hashes)):
                if key != last and trie.held > limit:
                    yield from _owner_batches(trie.emptied())
                last, text = key, texts[k].as_py()
                node = trie.terminal(text)
                if node[2] is None:
                    node[2] = [hashlib.sha256(text).digest(), owners[k], counts[k]]
                else:
                    both = [i for i in (node[2][1], owners[k]) if i is not None]
                    node[2][1], node[2][2] = best(both) if both else None, node[2][2] + counts[k]
        yield from _owner_batches(trie.emptied())

    return run


def _owner_batches(rows: Iterator, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        columns = list(zip(*some))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["digest", "keep_id", "group_size"])


def owners(docs: DataFrame, keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """digest (SHA-256 of the normalised text), keep_id and group_size of each distinct text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    sent = docs_of(docs).mapInArrow(_merged(keep, True), "n_bytes long, hash long, text binary, owner long, n long")
    dealt = sent.repartition(shuffle_parts(docs.sparkSession), "n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    return dealt.mapInArrow(_owners(keep, limit), "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    members = docs_of(docs).mapInArrow(_merged(keep, False), "digest binary, members array<long>")
    told = members.join(owners(docs, keep), "digest")
    return told.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256")).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def normalised_digest(text: Column) -> Column:
    """The digest of a text column, without Python."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()).cast("binary"), 256))


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, that own their text."""
    left = as_rows(docs).select("doc_id", normalised_digest(F.col("text")).alias("digest"), "row").alias("d")
    kept = owners(docs, keep).select("digest", "keep_id").alias("k")
    same = (F.col("d.digest") == F.col("k.digest")) & F.col("d.doc_id").eqNullSafe(F.col("k.keep_id"))
    return left.join(kept, same, "left_semi").select("row.*")
