"""Similarity self-join on word n-grams by Jaccard, with Bayesian pruning.

A text is the set of its shingles of ``words`` consecutive words (a shorter text is one
shingle). Texts with equal sets are one class from the start and are compared once.

1. Each class has MinHash values of two kinds. ``bands`` x ``rows`` of them make band keys;
   classes that share a key are candidates. The other ``probes`` values are for pruning:
   pairs compare them eight at a time and are dropped as soon as the posterior
   probability of reaching the threshold, under a flat prior, falls below ``tolerance``.
2. Within a band, surviving pairs link classes into clusters. Only links along a tree
   leave a task, never pairs. A band of over ``most`` classes isn't gathered: a grouped
   minimum links all its classes to the least, so its cluster is coarser and is pruned in
   the next step.
3. Connected components are the clusters. A cluster's classes are dealt into blocks by
   hash and every two blocks meet in one task. Where there are many blocks, MinHash values
   meet first, and shingles travel only for classes that have a surviving pair there. The
   rest is verified exactly on the shingle sets. It returns the number of links of each
   class and again only a tree of them.

So the join's output is linear in the classes while every link is counted. The work on a
cluster of n near copies, all different, is n * n / block rows and n * n / 2 comparisons:
counting links among them costs no less. A pair at the threshold shares no band with
probability (1 - threshold**rows)**bands, 3e-6 by default, and is pruned with about
``tolerance``. A class is told by 128 bits of a cryptographic hash of its shingles, which are
64-bit hashes of words, made with random keys that are drawn for the job, so no text can be written
to make unlike words meet.

Null and empty texts have no shingles, no links and are classes of their own. Very long texts
are whole: a text is one set, in the memory of one task. Rows that repeat are members of one
class; a null doc_id is a member as any other, but never names the class if another can. Ties
of similarity at the threshold are links. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, docs_of, shuffle_parts, stored
from .components import components
from .scan import U64, Keys, chunks, groups, keyed_hash, mixed, window_hash, window_starts, words

_odd = mixed(np.arange(1, 1 + 512, dtype=np.uint64)) | U64(1)
_add = mixed(np.arange(1001, 1001 + 512, dtype=np.uint64))


def shingle_sets(texts, n_words: int, keys: Keys):
    """The sorted distinct shingles of each row."""
    starts, ends, first = words(texts)
    hashes = keyed_hash(texts.data, starts, ends, keys)
    windows, ok = window_hash(hashes, n_words), window_starts(first, n_words)
    for k in range(texts.n):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= n_words:
            yield np.unique(windows[a : b - n_words + 1])
        elif b > a:
            yield window_hash(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)
    del ok


def min_hashes(shingles: np.ndarray, a: int, b: int) -> np.ndarray:
    """MinHash values a to b of a set, 32 bits each."""
    out = np.full(b - a, 0xFFFFFFFF, np.uint32)
    for k in range(0, shingles.size, 2048):
        part = shingles[k : k + 2048]
        values = ((part[None, :] * _odd[a:b, None] + _add[a:b, None]) >> U64(32)).astype(np.uint32)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def least_matches(threshold: float, tolerance: float, probes: int, step: int = 8) -> dict[int, int]:
    """For each number n of values compared: the least number m of matches at which the posterior probability of a similarity of ``threshold`` or more is ``tolerance`` at least. The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    out = {}
    for n in range(step, probes + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # P(Beta >= threshold) = P(Binomial(n + 1, threshold) <= m)
            if tail >= tolerance:
                out[n] = m
                break
        else:
            out[n] = n
    return out


def surviving(left: np.ndarray, right: np.ndarray, needed: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two arrays of MinHash values that pruning leaves. same: both are one array, each pair counts once."""
    i, j = (np.triu_indices(len(left), 1) if same else tuple(x.ravel() for x in np.indices((len(left), len(right)))))
    matches, at = np.zeros(i.size, np.int16), 0
    for n, least in needed.items():
        matches += (left[i, at:n] == right[j, at:n]).sum(axis=1, dtype=np.int16)
        keep = matches >= least
        i, j, matches, at = i[keep], j[keep], matches[keep], n
    return i, j


class Forest:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def set_key(shingles: np.ndarray) -> bytes:
    """What tells a set from others: 128 bits of a hash of its sorted members."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _classes(n_words: int, bands: int, rows: int, probes: int, keys_: Keys):
    """doc_id and text_key, a key of the shingle set, and the values of both kinds; null for texts without shingles."""

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                keys, band, probe = [], [], []
                for s in shingle_sets(texts, n_words, keys_):
                    if not s.size:
                        keys.append(None), band.append(None), probe.append(None)
                        continue
                    keys.append(set_key(s))
                    values = min_hashes(s, 0, bands * rows + probes)
                    lanes = values[: bands * rows].astype(np.uint64).reshape(bands, rows)
                    key = mixed(np.arange(bands, dtype=np.uint64) + U64(77))
                    for r in range(rows):
                        key = mixed(key ^ lanes[:, r])
                    band.append(key.view(np.int64).tolist())
                    probe.append(values[bands * rows :].tobytes())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(texts.first, texts.n) for c in (0, 2)), pa.array(keys, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(probe, pa.binary())], names=["doc_id", "text_key", "set_key", "bands", "probes"])

    return run


def _matrix(column) -> np.ndarray:
    blob = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.stack([np.frombuffer(b.as_py(), np.uint32) for b in blob]) if len(blob) else np.empty((0, 0), np.uint32)


def _linked(needed: dict[int, int]):
    """Within each band key: edges of a tree over the classes that survive pruning."""

    def run(batches):
        for table in groups(batches, ["band"]):
            nodes = table.column("node").to_numpy()
            values, forest = _matrix(table.column("probes")), Forest(nodes.size)
            forest.join(*surviving(values, values, needed, True))
            roots = np.array([forest.root(k) for k in range(nodes.size)])
            some = np.flatnonzero(roots != np.arange(nodes.size))
            if some.size:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[roots[some]])], names=["a", "b"])

    return run


def _sides(table: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The two blocks that meet, and which rows belong to either."""
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    mine = table.column("block").to_numpy()
    return one, two, np.flatnonzero(mine == one), np.flatnonzero(mine == two)


def _alive(needed: dict[int, int]):
    """For each two blocks of a cluster: the classes that have a pair which pruning leaves."""

    def run(batches):
        for table in groups(batches, ["cluster", "one", "two"]):
            one, two, a, b = _sides(table)
            values = _matrix(table.column("probes"))
            i, j = surviving(values[a], values[b], needed, one == two)
            some = np.unique(np.concatenate([a[i], b[j]]))
            if some.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.size, table.column("cluster")[0].as_py())), pa.array(np.full(some.size, one, np.int32)), pa.array(np.full(some.size, two, np.int32)), table.column("node").combine_chunks().take(pa.array(some))], names=["cluster", "one", "two", "node"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[i] and right[j]. Many pairs are counted as products of membership matrices, slice by slice of the shingles both sides hold."""
    if i.size <= 4 * (len(left) + len(right)):
        return np.array([np.intersect1d(left[a], right[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist())], np.int64)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, common.size, 8192):
        part = common[k : k + 8192]

        def members(sets):
            out = np.zeros((len(sets), part.size), np.float32)
            for r, s in enumerate(sets):
                at = np.searchsorted(part, s)
                at[at == part.size] = 0
                out[r, at[part[at] == s]] = 1
            return out

        total += members(left) @ members(right).T
    return total[i, j].astype(np.int64)


def _verified(threshold: float, needed: dict[int, int]):
    """For each two blocks of a cluster: the links of every class, weighted by the other's members, and edges of a tree of the links."""

    def run(batches):
        for table in groups(batches, ["cluster", "one", "two"]):
            one, two, a, b = _sides(table)
            nodes, members = table.column("node").to_numpy(), table.column("members").to_numpy()
            values = _matrix(table.column("probes"))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles").combine_chunks()]
            i, j = surviving(values[a], values[b], needed, one == two)
            left, right = [sets[k] for k in a], [sets[k] for k in b]
            both = overlaps(left, right, i, j) if i.size else np.empty(0, np.int64)
            sizes = np.array([s.size for s in sets])
            union = sizes[a[i]] + sizes[b[j]] - both
            near = both >= threshold * union - 1e-9
            i, j = a[i[near]], b[j[near]]
            links = np.bincount(i, members[j], nodes.size) + np.bincount(j, members[i], nodes.size)
            forest = Forest(nodes.size)
            forest.join(i, j)
            roots = nodes[[forest.root(k) for k in range(nodes.size)]]
            some = np.flatnonzero(links > 0)
            if some.size:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(roots[some])], names=["node", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id and n_links of every row. class_id: the least doc_id that links lead to. n_links: the other rows whose sets have a similarity of ``threshold`` or more, copies included. For the parameters see ``joined``."""
    return joined(docs, **how).drop("text_key")


def joined(docs: DataFrame, threshold: float = 0.8, n_words: int = 5, bands: int = 24, rows: int = 4, probes: int = 64, tolerance: float = 1e-6, block: int = 128, most: int = 512) -> DataFrame:
    """doc_id, text_key (a hash of the text), class_id and n_links of every row."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    needed = least_matches(threshold, tolerance, probes)
    keys_ = Keys.drawn()
    narrow = docs_of(docs).withColumn("text_key", F.xxhash64("text"))
    every = stored(narrow.mapInArrow(_classes(n_words, bands, rows, probes, keys_), "doc_id long, text_key long, set_key binary, bands array<long>, probes binary"), "min-hashes")
    # A class gets a number when it is written; from then on the number stands for it.
    classes = stored(every.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("members"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("told_by"), F.first("bands").alias("bands"), F.first("probes").alias("probes")).withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("k"), F.min("node").alias("least")).where("k > 1")
    pairs = banded.join(shared.where(F.col("k") <= most).select("band"), "band").join(classes.select("node", "probes"), "node")
    pruned = pairs.repartition(parts, "band").sortWithinPartitions("band", "node").mapInArrow(_linked(needed), "a long, b long")
    starred = banded.join(shared.where(F.col("k") > most), "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    cluster = components(pruned.unionByName(starred)).select("node", F.col("label").alias("cluster"))

    sizes = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    clustered = cluster.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    clustered = stored(clustered.join(classes.select("node", "set_key", "told_by", "members", "probes"), "node"), "clusters")

    # One row of each class gives its text, told by doc_id and text, as an id may be null or stand at many texts: shingles are made again from it, not kept for all classes.
    owners = clustered.select("told_by.doc_id", "told_by.text_key", "set_key", "node")

    def shingled(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                own = batch.slice(texts.first, texts.n)
                sets = list(shingle_sets(texts, n_words, keys_))
                same = np.array([bool(s.size) and set_key(s) == k for s, k in zip(sets, own.column(2).to_pylist())], bool)
                yield pa.RecordBatch.from_arrays([own.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(pa.array(same))

    same_row = (F.col("d.text_key") == F.col("o.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("o.doc_id"))
    texts = narrow.alias("d").join(owners.alias("o"), same_row).select("d.doc_id", "d.text", "o.set_key", "o.node")
    sets = texts.mapInArrow(shingled, "node long, shingles binary").dropDuplicates(["node"])

    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two"))))
    grouped = lambda df: df.repartition(parts, "cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "node")
    met = grouped(clustered.where("blocks > 1").select("cluster", "node", "block", "probes", meeting.alias("at")).select("cluster", "node", "block", "probes", "at.one", "at.two"))
    alive = met.mapInArrow(_alive(needed), "cluster long, one int, two int, node long")
    alive = alive.unionByName(clustered.where("blocks = 1").select("cluster", F.lit(0).alias("one"), F.lit(0).alias("two"), "node"))
    dealt = grouped(alive.join(clustered.select("node", "block", "members", "probes"), "node").join(sets, "node"))
    links = stored(dealt.mapInArrow(_verified(threshold, needed), "node long, links long, root long"), "links")

    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.select("node", "set_key", "owner", "members").join(totals, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = told.groupBy("label").agg(F.min("owner").alias("class_id"))
    told = told.join(names, "label").select("set_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    # The members of a class are many rows of one key; classes go out to them, which Spark can split.
    some = every.where("set_key is not null").select("doc_id", "text_key", "set_key").join(told, "set_key").select("doc_id", "text_key", "class_id", "n_links")
    none = every.where("set_key is null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names their class; rows that repeat such a doc_id and its text stay with it."""
    gone = joined(docs, **how).where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_key").distinct().alias("g")
    left = as_rows(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "row").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    return left.join(gone, same, "left_anti").select("row.*")
