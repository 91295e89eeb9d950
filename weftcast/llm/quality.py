"""Quality by votes of near neighbours in a latent-semantic space.

A text becomes counts of terms: shapes of words, pairs of shapes, hashed words, and how
words, pairs of words and lines repeat within it. On a bounded sample of labelled rows
(``sample`` rows, those of least hash) the counts are weighted by their entropy and
decomposed; the leading right singular vectors take any text into the latent space.
The sample's vectors are broadcast (at most ``sample`` x ``rank`` floats) and every
document is multiplied with all of them, in blocks; the nearest vote with a weight that
falls with the angle.

Null and empty texts have no terms: their score is the sample's share of label 1, or 0.5
without labels. Very long texts count whole. Rows that repeat score alike; a null doc_id is
scored and never held out. Rows of labels without a document, with a
null id or label, count for nothing. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, stored
from .scan import U64, Texts, byte_set, chunks, mixed, slice_hash, words

SHAPES, PAIRS, WORDS, REPEATS = 640, 512, 512, 8
TERMS = SHAPES + PAIRS + WORDS + REPEATS

_upper, _digit, _high = byte_set(bytes(range(65, 91))), byte_set(b"0123456789"), byte_set(bytes(range(128, 256)))
_stop = byte_set(b".,;:!?")
_symbol = byte_set(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()"))
_line = byte_set(b"\n\r")


def _again(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a row has had the same hash before."""
    key = hashes ^ mixed(row.astype(U64) + U64(1))
    out = np.ones(key.size, bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def term_counts(texts: Texts) -> np.ndarray:
    """Square roots of the shares of all terms, a row a text."""
    data, (starts, ends, first) = texts.data, words(texts)
    n = starts.size
    if not n:
        return np.zeros((texts.n, TERMS), np.float32)
    row = np.repeat(np.arange(texts.n), np.diff(first))

    def held(kind: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind[data], dtype=np.int32))
        return sums[ends] - sums[starts]

    size, upper = ends - starts, held(_upper)
    last = data[ends - 1]
    shape = _upper[data[starts]] + 2 * (upper * 2 > size) + 4 * (held(_digit) > 0) + 8 * (held(_symbol) > 0) + 16 * (held(_high) > 0) + 32 * _stop[last] + 64 * _symbol[last]
    hashes = slice_hash(data, starts, ends)
    follows = np.append(False, row[1:] == row[:-1])
    before = np.append(0, shape[:-1]) * follows
    twice = follows & (np.append(hashes[:1], hashes[:-1]) == hashes)
    pair = mixed(hashes + U64(3) * np.append(hashes[:1], hashes[:-1])) * follows.astype(U64)
    old, old_pair = _again(row, hashes), _again(row, pair) & follows
    long_ = size > 5
    line_start, line_end, line_first = words(texts, _line)
    line_row = np.repeat(np.arange(texts.n), np.diff(line_first))
    line_old = _again(line_row, slice_hash(data, line_start, line_end))
    lines_of = np.maximum(np.bincount(line_row, minlength=texts.n), 1)
    repeats = [(row, twice), (row, long_ & old), (row, long_ & ~old), (row, old_pair), (row, follows & ~old_pair), (row, shape == 0)]
    at = SHAPES + PAIRS + WORDS
    columns = [shape * 5 + np.searchsorted([3, 6, 10, 16], size, "right"), SHAPES + (mixed((before * 128 + shape).astype(U64)) % U64(PAIRS)).astype(np.int64), SHAPES + PAIRS + (hashes % U64(WORDS)).astype(np.int64)]
    cells = [row * TERMS + c for c in columns] + [r[m] * TERMS + at + k for k, (r, m) in enumerate(repeats)]
    counts = np.bincount(np.concatenate(cells), minlength=texts.n * TERMS).reshape(texts.n, TERMS).astype(np.float32)
    counts /= np.maximum(np.diff(first), 1)[:, None]
    counts[:, at + 6] = np.bincount(line_row[line_old], minlength=texts.n) / lines_of
    counts[:, at + 7] = np.bincount(line_row[~line_old], minlength=texts.n) / lines_of * (np.diff(first) > 0)
    return np.sqrt(counts)


class Neighbours:
    """A latent space and the labelled vectors in it: all of it within ``sample`` x ``rank`` and TERMS x ``rank`` floats."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = 48, nearest: int = 15, sharpness: float = 12.0):
        self.nearest, self.sharpness = nearest, sharpness
        self.prior = float(labels.mean()) if labels.size else 0.5
        self.labels = labels.astype(np.float32)
        self.space = None
        if labels.size < 2 or labels.min() == labels.max():
            return
        share = counts**2
        share /= np.maximum(share.sum(axis=0), 1e-9)
        entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0, dtype=np.float64)
        del share
        weight = 1.05 - entropy / np.log(len(labels))
        weight[-REPEATS:] = 3.0
        self.mean = counts.mean(axis=0)
        # The right singular vectors are the eigenvectors of the terms' products, TERMS x TERMS whatever the sample.
        weighted = (counts - self.mean) * weight.astype(np.float32)
        products = np.zeros((TERMS, TERMS))
        for k in range(0, len(weighted), 256):
            part = weighted[k : k + 256].astype(np.float64)
            products += part.T @ part
        del weighted
        _, vectors = np.linalg.eigh(products)
        self.space = (vectors[:, ::-1][:, :rank] * weight[:, None]).astype(np.float32)
        del products, vectors
        self.vectors = self.latent(counts)
        self.cut = 0.5
        own = self.votes(self.vectors, np.arange(len(labels)))
        self.cut = best_cut(own, labels)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        out = ((counts - self.mean) @ self.space).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def votes(self, vectors: np.ndarray, own: np.ndarray | None = None, block: int = 512) -> np.ndarray:
        """The weighted share of label 1 among the nearest; ``own`` names the rows of the sample that the vectors are themselves, which don't vote."""
        out = np.empty(len(vectors))
        k = min(self.nearest, self.labels.size - 1)
        for a in range(0, len(vectors), block):
            cosine = vectors[a : a + block] @ self.vectors.T
            if own is not None:
                cosine[np.arange(len(cosine)), own[a : a + block]] = -2
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.exp(self.sharpness * (np.take_along_axis(cosine, near, axis=1).astype(np.float64) - 1))
            out[a : a + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes, stretched so that the cut which parts the sample best comes to 0.7."""
        out = np.full(counts.shape[0], self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if self.space is not None and some.size:
            vote = self.votes(self.latent(counts[some]))
            out[some] = np.where(vote < self.cut, 0.7 * vote / self.cut, 0.7 + 0.3 * (vote - self.cut) / (1 - self.cut))
        return out


def best_cut(votes: np.ndarray, labels: np.ndarray) -> float:
    """The cut between two neighbouring votes with the fewest errors, the middle of the widest gap among equals."""
    order = np.argsort(votes, kind="stable")
    sorted_, ones = votes[order], labels[order] == 1
    errors = np.cumsum(ones)[:-1] + (~ones).sum() - np.cumsum(~ones)[:-1]
    gap = np.diff(sorted_)
    errors = np.where(gap > 0, errors, errors.max() + 1)
    at = np.lexsort((-gap, errors))[0]
    return float(np.clip((sorted_[at] + sorted_[at + 1]) / 2, 0.05, 0.95)) if gap[at] > 0 else 0.5


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn, sample: int) -> DataFrame:
    """The texts and labels of at most ``sample`` rows that ``learn`` (a condition on doc_id) admits, those of least hash. A row that repeats its doc_id, label and text counts once, so the bound holds however often ids are repeated."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & learn(F.col("doc_id")))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    keyed = docs_of(docs).withColumn("text_key", F.xxhash64("text"))
    # An id may stand at many texts and a text at many rows: which of them, is settled by their hashes before texts move.
    keys = keyed.select("doc_id", "text_key").join(F.broadcast(chosen), "doc_id").distinct()  # at most ``sample`` labels
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "text_key").limit(sample)
    return keyed.join(F.broadcast(keys), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "label"]).select("doc_id", "text", "label")


def fitted(docs: DataFrame, labels: DataFrame, held_part: int = 2, parts: int = 4, sample: int = 4096) -> Neighbours:
    """Learns from the labelled rows whose fold isn't ``held_part``. Terms are counted where the documents are; one task, of at most ``sample`` rows of TERMS floats, decomposes them, and the driver gets the model alone."""
    counted = "doc_id long, label int, counts binary"

    def count(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                counts = term_counts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), batch.column(2).slice(texts.first, texts.n), pa.array([c.astype(np.float32).tobytes() for c in counts], pa.binary())], names=["doc_id", "label", "counts"])

    def learn(batches):
        counts, labels_ = [np.empty((0, TERMS), np.float32)], [np.empty(0, np.int64)]
        for batch in batches:
            counts.append(np.array([np.frombuffer(c.as_py(), np.float32) for c in batch.column(2)], np.float32).reshape(-1, TERMS))
            labels_.append(batch.column(1).to_numpy().astype(np.int64))
        model = Neighbours(np.concatenate(counts), np.concatenate(labels_))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = labelled(docs, labels, "quality", lambda i: fold(i, parts) != held_part, sample).mapInArrow(count, counted)
    ordered = stored(rows, "quality-sample").repartition(1).sortWithinPartitions("doc_id", "label", "counts")
    got = ordered.mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else Neighbours(np.empty((0, TERMS), np.float32), np.empty(0, np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, held_part: int = 2, parts: int = 4, threshold: float = 0.7, sample: int = 4096) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, held_part, parts, sample))

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                score = model.value.score(term_counts(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(score)], names=["doc_id", "score"])

    scored = docs_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held_part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **fit))
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.concatenate([model.value.score(term_counts(t)) for t in chunks(batch.column(text).cast(pa.string()))] or [np.empty(0)]) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
