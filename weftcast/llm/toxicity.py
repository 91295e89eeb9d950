"""Toxicity by gradient-boosted trees over dense features, calibrated.

The features of a text are densities of a lexicon, the nearness of second-person words
to it, and rates of capitals, punctuation and obfuscated spelling. The lexicon is learned:
words and their first letters that labelled toxic texts have far oftener than others.
A bounded sample of labelled rows (``sample``, those of least hash) is cross-fitted in
four parts by hash: a row's features come from a lexicon, and its raw score for the
isotonic calibration from trees, that haven't seen its part, so that nothing judges its
own evidence. Lexicon counts are Spark aggregates; the driver gets the entries alone, of which
each stands in three toxic texts of the sample at least.

Null and empty texts have features of zero and a score as the trees give it; very long texts
count whole. Rows that repeat, and ties, score alike; a null doc_id is scored and never held out. Without both labels every score is the sample's share, or 0.5.
Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, stored
from .quality import labelled
from .scan import Texts, byte_set, chunks, slice_hash, words

#: Second-person words of the languages of the corpus.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os vuestro".split()
#: Marks and digits that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Bytes of a word's beginning that the lexicon has entries for, besides the whole word.
PREFIXES = (4, 5, 6)

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
for _mark, _letter in LOOKALIKES.items():
    _fold[ord(_mark)] = ord(_letter)
_split = byte_set(bytes(c for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$*"))
_letter = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_upper, _mark_or_digit = byte_set(bytes(range(65, 91))), byte_set(b"0123456789@$*")
_punct, _shout = byte_set(b".,;:!?'\"-()"), byte_set(b"!?")
_tables = 1 + len(PREFIXES)
FEATURES = 5 * _tables + 12


def _person_hashes() -> np.ndarray:
    blob = [w.encode() for w in SECOND_PERSON]
    at = np.append(0, np.cumsum([len(b) for b in blob]))
    return np.sort(slice_hash(np.frombuffer(b"".join(blob), np.uint8), at[:-1], at[1:]))


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    if not table.size:
        return np.full(keys.size, -1)
    at = np.minimum(np.searchsorted(table, keys), table.size - 1)
    return np.where(table[at] == keys, at, -1)


def word_keys(texts: Texts):
    """Starts, ends and first words of each row; hashes of the folded words, and of their beginnings (each kind its own)."""
    starts, ends, first = words(texts, _split)
    folded = _fold[texts.data]
    keys = [slice_hash(folded, starts, ends)]
    for k, n in enumerate(PREFIXES):
        long_ = ends - starts > n
        part = slice_hash(folded, starts, np.minimum(starts + n, ends)) + np.uint64(k + 1)
        keys.append(np.where(long_, part, np.uint64(0)))
    return starts, ends, first, keys


def features(texts: Texts, lexicon: list[tuple[np.ndarray, np.ndarray]], persons: np.ndarray) -> np.ndarray:
    out = np.zeros((texts.n, FEATURES))
    if not texts.data.size:
        return out
    data = texts.data
    starts, ends, first, keys = word_keys(texts)
    count = np.diff(first)
    row = np.repeat(np.arange(texts.n), count)
    share = np.maximum(count, 1)
    best = np.zeros(row.size)
    total = lambda weights: np.bincount(row, weights=weights, minlength=texts.n)
    for k, ((table, odds), key) in enumerate(zip(lexicon, keys)):
        at = _found(table, key)
        score = np.where(at >= 0, np.append(odds, 0)[at], 0)
        np.maximum(best, score, out=best)
        hits = total(score > 0)
        peak = np.zeros(texts.n)
        some = np.flatnonzero(score > 0)
        np.maximum.at(peak, row[some], score[some])
        out[:, 5 * k : 5 * k + 5] = np.stack([hits, hits / share, peak, total(score), total(score) / share], axis=1)
    a = 5 * _tables
    strong = best > 3
    out[:, a], out[:, a + 1] = total(strong), total(strong) / share
    second = _found(persons, keys[0]) >= 0
    out[:, a + 2] = total(second) / share
    near = np.flatnonzero(second)
    some = np.flatnonzero(best > 0)
    if near.size and some.size:  # the way to the second-person words on either side, within the row
        right = np.searchsorted(near, some)
        ways = []
        for side in (np.minimum(right, near.size - 1), np.maximum(right - 1, 0)):
            other = near[side]
            ways.append(np.where(row[other] == row[some], np.abs(other - some), 1 << 30))
        closeness = 1 / (1 + np.minimum(*ways))
        np.maximum.at(out[:, a + 3], row[some], np.where(closeness > 1e-8, closeness, 0))

    size = np.maximum(np.diff(texts.at), 1)

    def rate(kind: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind[data]))
        return np.diff(sums[texts.at])

    letters = np.maximum(rate(_letter), 1)
    out[:, a + 4] = rate(_upper) / letters
    out[:, a + 5], out[:, a + 6] = rate(_punct) / size, rate(_shout) / size
    sums = [np.append(0, np.cumsum(kind[data])) for kind in (_letter, _mark_or_digit, _upper)]
    in_word = [s[ends] - s[starts] for s in sums]
    out[:, a + 7] = total((in_word[0] > 0) & (in_word[1] > 0)) / share
    out[:, a + 8] = total((in_word[2] > 1) & (in_word[2] == in_word[0])) / share
    out[:, a + 9] = np.log1p(count)
    out[:, a + 10] = total(ends - starts) / share
    out[:, a + 11] = total((best > 0) & (in_word[1] > 0)) / share
    return out


class Trees:
    """Gradient boosting for log loss over binned features: trees of ``depth`` levels, each level split greedily by node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8, penalty: float = 2.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.depth, self.trees = depth, []
        binned = self._binned(x)
        n, width = binned.shape
        raw = np.full(n, self.base)
        offset = np.arange(width) * bins
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            slope, curve = p - y, p * (1 - p)
            node, tree = np.zeros(n, np.int64), []
            for level in range(depth):
                nodes = 1 << level
                cell = (node[:, None] * width * bins + offset + binned).ravel()
                sums = [np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (slope, curve, np.ones(n))]
                g, h, m = sums
                whole = [s[:, :, -1:] for s in sums]
                gain = g**2 / (h + penalty) + (whole[0] - g) ** 2 / (whole[1] - h + penalty) - whole[0] ** 2 / (whole[1] + penalty)
                gain[(m < least) | (whole[2] - m < least)] = 0
                pick = gain.reshape(nodes, -1).argmax(axis=1)
                column, cut = pick // bins, pick % bins
                cut[gain.reshape(nodes, -1).max(axis=1) <= 1e-9] = bins  # all stay on the left
                tree.append((column, cut))
                node = 2 * node + (binned[np.arange(n), column[node]] > cut[node])
            leaves = 1 << depth
            value = -rate * np.bincount(node, slope, leaves) / (np.bincount(node, curve, leaves) + penalty)
            self.trees.append((tree, value))
            raw += value[node]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        every = np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for column, cut in tree:
                node = 2 * node + (binned[every, column[node]] > cut[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit, by pooling neighbours that violate the order; each end is drawn half a case towards the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, number, least x, largest x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            top = pools.pop()
            pools[-1][0] += top[0]
            pools[-1][1] += top[1]
            pools[-1][3] = top[3]
    mean = y.mean()
    value = [(s + 0.5 * mean) / (n + 0.5) for s, n, _, _ in pools]
    return np.array([v for p in pools for v in p[2:]]), np.maximum.accumulate(np.repeat(value, 2))


class Model:
    def __init__(self, lexicon, trees, knots, prior):
        self.lexicon, self.trees, self.knots, self.prior, self.persons = lexicon, trees, knots, prior, _person_hashes()

    def score(self, texts: Texts) -> np.ndarray:
        if self.trees is None:
            return np.full(texts.n, self.prior)
        raw = self.trees.raw(features(texts, self.lexicon, self.persons))
        return np.clip(np.interp(raw, *self.knots), 0, 1) if self.knots else 1 / (1 + np.exp(-raw))


#: Parts of the sample.
FOLDS = 4


def learned_lexicons(rows: DataFrame, least: int = 3, ratio: float = 6.0) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Lexicons that leave out each part of the rows, and last that of all rows. A lexicon has, for whole words and each kind of beginning, sorted hashes and log odds. rows: doc_id, text, label, part."""
    n = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}

    def run(batches):
        for batch in batches:
            labels, parts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for texts in chunks(batch.column(1)):
                *_, first, keys = word_keys(texts)
                row = np.repeat(np.arange(texts.n), np.diff(first)).astype(np.uint64)
                for k, key in enumerate(keys):
                    pairs = np.unique(np.stack([key, row], axis=1)[key != 0], axis=0)  # a text counts once
                    where = texts.first + pairs[:, 1].astype(np.int64)
                    cell = (labels[where] == 1) * FOLDS + parts[where]
                    both, counts = np.unique(np.stack([pairs[:, 0], cell.astype(np.uint64)], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), k, np.int32)), pa.array(np.ascontiguousarray(both[:, 0]).view(np.int64)), pa.array(both[:, 1].astype(np.int32)), pa.array(counts.astype(np.int64))], names=["kind", "key", "cell", "n"])

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counted = rows.select("doc_id", "text", "label", "part").mapInArrow(run, "kind int, key long, cell int, n long").groupBy("kind", "key").agg(*cells)

    def odds(without: int):
        kept = [f for f in range(FOLDS) if f != without]
        totals = [sum(n.get((f, label), 0) for f in kept) for label in (1, 0)]
        one, zero = (sum((F.col(f"c{base + f}") for f in kept), F.lit(0)) for base in (FOLDS, 0))
        value = F.log((one + 0.5) / (totals[0] + 1.0)) - F.log((zero + 0.5) / (totals[1] + 1.0))
        return F.when((one >= least) & (value > float(np.log(ratio))), value)

    told = counted.select("kind", "key", *[odds(f).alias(f"o{f}") for f in range(FOLDS + 1)])
    best = told.where(F.coalesce(*[f"o{f}" for f in range(FOLDS + 1)]).isNotNull()).collect()
    out = []
    for f in range(FOLDS + 1):
        tables = []
        for k in range(_tables):
            own = sorted((np.int64(r["key"]).view(np.uint64), r[f"o{f}"]) for r in best if r["kind"] == k and r[f"o{f}"] is not None)
            tables.append((np.array([a for a, _ in own], np.uint64), np.array([b for _, b in own], float)))
        out.append(tables)
    return out


def fitted(docs: DataFrame, labels: DataFrame, held_part: int = 1, parts: int = 3, sample: int = 8192) -> Model:
    """Learns from the labelled rows whose fold isn't ``held_part``."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(FOLDS)).cast("int")
    rows = stored(labelled(docs, labels, "toxic", lambda i: fold(i, parts) != held_part, sample).withColumn("part", part), "toxicity-sample")
    lexicons, persons = learned_lexicons(rows), _person_hashes()

    def run(batches):
        for batch in batches:
            part = batch.column(3).to_numpy()
            for texts in chunks(batch.column(1)):
                own = batch.slice(texts.first, texts.n)
                x, mine = np.zeros((texts.n, FEATURES)), part[texts.first : texts.first + texts.n]
                for f in np.unique(mine).tolist():
                    x[mine == f] = features(texts, lexicons[f], persons)[mine == f]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "part", "x"])

    got = rows.select("doc_id", "text", "label", "part").mapInArrow(run, "doc_id long, label int, part int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), FEATURES)
    y, part = np.array([r["label"] for r in got], float), np.array([r["part"] for r in got])
    if not y.size or y.min() == y.max():
        return Model(lexicons[FOLDS], None, None, float(y.mean()) if y.size else 0.5)
    raw = np.zeros(y.size)
    for f in range(FOLDS):
        own = part == f
        raw[own] = Trees(x[~own], y[~own]).raw(x[own]) if 0 < own.sum() < y.size else 0
    return Model(lexicons[FOLDS], Trees(x, y), isotonic(raw, y), float(y.mean()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_part: int = 1, parts: int = 3, threshold: float = 0.7, sample: int = 8192) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, held_part, parts, sample))

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), pa.array(model.value.score(texts))], names=["doc_id", "score"])

    scored = docs_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held_part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
