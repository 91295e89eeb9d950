import random
import zlib

import numpy as np
import pytest

from weftcast.llm import quality, toxicity

from .conftest import ODD


def corpus(seed, n=700):
    """Documents, and labels that follow from repetition and symbols (quality) and from insults (toxic)."""
    rnd = random.Random(seed)
    syllables = "an be con der ein for ge hin im jo kla lu mon ner".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        w, good, toxic = [word() for _ in range(rnd.randint(20, 120))], rnd.random() < 0.8, rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["you idiot", "sToopid", "zounder" + word(), "zounder" + word()]))
        if not good:
            w = [x + rnd.choice(["***", "$$$", "&&&"]) for x in w] if rnd.random() < 0.5 else [w[j // 6] for j in range(len(w))]
        rows.append((k, " ".join(w).capitalize() + "."))
        if rnd.random() < 0.8:
            labels.append((k, int(good), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("score", "column", "parts", "held"), [(quality.quality_scores, 1, 4, 2), (toxicity.toxicity_scores, 2, 3, 1)])
def test_held_out_accuracy(spark, docs, score, column, parts, held):
    rows, labels = corpus(column)
    table = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = score(docs(rows + [(None if i is None else i + 10_000, t) for i, t in ODD]), table).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in got)
    truth = {x[0]: x[column] for x in labels}
    held_rows = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held_rows]) > 0.93
    empty = [r["score"] for r in got if r["doc_id"] in (10_001, 10_002, 10_003)]
    assert len(set(empty)) == 1
    again = {r["doc_id"]: r["score"] for r in score(docs(rows), table).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got if r["doc_id"] in again and r["doc_id"] < 10_000)


def test_held_out_labels_teach_nothing(spark, docs):
    rows, labels = corpus(3, 200)
    fold = lambda i, parts: zlib.crc32(str(i).encode()) % parts
    for score, parts, held in ((quality.quality_scores, 4, 2), (toxicity.toxicity_scores, 3, 1)):
        flipped = [(i, 1 - q, 1 - t) if fold(i, parts) == held else (i, q, t) for i, q, t in labels]
        one, two = (sorted(map(tuple, score(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped))
        assert one == two


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_without_labels(spark, docs, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(docs(ODD), none).collect()} == {0.5}
    assert score(docs([]), none).count() == 0
    alike = spark.createDataFrame([(k, 1, 1) for k in range(9)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(docs(ODD), alike).collect()} <= {1.0, 0.5}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all()
    assert abs(np.interp(x, at, value).mean() - y.mean()) < 0.02


def test_trees_learn_a_corner():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    model = toxicity.Trees(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == (y[1500:] == 1)).mean() > 0.98


def test_best_cut_parts_votes():
    votes, labels = np.array([0.1, 0.2, 0.6, 0.3, 0.9]), np.array([0, 0, 1, 0, 1])
    assert quality.best_cut(votes, labels) == pytest.approx(0.45)
