import itertools
import random

import numpy as np

from weftcast.llm import components, ngram_join

from .conftest import ODD


def brute(rows, n, threshold):
    def shingles(text):
        w = (text or "").encode().split()
        return frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            up[max(root(a), root(b))] = min(root(a), root(b))
    out = []
    for k, (i, _) in enumerate(rows):
        same = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, min(same) if same else None, links[k]))
    return sorted(out, key=str)


def variants(seed):
    rnd = random.Random(seed)
    rows, k = [], 100
    for size in (1, 2, 3, 40, 90):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(60, 200))]
        for _ in range(size):
            w = base.copy()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    rnd.shuffle(rows)
    return rows + rows[:5] + [(k, rows[0][1]), (k + 1, rows[1][1].replace(" ", "\n"))]


def test_links_and_classes(spark, docs):
    rows = ODD + variants(1)
    for block, most in ((256, 512), (16, 8)):  # one block a cluster; many, and bands too large to prune
        got = sorted(map(tuple, ngram_join.near_duplicates(docs(rows), block=block, most=most).collect()), key=str)
        assert got == brute(rows, 5, 0.8)
    table = docs(rows)
    left = ngram_join.one_of_each(table)
    assert left.columns == table.columns
    assert sorted({r["doc_id"] for r in left.collect()}, key=str) == sorted({c for _, c, _ in brute(rows, 5, 0.8)}, key=str)
    assert left.where("text is null").count() == 2  # neither shares a shingle with anything
    assert ngram_join.near_duplicates(docs([])).count() == 0


def test_pruning_bounds():
    needed = ngram_join.least_matches(0.8, 1e-6, 64)
    rng = np.random.default_rng(1)
    matches = (rng.random((100_000, 64)) < 0.8).cumsum(axis=1)
    assert sum((matches[:, n - 1] < m).mean() for n, m in needed.items()) < 1e-4
    assert (((rng.random((10_000, 64)) < 0.4).cumsum(axis=1)[:, 63]) < needed[64]).mean() > 0.95


def test_min_hash_estimates_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one, two = np.unique(a[:2000]), np.unique(a[400:])
    true = np.intersect1d(one, two).size / np.union1d(one, two).size
    assert abs((ngram_join.min_hashes(one, 0, 500) == ngram_join.min_hashes(two, 0, 500)).mean() - true) < 0.08


def test_overlap_products_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 200)).astype(np.uint64) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert ngram_join.overlaps(sets, sets, i, j).tolist() == [np.intersect1d(sets[a], sets[b]).size for a, b in zip(i, j)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 9), (9, 7), (3, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, 7: 5, 9: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
