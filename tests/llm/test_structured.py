"""Texts made to defeat hashes, and very long ones, against libraries and brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from weftcast.llm import bpe, decontam, exact, licenses, ngram_join, pretoken, quality, scan, substring, toxicity

from .test_bpe import RANKS, reference
from .test_dedup import brute_groups, brute_removal
from .test_ngram_join import brute
from .test_rules import brute_license


def thue_morse(n, one="a", two="b"):
    """The word whose letters no polynomial hash modulo a power of two tells from those of its complement."""
    return [one if bin(k).count("1") % 2 else two for k in range(n)]


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_word_pairs(spark, docs, n):
    one, two = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
    hashes = scan.slice_hash(np.frombuffer((one + two).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]
    known, texts = reference(), [f"{one} {two}", two, f"x {one}", one]
    encoder, got = pretoken.PieceEncoder(bpe.ByteBpe(bpe.read_ranks(RANKS)).pieces), []
    for part in scan.chunks(pa.array(texts)):
        ids, counts = encoder.ids(part)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [known.encode_ordinary(t) for t in texts]


def test_windows_that_differ_in_one_word(spark, docs):
    rows = []
    for k, n in enumerate((64, 1024, 2048)):
        words = [f"w{k}x{j}" for j in range(34)]
        rows += [(2 * k, " ".join([*words, "".join(thue_morse(n))])), (2 * k + 1, " ".join([*words, "".join(thue_morse(n, "b", "a"))]))]
    rows += [(100, " ".join(thue_morse(256))), (101, " ".join(thue_morse(256, "b", "a"))), (102, rows[0][1])]
    assert sorted(map(tuple, substring.removal_digests(docs(rows), 18).collect()), key=str) == brute_removal(rows, 35)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs(rows)).collect()), key=str) == brute(rows, 5, 0.8)
    assert sorted(map(tuple, exact.exact_groups(docs(rows), "largest").collect()), key=str) == brute_groups(rows, max)


def test_slices_with_one_hash_stay_apart(monkeypatch):
    """Where hashes meet, bytes decide."""
    monkeypatch.setattr(pretoken, "slice_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(40))
    data = b"onetwoonefoursixone"
    starts, ends = np.array([0, 3, 6, 9, 13, 16]), np.array([3, 6, 9, 13, 16, 19])
    where, inverse = pretoken.distinct(np.frombuffer(data, np.uint8), starts, ends)
    pieces = [data[a:b] for a, b in zip(starts, ends)]
    assert [pieces[where[k]] for k in inverse] == pieces and len(where) == 4


def test_slice_hashes_depend_on_bytes_alone():
    rnd = random.Random(1)
    pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(2000)]
    flat, at = bpe.slices(pieces)
    one = scan.slice_hash(flat, at[:-1], at[1:])
    pad = np.concatenate([np.frombuffer(b"zzz", np.uint8), flat, np.frombuffer(b"yy", np.uint8)])
    assert (scan.slice_hash(pad, at[:-1] + 3, at[1:] + 3) == one).all()
    by_bytes = {}
    for p, h in zip(pieces, one.tolist()):
        assert by_bytes.setdefault(p, h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_very_long_texts(spark, docs):
    rnd = random.Random(2)
    words = [f"{rnd.choice('abc')}{rnd.randint(0, 9999)}" for _ in range(60_000)]
    long_ = " ".join(words)
    rows = [(1, long_), (2, long_.upper()), (3, long_ + " end"), (4, "x" * 300_000), (5, " ".join(words[100:200])), (6, None)]
    known = reference()
    encoded = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in bpe.encoding_digests(docs(rows[:1] + rows[4:]), RANKS).collect()}
    assert encoded == {i: (len(known.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows[:1] + rows[4:]}
    assert sorted(map(tuple, exact.exact_groups(docs(rows), "largest").collect()), key=str) == brute_groups(rows, max)
    assert sorted(map(tuple, substring.removal_digests(docs(rows), 18).collect()), key=str) == brute_removal(rows, 35)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs(rows)).collect()} == {1: (1, 1), 3: (1, 1), 2: (2, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    assert sorted(tuple(r) for r in licenses.license_scan(docs(rows)).collect()) == sorted((i, *brute_license(t)) for i, t in rows)
    items = spark.createDataFrame([(1, " ".join(words[30_000:30_020]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs(rows), items).collect()} == {1, 2, 3}


def test_votes_against_plain_neighbours():
    rng = np.random.default_rng(4)
    counts = rng.random((120, quality.TERMS), np.float32) * (rng.random((120, quality.TERMS)) < 0.2)
    labels = (counts[:, :40].sum(axis=1) > np.median(counts[:, :40].sum(axis=1))).astype(int)
    model = quality.Neighbours(counts[:100], labels[:100])
    share = counts[:100] ** 2 / np.maximum((counts[:100] ** 2).sum(axis=0), 1e-9)
    weight = 1.05 + np.where(share > 0, share * np.log(np.maximum(share, 1e-30)), 0).sum(axis=0) / np.log(100)
    weight[-quality.REPEATS :] = 3.0
    _, _, right = np.linalg.svd((counts[:100] - counts[:100].mean(axis=0)).astype(float) * weight, full_matrices=False)
    space = lambda x: ((x - counts[:100].mean(axis=0)) * weight) @ right[:48].T
    unit = lambda v: v / np.linalg.norm(v)
    known = [unit(v) for v in space(counts[:100])]
    for k in range(100, 120):
        mine = unit(space(counts[k : k + 1])[0])
        near = sorted(((float(mine @ v), y) for v, y in zip(known, labels)), reverse=True)[:15]
        votes = [np.exp(12 * (c - 1)) for c, _ in near]
        want = sum(w for w, (_, y) in zip(votes, near) if y) / sum(votes)
        assert model.votes(model.latent(counts[k : k + 1]))[0] == pytest.approx(want, abs=1e-3)


def plain_tree_boost(x, y, rounds, depth, rate, least, penalty, edges):
    """Boosted trees by recursion over every cut of every feature."""
    base = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    binned = [[sum(e < v for e in edges[c]) for c, v in enumerate(row)] for row in x]
    raw = np.full(len(y), base)

    def grow(rows, level):
        g, h = sum(slope[r] for r in rows), sum(curve[r] for r in rows)
        if level < depth:
            best = (1e-9, None, None)
            for c in range(x.shape[1]):
                for cut in range(len(edges[c]) + 1):
                    left = [r for r in rows if binned[r][c] <= cut]
                    if len(left) < least or len(rows) - len(left) < least:
                        continue
                    gl, hl = sum(slope[r] for r in left), sum(curve[r] for r in left)
                    gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, c, cut)
            if best[1] is not None:
                _, c, cut = best
                grow([r for r in rows if binned[r][c] <= cut], level + 1)
                grow([r for r in rows if binned[r][c] > cut], level + 1)
                return
            grow(rows, level + 1)
            return
        for r in rows:
            step[r] = -rate * g / (h + penalty)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        slope, curve, step = p - y, p * (1 - p), np.zeros(len(y))
        grow(list(range(len(y))), 0)
        raw = raw + step
    return raw


def test_trees_against_plain_recursion():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((90, 3)), 1)
    y = ((x[:, 0] > 0.4) ^ (rng.random(90) < 0.1)).astype(float)
    model = toxicity.Trees(x, y, rounds=4, depth=2, bins=8)
    assert model.raw(x) == pytest.approx(plain_tree_boost(x, y, 4, 2, 0.2, 8, 2.0, model.edges), abs=1e-9)


def test_leaks_against_longest_common_runs(spark, docs):
    rnd = random.Random(6)
    pool = [a + b for a in ("ba", "ke", "lo", "mu", "ni") for b in ("rak", "sel", "tiv", "pom")]
    items = [[rnd.choice(pool) for _ in range(rnd.choice([6, 9, 13, 20, 40]))] for _ in range(12)]
    rows = []
    for k in range(150):
        text = [rnd.choice(pool) for _ in range(rnd.randint(0, 15))]
        item = rnd.choice(items)
        a = rnd.randrange(len(item))
        text += item[a : a + rnd.randint(1, 30)] + [rnd.choice(pool) for _ in range(rnd.randint(0, 15))]
        rows.append((k, " ".join(text)))

    def leaks(text, item):
        best, runs = 0, [0] * (len(item) + 1)
        for w in text:
            runs = [0] + [runs[j] + 1 if w == item[j] else 0 for j in range(len(item))]
            best = max(best, *runs)
        return best >= min(13, len(item))

    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), table).collect()}
    assert got == {(i, k) for i, t in rows for k, w in enumerate(items) if leaks(t.split(), w)}


def test_clashing_column_names(spark):
    names = ["doc_id", "text", "__gone", "__text", "__digest", "row", "text_key", "digest", "keep_id", "d", "g", "a.b"]
    table = spark.createDataFrame([(k, t, *[f"{k}{n}" for n in names[2:]]) for k, t in ((1, "same words"), (2, "same words"), (3, "other"))], names)
    for left, ids in ((exact.deduplicated(table, "largest"), {2, 3}), (ngram_join.one_of_each(table), {1, 3})):
        assert left.columns == names
        assert sorted(map(tuple, left.collect())) == sorted(tuple(r) for r in table.collect() if r["doc_id"] in ids)
