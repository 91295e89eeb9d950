import collections
import hashlib
import os
import random

from weftcast.llm import exact, substring

from .conftest import ODD


def test_patricia_against_a_dict():
    rnd, trie, held = random.Random(1), exact.Patricia(), {}
    for _ in range(3000):
        key = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 8)))
        node = trie.terminal(key)
        node[2] = (node[2] or 0) + 1
        held[key] = held.get(key, 0) + 1
    assert all(trie.terminal(k)[2] == v for k, v in held.items())
    assert sorted(trie.emptied()) == sorted(held.values())
    assert not trie.held and not list(trie.emptied())


def test_common_prefix():
    for a, b in ((b"", b"a"), (b"abc", b"abc"), (b"abc", b"abd"), (b"xbc", b"abc"), (b"a" * 99 + b"b", b"a" * 120)):
        assert exact.common_prefix(a, b) == len(os.path.commonprefix([a, b]))


def test_tries_emptied_often(spark, docs):
    rows = [(k, "shared beginning " * 9 + str(k % 17)) for k in range(100)]
    for limit in (0, 300):
        got = exact.owners(docs(rows), "smallest", limit).collect()
        assert sorted((r["keep_id"], r["group_size"]) for r in got) == [(k, 6 if k < 15 else 5) for k in range(17)]


def brute_groups(rows, keep):
    lower = lambda t: (t or "").encode().lower()
    by = collections.defaultdict(list)
    for i, t in rows:
        by[lower(t)].append(i)
    out = []
    for i, t in rows:
        members = by[lower(t)]
        named = [m for m in members if m is not None]
        owner = keep(named) if named else None
        out.append((i, owner, len(members), i == owner, hashlib.sha256(lower(t)).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, docs):
    rnd = random.Random(4)
    rows = ODD + [(k, rnd.choice(["É x", "é x", "same", "SAME", "other " * 50, str(k)])) for k in range(20, 120)]
    for name, keep in (("largest", max), ("smallest", min)):
        assert sorted(map(tuple, exact.exact_groups(docs(rows), name).collect()), key=str) == brute_groups(rows, keep)
    table = docs(rows)
    left = exact.deduplicated(table, "largest")
    assert left.columns == table.columns
    assert left.count() == sum(r[3] for r in brute_groups(rows, max))
    assert exact.exact_groups(docs([])).count() == 0


def brute_removal(rows, n):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + n]) for w in texts for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("xyzé")
    shared = [[word() for _ in range(rnd.randint(5, 30))] for _ in range(6)]
    rows = []
    for k in range(80):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text += rnd.choice(shared) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, 30))]
        rows.append((k, rnd.choice([" ", "\n", "  ", " "]).join(text)))
    return rows + [(200, "loop " * 60), (201, "a b " * 30), (202, rows[3][1]), (202, rows[3][1])]


def test_removal(spark, docs, monkeypatch):
    for block, limit in ((3, 200), (5, 4 << 20)):
        monkeypatch.setattr(substring, "CHUNK", limit)
        rows = ODD + passages(block)
        assert sorted(map(tuple, substring.removal_digests(docs(rows), block).collect()), key=str) == brute_removal(rows, 2 * block - 1)
    assert substring.removal_digests(docs([])).count() == 0
    texts = {r["doc_id"]: r["kept"] for r in substring.without_repeats(docs([(1, "q " + "a b c d e f " * 2), (2, "z a b c d e f")]), 3).collect()}
    assert texts == {1: "q", 2: "z"}
