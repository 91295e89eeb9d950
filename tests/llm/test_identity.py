"""Words that were made to meet, ids that are null or shared, and re-parameterised questions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcast.llm import decontam, licenses, ngram_join, quality, scan, substring, tokenbin

from .test_dedup import brute_removal
from .test_ngram_join import brute

#: Two words that the unkeyed hash doesn't tell apart.
PAIR = ("pLIix6MEOLeMa61E", "07xxbc8gzGy43yhx")


def ends(words):
    blob = [w if isinstance(w, bytes) else w.encode() for w in words]
    at = np.append(0, np.cumsum([len(b) for b in blob]))
    return np.frombuffer(b"".join(blob), np.uint8), at[:-1], at[1:]


def made_pairs(n: int, seed: int) -> list[tuple[bytes, bytes]]:
    """Words of 16 bytes that meet in the unkeyed hash: the second block cancels the difference of the first."""
    rng, factor = np.random.default_rng(seed), int(scan.BYTE_FACTOR)
    out = []
    while len(out) < n:
        first = rng.integers(33, 127, (2, 8), np.uint8)
        second = int.from_bytes(rng.integers(33, 127, 8, np.uint8).tobytes(), "little")
        at = [int(scan.slice_hash(*ends([bytes(w)]))[0]) for w in first]
        start = int(scan.mixed(np.array([16], np.uint64) * scan.BYTE_FACTOR + scan.U64(1))[0])
        after = [int(scan.mixed(np.array([start ^ int.from_bytes(bytes(w), "little")], np.uint64))[0]) for w in first]
        other = (second + factor * (after[0] - after[1])) % 2**64
        tail = other.to_bytes(8, "little")
        if at and not set(tail) & set(b" \t\n\v\f\r"):
            out.append((bytes(first[0]) + second.to_bytes(8, "little"), bytes(first[1]) + tail))
    return out


def test_made_words_meet_in_the_plain_hash_alone():
    for one, two in [tuple(w.encode() for w in PAIR), *made_pairs(20, 1)]:
        a, b = scan.slice_hash(*ends([one, two]))
        assert a == b and one != two
        for seed in range(5):
            a, b = scan.keyed_hash(*ends([one, two]), scan.Keys(bytes([seed])))
            assert a != b


def test_keyed_hashes_depend_on_bytes_and_keys_alone():
    rnd, keys = random.Random(1), scan.Keys(b"k")
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 3, 4, 5, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(3000)]
    data, starts, stops = ends(words)
    one = scan.keyed_hash(data, starts, stops, keys)
    padded = np.concatenate([np.frombuffer(b"zzz", np.uint8), data, np.frombuffer(b"yy", np.uint8)])
    assert (scan.keyed_hash(padded, starts + 3, stops + 3, scan.Keys(b"k")) == one).all()
    assert len(set(one.tolist())) == len(set(words)) and len(dict(zip(words, one.tolist()))) == len(set(words))
    assert not (scan.keyed_hash(data, starts, stops, scan.Keys(b"l")) == one).any()
    assert scan.keyed_hash(*ends([]), keys).size == 0
    # The rule, plainly.
    word = b"hello, world!!"
    by, add = keys.by.tolist(), keys.add.tolist()
    parts = [int.from_bytes(word.ljust(16, b"\0")[k : k + 4], "little") for k in range(0, 16, 4)]
    sums = [(a + b[0] * len(word) + sum(x * y for x, y in zip(b[1:], parts))) % 2**64 for a, b in zip(add, by)]
    want = scan.mixed(np.array([sums[0] >> 32 << 32 | sums[1] >> 32], np.uint64))
    assert scan.keyed_hash(*ends([word]), keys) == want


def test_made_words_in_operators(spark, docs):
    rows, same = [], " ".join(f"w{k}" for k in range(34))
    pairs = [PAIR, *[(a.decode("latin-1"), b.decode("latin-1")) for a, b in made_pairs(200, 2) if max(a + b) < 128]]
    for k, (one, two) in enumerate(pairs[:3]):
        rows += [(10 * k, f"{one} {same}x{k}"), (10 * k + 1, f"{two} {same}x{k}"), (10 * k + 2, " ".join([one] * 5)), (10 * k + 3, " ".join([two] * 5))]
    assert sorted(map(tuple, substring.removal_digests(docs(rows), 18).collect()), key=str) == brute_removal(rows, 35)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs(rows)).collect()), key=str) == brute(rows, 5, 0.8)
    items = spark.createDataFrame([(k, f"{same}x{k} {one}") for k, (one, _) in enumerate(pairs[:1])], "item_id long, text string")
    short = spark.createDataFrame([(7, " ".join([PAIR[0]] * 5))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs(rows), short).collect()} == {2}
    assert items.count() == 1
    got = licenses.license_scan(docs([(1, f"{PAIR[1]} y"), (2, f"{PAIR[0]} y")]), base=((f"{PAIR[0].lower()} y", "made"),)).collect()
    assert {r["doc_id"]: r["n_base"] for r in got} == {1: 0, 2: 1}


def test_rows_without_an_id_cost_what_others_do(spark, docs):
    rnd = random.Random(3)
    texts = []
    for _ in range(600):
        base = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    took, got = {}, {}
    for what, ids in (("ids", range(1200)), ("null", [None] * 1200), ("one", [5] * 1200)):
        table = docs(list(zip(ids, texts)))
        plan = ngram_join.near_duplicates(table)
        began = time.time()
        got[what] = sorted(r["n_links"] for r in plan.collect())
        took[what] = time.time() - began
        joined = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in joined and "Cartesian" not in joined
    assert got["ids"] == got["null"] == got["one"] == [1] * 1200
    assert max(took.values()) < 4 * took["ids"] + 10


def test_rows_of_one_id_are_dealt_over_files(spark, docs):
    rnd = random.Random(4)
    table = docs([(None, f"{rnd.random()} some text") for _ in range(4000)])
    import public_tokenizers

    segments = tokenbin.write_token_files(table, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, files=4)
    assert segments.select("file").distinct().count() > 1
    back = tokenbin.token_digests(segments).orderBy("start").collect()
    assert len(back) == 4000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:]))


def test_samples_are_bounded_under_repeated_ids(spark, docs):
    table = docs([(k % 3, f"text {k} of many") for k in range(500)] + [(1, "same")] * 200)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(3)] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.labelled(table, labels, "quality", lambda i: F.lit(True), 40).collect()
    assert len(got) == 40 and len(set(got)) == 40
    assert len(quality.labelled(table, labels, "quality", lambda i: F.lit(True), 10_000).collect()) == 501


POOL = [a + b for a in ("ba", "ke", "lo", "mu", "ni") for b in ("rak", "sel", "tiv", "pom")]


def longest_consistent(text: list[str], item: list[str]) -> int:
    """The longest run on any diagonal that agrees, number for number, with one value for each of the item's."""
    best = 0
    for shift in range(-len(item) + 1, len(text)):
        for a in range(max(0, shift), min(len(text), shift + len(item))):
            there, n = {}, 0
            for p in range(a, min(len(text), shift + len(item))):
                mine, its = text[p], item[p - shift]
                if mine != its and not (mine.isdigit() and its.isdigit()) or its.isdigit() and there.setdefault(its, mine) != mine:
                    break
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_with_random_slots_against_brute_force(spark, docs, seed):
    rnd = random.Random(seed)

    def sentence(n):
        return [str(rnd.randint(1, 4)) if k % 3 == 2 and rnd.random() < 0.7 else rnd.choice(POOL) for k in range(n)]

    items = [sentence(rnd.choice([6, 9, 13, 16, 20, 30])) for _ in range(10)]
    rows = []
    for k in range(160):
        item = rnd.choice(items)
        a = rnd.randrange(len(item))
        values = {w: str(rnd.randint(5, 9)) for w in item}
        part = [(values[w] if rnd.random() < 0.85 else str(rnd.randint(5, 9))) if w.isdigit() else w for w in item[a:] if rnd.random() < 0.99]
        rows.append((k, " ".join([*(rnd.choice(POOL) for _ in range(rnd.randint(0, 9))), *part, *(rnd.choice(POOL) for _ in range(rnd.randint(0, 9)))])))
    want = {(i, k) for i, t in rows for k, w in enumerate(items) if longest_consistent(t.split(), w) >= min(13, len(w))}
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs(rows), table).collect()}
    assert set(got) == want and len(want) > 20
    texts = dict(rows)
    assert all(r["n_words"] == longest_consistent(texts[i].split(), items[k]) for (i, k), r in got.items())


def test_recall_of_re_parameterised_copies(spark, docs):
    """Other numbers, names and units throughout, one value for each: at least nine in ten are found, and clean texts aren't."""
    rnd = random.Random(9)
    names, units = ["Alice", "Robert", "Susan", "Victor", "Maria", "Ahmed", "Chen"], ["miles", "hours", "dollars", "grams", "litres"]

    def question(shape, values):
        return " ".join(values[w] if w in values else w for w in shape) + "?"

    shapes = [["If", *(rnd.choice([*POOL] * 3 + [f"N{rnd.randint(0, 1)}", f"#{rnd.randint(0, 2)}", "U0"]) for _ in range(rnd.randint(13, 30)))] for _ in range(200)]

    def drawn():
        who, n = rnd.sample(names, 2), rnd.sample(range(10, 99), 3)
        return {"N0": who[0], "N1": who[1], "#0": str(n[0]), "#1": str(n[1]), "#2": str(n[2]), "U0": rnd.choice(units)}

    items = spark.createDataFrame([(k, question(s, drawn())) for k, s in enumerate(shapes)], "item_id long, text string")
    rows = [(k, f"Some words before. {question(s, drawn())} And behind.") for k, s in enumerate(shapes)]
    rows += [(1000 + k, " ".join(rnd.choice(POOL) for _ in range(60))) for k in range(200)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), items).collect()}
    found = {i for i, k in got if i == k}
    assert len(found) >= 0.95 * len(shapes) and not any(i >= 1000 for i, _ in got)


def test_short_items(spark, docs):
    """Of five words and more anywhere; of three and four as a whole sentence or line; shorter ones never."""
    rnd = random.Random(11)
    items = [" ".join(rnd.sample(POOL, n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12) for _ in range(5)]
    rows = [(k, f"Noise before. {t}? Noise behind.") for k, t in enumerate(items)] + [(100 + k, f"noise {t} noise") for k, t in enumerate(items)] + [(200 + k, f"first line\n{t}\nlast line") for k, t in enumerate(items)] + [(300 + k, t) for k, t in enumerate(items)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(rows), table).collect()}
    want = {(at + k, k) for k, t in enumerate(items) for at in (0, 100, 200, 300) if len(t.split()) >= (5 if at == 100 else 3)}
    assert got == want
    who = spark.createDataFrame([(1, "Who wrote the Odyssey")], "item_id long, text string")
    assert decontam.leaks(docs([(1, "Quiz: Who wrote the Odyssey? Homer."), (2, "we asked who wrote the odyssey again and again")]), who).select("doc_id").collect() == [(1,)]


def test_items_of_one_template_are_one_row_a_document(spark, docs):
    shape = "a farmer has {} cows and {} goats and sells them all for some money at the fair of {}"
    items = spark.createDataFrame([(k, shape.format(k % 50, k % 50 + 100, "rakston")) for k in range(400)] + [(400, shape.format(7, 7, "rakston"))], "item_id long, text string")
    got = decontam.leaks(docs([(1, "x. " + shape.format(33, 133, "rakston")), (2, "x. " + shape.format(901, 902, "rakston")), (3, "x. " + shape.format(5, 5, "rakston"))]), items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_words"], r["verbatim"], r["n_items"]) for r in got} == {(1, 33, 20, True, 401), (2, 0, 20, False, 401), (3, 5, 20, False, 401)}
