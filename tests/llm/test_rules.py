import random
import re
import zlib

from weftcast.llm import decontam, licenses, sharding

from .conftest import ODD


def test_shards(spark, docs):
    rnd = random.Random(2)
    rows = ODD + [(k, rnd.choice(["same text", "", None, "w " * rnd.randint(1, 200)])) for k in range(100, 900)]
    got = [r.asDict() for r in sharding.shard_assignment(docs(rows), 16).collect()]
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    for shard in range(16):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert sharding.shard_assignment(docs([])).count() == 0


def test_a_map_is_edited():
    rnd = random.Random(5)
    sizes = {(k, -1): rnd.randint(50, 150) for k in range(2000)}
    one = sharding.balanced(sizes, 16)
    assert sharding.rebalanced(one, sizes, 16).placed == one.placed
    two = sharding.rebalanced(one, sizes, 17)
    loads = [sum(sizes[u] for u, s in two.placed.items() if s == k) for k in range(17)]
    assert two.version == 2 and max(loads) < 1.05 * min(loads)
    moved = sum(two.placed[u] != one.placed[u] for u in sizes)
    assert moved < 2000 / 17 * 1.5
    skewed = {k: v * (5 if s == 3 else 1) for (k, v), s in zip(sizes.items(), one.placed.values())}
    three = sharding.rebalanced(two, skewed, 16)
    assert set(three.placed) == set(sizes) and set(three.placed.values()) <= set(range(16))


def test_heavy_texts_leave_their_slot(spark, docs):
    heavy = "the same words over and over " * 8
    rows = [(k, heavy) for k in range(400)] + [(1000 + k, f"{k % 150} words of a small group") for k in range(600)]
    got = [r.asDict() for r in sharding.shard_assignment(docs(rows), 16).collect()]
    text = dict(rows)
    shards = {}
    for r in got:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(shards.pop(heavy)) > 8
    assert all(len(s) == 1 for s in shards.values())  # no other group is torn, whatever slot it shares
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(loads) < 1.1 * sum(loads) / 16


def test_groups_in_the_slot_of_a_heavy_text_stay_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLOTS", 1)
    rows = [(k, "x" * 500) for k in range(200)] + [(1000 + k, f"group {k % 40}") for k in range(400)]
    got = sharding.shard_assignment(docs(rows), 4).collect()
    text, shards = dict(rows), {}
    for r in got:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(shards.pop("x" * 500)) == 4
    assert all(len(s) == 1 for s in shards.values())


def test_maps_are_stored_and_edited(spark, docs, tmp_path):
    rnd, maps = random.Random(8), str(tmp_path / "maps")
    rows = [(k, f"{k} " * rnd.randint(20, 40)) for k in range(3000)]
    place = lambda rows, n: {r["doc_id"]: (r["shard"], r["map_version"], r["moves"]) for r in sharding.shard_assignment(docs(rows), n, maps).collect()}
    one = place(rows, 8)
    assert {v for _, v, _ in one.values()} == {1}
    assert place(rows, 8) == one  # the map that is there is read, not made anew
    nine = place(rows, 9)
    assert {v for _, v, _ in nine.values()} == {2} and sharding.latest_map(spark, maps).shards == 9
    moved = {i for i in one if one[i][0] != nine[i][0]}
    assert moved == {i for i, (_, _, moves) in one.items() if moves}
    assert sum(nine[i][0] == 8 for i in moved) > 0.8 * len(moved) and len(moved) < len(rows) / 9 * 1.3
    with_more = place(rows + [(5000 + k, f"new {k}") for k in range(50)], 9)
    assert all(with_more[i][0] == nine[i][0] for i in nine)


def brute_license(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base, labels = [], set(), set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        if at:
            base.add(label)
    line = " " + "".join(w + " " for w in words)
    accepted = {(label, score) for score, kind in ((1.0, licenses.LICENSES), (0.95, licenses.NOTICES)) for label, t in kind if re.search(f"(?<= ){licenses.template_regex(t)}", line)}
    labels = base | {label for label, _ in accepted}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((s for _, s in accepted), default=0.9 if base else 0.0)


def test_license_scan(spark, docs):
    rnd = random.Random(3)
    bits = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License", "under the mit license", "licensed under the GNU General Public License, version 3.", "licensed under the", "Apache License, Version 2.0", "distributed under the terms of the apache license version 2", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "and associated documentation files", "of x y and associated documentation files", "é", "cc by 4 0", "licensed under a creative commons attribution-sharealike international 4.0", "mpl", "Redistribution and use"]
    rows = ODD + [(k, rnd.choice([" ", "\n", ", "]).join(rnd.choice(bits) for _ in range(rnd.randint(1, 5)))) for k in range(20, 400)]
    got = sorted((tuple(r) for r in licenses.license_scan(docs(rows)).collect()), key=str)
    assert got == sorted(((i, *brute_license(t)) for i, t in rows), key=str)
    assert licenses.license_scan(docs([])).count() == 0


MIT = """Copyright (c) 2020 A. Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""


def test_whole_licences(spark, docs):
    def spelled(template):
        """A text that the template accepts: replaceable regions filled, optional ones kept, the first of alternatives."""
        t = re.sub(r"<(\d+)-(\d+)>", lambda m: " ".join(f"Name{k}" for k in range(int(m[1]))), template)
        return re.sub(r"[\[\]]", "", re.sub(r"\{([^|}]*)[^}]*\}", r"\1", t)).upper()

    rows = [(1, MIT), (2, MIT.replace("free of charge", "for a charge")), (3, MIT.replace("CONNECTION WITH", "connection to")), (4, "words before " + MIT + " words behind")]
    rows += [(100 + k, "Noise. " + spelled(t) + ", noise") for k, (_, t) in enumerate(licenses.LICENSES)]
    rows += [(200 + k, spelled(t).rsplit(" ", 3)[0]) for k, (_, t) in enumerate(licenses.LICENSES)]  # the end is missing
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs(rows)).collect()}
    assert got[1] == got[4] == ("mit", 1.0)
    assert got[2] == ("", 0.0) and got[3] == ("mit", 0.95)
    for k, (label, _) in enumerate(licenses.LICENSES):
        assert label in got[100 + k][0].split(",") and got[100 + k][1] == 1.0
        assert got[200 + k][1] < 1.0
    assert {i: v for i, v in got.items()} == {i: brute_license(t)[5:] for i, t in rows}


ITEMS = [(1, "If Alice buys 12 apples for 3 dollars and sells 12 pears, how many apples does Alice still have then"), (2, "plain words without any slot at all that go on for quite a while until the end"), (3, "too short"), (4, None), (5, "alpha beta gamma delta epsilon zeta"), (None, "north wind and sun were arguing over which one was the stronger of them")]


def leaked(spark, docs, rows, **how):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.leaks(docs(rows), items, **how).collect()}


def test_leaks(spark, docs):
    rows = [
        (1, "Noise before. If Alice buys 12 apples for 3 dollars and sells 12 pears, how many apples does Alice still have then, noise."),
        (2, "x. If Robert buys 57 apples for 8 euros and sells 57 pears, how many apples does Robert still have then?"),
        (3, "x. If Robert buys 57 apples for 8 euros and sells 99 pears, how many apples does Susan still have then?"),
        (4, "PLAIN words, without any slot at all; that go on for quite a while until THE end"),
        (5, "plain words without any slot at all"),
        (6, "clean text of other words that is long enough to be looked at by every window there is"),
        (9, "the north wind and sun were arguing over which one was the stronger of them all"),
        (7, "noise Alpha beta gamma delta epsilon zeta"),
        (8, "if alice buys 12 apples for 3 dollars and sells 12 pears how many apples does alice still have then"),
        *[(None if i is None else i + 100, t) for i, t in ODD],
    ]
    want = {(1, 1): True, (2, 1): False, (3, 1): False, (8, 1): True,  # words 4 to 19 of row 3 are consistent
            (4, 2): True, (7, 5): True, (9, None): True}
    assert leaked(spark, docs, rows) == want
    assert leaked(spark, docs, rows, limit=20) == want
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs(rows)
    assert {r["doc_id"] for r in table.collect()} - {r["doc_id"] for r in decontam.clean(table, items).collect()} == {1, 2, 3, 4, 7, 8, 9}
    assert sorted(map(str, decontam.clean(table, items, limit=20).collect())) == sorted(map(str, decontam.clean(table, items).collect()))
    assert decontam.clean(table, items).columns == table.columns
    assert decontam.leaks(docs([]), items).count() == 0
    assert decontam.leaks(table, items.where("item_id = 4")).count() == 0


def test_leaks_of_items_mostly_of_placeholders(spark, docs):
    texts = [
        "COMPUTE THE SUM OF ALL ODD PRIME NUMBERS BELOW SOME GIVEN BOUND",
        "Compute the sum 3 5 7 11 13 17 19 23 29 31 37 41",
        "Paris London Berlin Madrid Rome Vienna Oslo Prague Warsaw Dublin Lisbon Athens Sofia Riga",
        "what do these few plain words give 3 5 7 11 13 17 19 23 29 31",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    other = ["noise " + texts[3].replace(" 3 5 7 11 13", " 4 6 8 12 14"), "noise 103 105 107 111 113 117 119 123 129 131 137 141", "noise Turin Lyon Bonn Malaga Pisa Graz Bergen Brno Lodz Cork Porto Patras Varna Ventspils"]
    rows = [*((k, "Noise, " + t + " noise") for k, t in enumerate(texts)), *((10 + k, t.lower()) for k, t in enumerate(texts)), *((20 + k, t) for k, t in enumerate(other))]
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["verbatim"]) for r in decontam.leaks(docs(rows), items).collect()}
    sizes = [len(t.split()) for t in texts]
    assert got == {(k + at, k): (n, True) for k, n in enumerate(sizes) for at in (0, 10)} | {(20, 3): (sizes[3], False)}


def test_leaks_of_short_items_and_of_values_that_coincide(spark, docs):
    texts = ["What is the capital of France", "A farmer has 3 cows and 5 goats and sells them all for some money there", "Alice has 5 apples and eats 2 of them"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [
        (1, "Tell me what is the capital of a company in law"),
        (2, "So what is the capital of france then"),
        (3, "x. A farmer has 4 cows and 4 goats and sells them all for some money there, x"),
        (4, "x. Robert has 7 apples and eats 3 of them, x"),
        (5, "x. she has 7 apples and eats 3 of them, x"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["verbatim"]) for r in decontam.leaks(docs(rows), items).collect()}
    assert got == {(2, 0): (6, True), (3, 1): (16, False), (4, 2): (9, False)}
