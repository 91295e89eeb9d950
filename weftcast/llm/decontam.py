"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of punctuation; numbers, names and units become typed
placeholders. Names are placeholders in one view of a text and words in another, so that
a copy in other capitals is met too. Windows of ``width`` canonical words of the benchmark are hashed, and the
windows of every document joined with them by hash within the task. Windows that meet on
one diagonal of a document and an item, and the words beside them that agree, form a run; its slots have to be consistent, each
item value standing for one document value (two may stand for the same). A slot that conflicts with an earlier one
ends a run, and the next begins behind that earlier one, so every longest consistent run is seen. A run of at least
``least`` words (or the whole item, if that is shorter) is a leak, be it
verbatim or re-parameterised. The first word of such a short item may be a name: capitals
there agree with those of a document.

Items that differ in numbers and units alone are one entry as long as the same ones are equal to each other; a document
gives a row a template (items of the same words and placeholders), with the best item and the number of
items that it leaks, not a row an item. The benchmark is broadcast in blocks of at most ``limit`` words, each a pass
over the documents; it is one pass unless the benchmark is that large. Of several, each is written before the next is
made, so the driver holds one at a time. Documents are not shuffled.

Words are hashed with random keys drawn for the job, so no text can be written to make unlike words meet.

Null and empty texts leak nothing; very long ones are looked at whole. Items of three or four words leak where they are a
whole sentence or line of a text, word by word; those of fewer identify nothing and are
left out. Short items have windows of all their words but one, as the first may count as
a name in one place only. Windows mostly of placeholders
are looked up by their very words, so they meet verbatim copies only. Rows that repeat give equal rows; so do repeated items, and items
and rows with a null id are told of as null. A name is a
capitalised word that doesn't begin a sentence. Columns besides doc_id, item_id and text
aren't read.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, docs_of, stored
from .scan import Keys, Texts, byte_set, chunks, keyed_hash, whole, window_hash, window_starts, words

#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph".split()

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_upper, _digit = byte_set(bytes(range(65, 91))), byte_set(b"0123456789")
_punct = byte_set(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_stop = byte_set(b".!?:")
_number_mark = byte_set(b"0123456789.,%$/")
_newline = byte_set(b"\n\r")
WORD, NUMBER, UNIT, NAME = range(4)
#: Hashes of the placeholders; a word's hash is never one of them but by a chance of 2**-62.
_placeholder = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


class Lexicon:
    """Keys for the hashes of words, and those of number words and units."""

    def __init__(self, keys: Keys):
        self.keys = keys
        self.numbers, self.units = self._table(NUMBER_WORDS), self._table(UNITS)

    def _table(self, entries: list[str]) -> np.ndarray:
        blob = [w.encode() for w in entries]
        at = np.append(0, np.cumsum([len(b) for b in blob]))
        return np.sort(keyed_hash(np.frombuffer(b"".join(blob), np.uint8), at[:-1], at[1:], self.keys))


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), table.size - 1)] == keys


def canonical(texts: Texts, lexicon: Lexicon):
    """For each word: the canonical hash, the kind, the hash of the word itself; each row's first word; and for each word whether it has a capital, and whether it begins a sentence. Words of punctuation alone are dropped."""
    data, (starts, ends, first) = texts.data, words(texts)
    if not starts.size:
        none = np.empty(0, np.uint64)
        return none, np.empty(0, np.int8), none, np.zeros(texts.n + 1, np.int64), np.empty(0, bool), np.empty(0, bool)
    solid = np.append(0, np.cumsum(~_punct[data]))
    n_solid = solid[ends] - solid[starts]
    places = np.flatnonzero(~_punct[data])
    keep = n_solid > 0
    row = np.repeat(np.arange(texts.n), np.diff(first))
    # A sentence begins at a row, after a line break, and after a word that ends with a stop.
    breaks = np.append(0, np.cumsum(_newline[data]))
    opens = np.ones(starts.size, bool)
    opens[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]]) | _stop[data[ends[:-1] - 1]]
    starts, ends, row, opens = starts[keep], ends[keep], row[keep], opens[keep]
    core_start = places[solid[starts]]
    core_end = places[solid[ends] - 1] + 1
    own = keyed_hash(_lower[data], core_start, core_end, lexicon.keys)
    sums = [np.append(0, np.cumsum(t[data])) for t in (_digit, _number_mark)]
    digits, marks = (s[core_end] - s[core_start] for s in sums)
    kind = np.zeros(starts.size, np.int8)
    capital = _upper[data[core_start]]
    kind[capital & ~opens] = NAME
    kind[_in(lexicon.units, own)] = UNIT
    kind[((digits > 0) & (marks == core_end - core_start)) | _in(lexicon.numbers, own)] = NUMBER
    return np.where(kind > 0, _placeholder[kind], own), kind, own, np.searchsorted(row, np.arange(texts.n + 1)), capital, opens


def _viewed(view: int, hashes: np.ndarray, kind: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Canonical hashes, in view 1 with names as words; in view 2 the words themselves."""
    return own if view == 2 else np.where(kind == NAME, own, hashes) if view else hashes


class Index:
    """The windows of a block of the benchmark, by entries: items that agree in all words and names and in which of their numbers and units are equal."""

    def __init__(self, items: list[tuple[int, str]], width: int = 8, least: int = 13):
        self.width, self.least, self.lexicon = width, least, Lexicon(Keys.drawn())
        texts = whole(pa.array([t for _, t in items], pa.string()))
        hashes, kind, own, first, capital, _ = canonical(texts, self.lexicon)
        entries: dict[tuple, list[int]] = {}
        for k in range(len(items)):
            a, b = int(first[k]), int(first[k + 1])
            if b - a < 3:
                continue
            seen: dict[int, int] = {}
            equal = [seen.setdefault(int(o), j) if slot else -1 for j, (o, slot) in enumerate(zip(own[a:b], kind[a:b] > 0))]
            entries.setdefault((_viewed(1, hashes[a:b], kind[a:b], own[a:b]).tobytes(), kind[a:b].tobytes(), tuple(equal), bool(capital[a])), []).append(k)
        #: Of each entry: its items' ids and their words, one row an item; the first item stands for it elsewhere.
        self.ids = [[items[k][0] for k in of] for of in entries.values()]
        self.words = [np.stack([own[first[k] : first[k + 1]] for k in of]) for of in entries.values()]
        told = [of[0] for of in entries.values()]
        pick = np.concatenate([np.arange(first[k], first[k + 1]) for k in told] or [np.empty(0, np.int64)]).astype(np.int64)
        self.hash, self.kind, self.own, self.capital = hashes[pick], kind[pick], own[pick], capital[pick]
        self.first = np.append(0, np.cumsum([first[k + 1] - first[k] for k in told])).astype(np.int64)
        templates: dict[bytes, int] = {}
        self.template = [templates.setdefault(self.hash[a:b].tobytes(), len(templates)) for a, b in zip(self.first, self.first[1:])]
        self._index(items, first, hashes, kind, own, {k: e for e, of in enumerate(entries.values()) for k in of})

    def _index(self, items, first, hashes, kind, own, entry_of) -> None:
        """Sorted tables of window hashes, one for each view and width: hash, entry, and the window's place from the entry's first word on. Items of three or four words have one of their whole."""
        size = np.diff(first)
        entry = np.array([entry_of.get(k, -1) for k in range(len(items))], np.int64)
        self.tables, self.wholes = {}, {}
        widths = sorted({int(min(n - 1, self.width)) for n in size if n >= 5})
        slots = np.append(0, np.cumsum(kind > 0))
        for view, w in [(v, w) for v in (0, 1, 2) for w in widths] + [(3, w) for w in (3, 4)]:
            at = np.flatnonzero(window_starts(first, w))
            item = np.searchsorted(first, at, "right") - 1
            if view == 3:
                ok = size[item] == w
            else:
                mostly = 2 * (slots[at + w] - slots[at]) > w
                ok = (size[item] >= 5) & (np.minimum(size[item] - 1, self.width) == w) & (mostly == (view == 2))
            at, item = at[ok], item[ok]
            if at.size:
                key = window_hash(_viewed(min(view, 2), hashes, kind, own), w)[at]
                rows = np.unique(np.stack([key, entry[item].astype(np.uint64), (at - first[item]).astype(np.uint64)], axis=1), axis=0)
                table = rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)
                (self.wholes if view == 3 else self.tables)[view, w] = table

    def _met(self, table, probe: np.ndarray, where: np.ndarray):
        """Places of a text's windows, and the entries and places in them that they meet."""
        key, entry, at = table
        left, right = np.searchsorted(key, probe, "left"), np.searchsorted(key, probe, "right")
        for k in np.flatnonzero(right > left).tolist():
            for j in range(left[k], right[k]):
                yield int(where[k]), int(entry[j]), int(at[j])

    def leaks(self, texts: Texts) -> list[tuple[int, int | None, int, int, int, int, int]]:
        """(row, item id, first word in the text, words, slots, values that differ, items) of every leak, one for a row and template: the item with the longest run, with the fewest values that differ among equals, and how many items of the template leak."""
        hashes, kind, own, first, capital, opens = canonical(texts, self.lexicon)
        row_of = lambda p: int(np.searchsorted(first, p, "right")) - 1
        met: dict[tuple[int, int, int], list[int]] = {}
        for (view, w), table in self.tables.items():
            where = np.flatnonzero(window_starts(first, w))
            for p, entry, at in self._met(table, window_hash(_viewed(view, hashes, kind, own), w)[where], where):
                met.setdefault((row_of(p), entry, p - at), []).append(p)
        best: dict[tuple[int, int], tuple] = {}  # by row and entry: words, first word, slots
        for (r, entry, shift), windows in met.items():
            begin, end = int(self.first[entry]), int(self.first[entry + 1])
            need, low = min(self.least, end - begin), max(int(first[r]), shift)
            name = end - begin <= self.least and low == shift and capital[low] and self.capital[begin] and kind[low] in (WORD, NAME) and self.kind[begin] == WORD
            for a, b, slots in self._runs(windows, shift - begin, kind, own, low, min(int(first[r + 1]), end - begin + shift), name):
                if b - a >= need and b - a > best.get((r, entry), (0,))[0]:
                    best[r, entry] = (b - a, a, slots, a - shift)
        for (_, w), table in self.wholes.items():
            ends = np.append(opens[1:], True)
            ends[first[1:][np.diff(first) > 0] - 1] = True
            where = np.flatnonzero(window_starts(first, w))
            where = where[opens[where] & ends[where + w - 1]]
            for p, entry, _ in self._met(table, window_hash(own, w)[where], where):
                best.setdefault((row_of(p), entry), (w, p, int((kind[p : p + w] > 0).sum()), 0))
        told: dict[tuple[int, int], tuple] = {}
        items: dict[tuple[int, int], int] = {}
        for (r, entry), (n, a, slots, at) in best.items():
            differ = (self.words[entry][:, at : at + n] != own[a : a + n]).sum(axis=1)
            k, key = int(differ.argmin()), (r, self.template[entry])
            items[key] = items.get(key, 0) + len(self.ids[entry])
            mine = (n, -int(differ[k]), -entry, int(a - first[r]), slots, self.ids[entry][k])
            told[key] = max(told.get(key, mine), mine, key=lambda x: x[:3])
        return [(r, id_, a, n, slots, -less, items[r, t]) for (r, t), (n, less, _, a, slots, id_) in told.items()]

    def _runs(self, windows, shift, kind, own, low, high, name):
        """Stretches of a diagonal, from ``low`` to ``high`` at most, that hold a window, agree word by word and whose slots are consistent, as long as can be; the first word is a slot if ``name``."""
        same = (own[low:high] == self.own[low - shift : high - shift]) | (kind[low:high] > 0) & (kind[low:high] == self.kind[low - shift : high - shift])
        same[0] |= name
        breaks = [low - 1, *(low + np.flatnonzero(~same)).tolist(), high]
        spans = sorted({(breaks[k - 1] + 1, breaks[k]) for k in (bisect.bisect(breaks, p) for p in windows)})
        for a, b in spans:
            slot = ~((own[a:b] == self.own[a - shift : b - shift]) & (kind[a:b] == WORD) & (self.kind[a - shift : b - shift] == WORD))
            before = np.append(0, np.cumsum(slot))
            start, last = a, {}  # of each item value: the document's value and where it stood last
            for p in (a + np.flatnonzero(slot)).tolist():
                mine, its = int(own[p]), int(self.own[p - shift])
                value, at = last.get(its, (mine, -1))
                if value != mine and at >= start:
                    yield start, p, int(before[p - a] - before[start - a])
                    start = at + 1
                last[its] = mine, p
            yield start, b, int(before[b - a] - before[start - a])


def blocks(benchmark: DataFrame, limit: int = 2_000_000, **how):
    """Indexes of the whole benchmark, broadcast one after the other, each of about ``limit`` words at most; and whether there is just one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = items.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(n / limit))
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about ``limit`` words
        by_id = sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(Index(by_id, **how)), parts == 1


LEAKS = "doc_id long, item_id long, first_word long, n_words long, n_slots long, verbatim boolean, n_items long"


def _leaks(rows: DataFrame, shared, kept: str = "") -> DataFrame:
    """LEAKS of rows of doc_id and text; kept: the name and type of a third column that is passed on."""
    kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in LEAKS.split(", ")]
    names = [c.split()[0] for c in LEAKS.split(", ")]

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                found = shared.value.leaks(texts)
                at = pa.array([texts.first + r for r, *_ in found], pa.int64())
                rest = list(zip(*[(i, a, n, slots, differ == 0, items) for _, i, a, n, slots, differ, items in found])) or [()] * 6
                columns = [batch.column(0).take(at), *(pa.array(c, t) for c, t in zip(rest, kinds[1:]))]
                more = [batch.column(2).take(at)] if kept else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *kept.split()[:1]])

    return rows.mapInArrow(run, LEAKS + (f", {kept}" if kept else ""))


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_slots, verbatim and n_items of every document and template that it leaks: the item of the longest run, where it stands, its slots, whether all values are the item's, and how many items of the template leak there (equal ones count). A template whose items are in several blocks has a row for each."""
    out = None
    for shared, alone in blocks(benchmark, **how):
        part = _leaks(docs_of(docs), shared)
        if not alone:
            part = stored(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that leak nothing."""
    text, gone = docs.columns.index("text"), None
    for shared, alone in blocks(benchmark, **how):
        if not alone:
            keyed = docs_of(docs).withColumn("text_key", F.xxhash64("text"))
            part = stored(_leaks(keyed, shared, "text_key long").select("doc_id", "text_key").distinct(), "leaks")
            shared.destroy()
            gone = part if gone is None else gone.unionByName(part)
            continue

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for texts in chunks(batch.column(text).cast(pa.string())):
                    keep[[texts.first + r for r, *_ in shared.value.leaks(texts)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    left, right = as_rows(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "row").alias("d"), gone.distinct().alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    return left.join(right, same, "left_anti").select("row.*")
