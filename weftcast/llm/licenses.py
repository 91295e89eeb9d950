"""License scans by template markup.

A template is a text of lower-case words with optional regions in brackets,
alternatives in braces and replaceable regions ``<a-b>`` of a to b words; it is compiled
into an automaton over words. A text has the template's label if the automaton accepts
words that stand consecutively in it: mandatory wording has to match exactly, from its
first word to its last. ``LICENSES`` are whole licences and the standard headers that
stand for one; ``NOTICES`` are short phrases that name a licence. Hashes of the words that
a template may begin with, up to four, tell at once where an automaton has to run. Base
phrases, plain sequences of words, are found by comparing word hashes.

A-Z are lower-cased; words are runs of digits, letters and bytes from 0x80 on. Null and
empty texts have no words, no labels and a score of 0. Score: 1 if a whole licence is
accepted, 0.95 if a notice is, 0.9 if only a base phrase stands in the text, else 0. Very
long texts are scanned whole; two labels in one text are both told. Rows that repeat give
equal rows, a null doc_id a row as any other. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of
from .scan import Keys, byte_set, chunks, keyed_hash, window_hash, window_starts, words

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_MIT_END = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall <1-12> be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by <1-12> as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall <1-12> be liable for any direct indirect incidental special
exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business
interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
any way out of the use of this software even if advised of the possibility of such damage"""


def _gnu(name: str, version: str) -> str:
    return f"""is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software
foundation either version {version} of the license or at your option any later version this <1-4> is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} for more details you
should have received a copy of the gnu {name} along with this <1-4>"""


#: Whole licences and standard headers by label.
LICENSES = (
    ("mit", f"""permission is hereby granted free of charge to any person obtaining a copy of this <1-4> and associated documentation files the <1-4> to
deal in the <1-4> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
of the <1-4> and to permit persons to whom the <1-4> is furnished to do so subject to the following conditions the above copyright notice and this
permission notice [including the next paragraph] shall be included in all copies or substantial portions of the <1-4> {_MIT_END}"""),
    ("isc", """permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the
above copyright notice and this permission notice appear in all copies the software is provided as is and <1-8> disclaims all warranties with regard to
this software including all implied warranties of merchantability and fitness in no event shall <1-8> be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
action arising out of or in connection with the use or performance of this software"""),
    ("bsd-2", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3", f"""{_BSD_START} [3] neither the {{name|names}} of <1-12> nor the names of <1-6> may be used to endorse or promote products derived from
this software without specific prior written permission {_BSD_END}"""),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at <1-9> unless required by applicable law or agreed to in writing software distributed under the license is distributed on
an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
and limitations under the license"""),
    ("gpl-2", _gnu("general public license", "2")),
    ("gpl-3", _gnu("general public license", "3")),
    ("lgpl-2", _gnu("lesser general public license", "2 1")),
    ("lgpl-3", _gnu("lesser general public license", "3")),
    ("agpl-3", _gnu("affero general public license", "3")),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at"""),
    ("cc0", "to the extent possible under law <1-12> has waived all copyright and related or neighboring rights to"),
    ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in
jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public
domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_MIT_END}"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will <1-8> be held liable for any damages arising
from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions [1] the origin of this software must not be misrepresented you must not claim that you wrote
the original software if you use this software in a product an {acknowledgment|acknowledgement} in the product documentation would be appreciated but is
not required [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may
not be removed or altered from any source distribution"""),
)
#: Short notices by label.
NOTICES = (
    ("mit", "{released|licensed|distributed|available} under [the terms of] the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <1-6> and associated documentation files"),
    ("apache-2", "{released|licensed|distributed|available} under [the terms of] the apache license version 2 [0]"),
    ("gpl-3", "{released|licensed|distributed|available} under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2", "{released|licensed|distributed|available} under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 2"),
    ("lgpl-3", "{released|licensed|distributed|available} under [the terms of] the gnu lesser general public license [as published by the free software foundation] [either] version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license [v] [version] 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under [a] [the] {cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial} <0-2> 4 0"),
    ("cc-by-sa", "licensed under [a] [the] {cc by sa|creative commons attribution sharealike|creative commons attribution share alike} <0-2> 4 0"),
    ("cc-by", "licensed under [a] [the] {cc by|creative commons attribution} <0-1> 4 0"),
)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_split = byte_set(bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)))


class Automaton:
    """Words to sets of states: a state has moves by word, by any word, and without a word."""

    def __init__(self, template: str):
        self.by_word: list[dict[str, list[int]]] = [{}]
        self.by_any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        at = 0
        for optional, choice, low, high, word in re.findall(r"\[([^]]*)\]|\{([^}]*)\}|<(\d+)-(\d+)>|(\S+)", template):
            if low:
                ends = [at]
                for k in range(int(high)):
                    new = self._state()
                    self.by_any[ends[-1]].append(new)
                    ends.append(new)
                at = self._join(ends[int(low) :])
            else:
                branches = [b.split() for b in (optional or choice or word).split("|")]
                at = self._join([self._line(at, b) for b in branches] + [at] * bool(optional))
        self.end = at
        self.openings = self._openings()

    def _openings(self, most: int = 4) -> set[tuple[str, ...]]:
        """The words, up to ``most``, that every accepted sequence begins with one of; shorter ones where any word may follow or nothing has to."""
        out, todo = set(), [((), frozenset(self._closed({0})))]
        while todo:
            said, states = todo.pop()
            if len(said) == most or self.end in states or any(self.by_any[s] for s in states):
                out.add(said)
                continue
            for w in {w for s in states for w in self.by_word[s]}:
                todo.append(((*said, w), frozenset(self._closed({t for s in states for t in self.by_word[s].get(w, ())}))))
        return out

    def _state(self) -> int:
        for table, empty in ((self.by_word, {}), (self.by_any, []), (self.free, [])):
            table.append(empty.copy())
        return len(self.free) - 1

    def _line(self, at: int, words_: list[str]) -> int:
        for w in words_:
            new = self._state()
            self.by_word[at].setdefault(w, []).append(new)
            at = new
        return at

    def _join(self, ends: list[int]) -> int:
        new = self._state()
        for e in ends:
            self.free[e].append(new)
        return new

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts_from(self, words_: list[str], at: int) -> bool:
        """Whether the template matches words that start at ``at``."""
        states = self._closed({0})
        while states and self.end not in states and at < len(words_):
            w = words_[at]
            states = self._closed({t for s in states for t in (*self.by_word[s].get(w, ()), *self.by_any[s])})
            at += 1
        return self.end in states


def template_regex(template: str) -> str:
    """The same language over words that each have a space behind, as a regular expression."""
    out = ""
    for optional, choice, low, high, word in re.findall(r"\[([^]]*)\]|\{([^}]*)\}|<(\d+)-(\d+)>|(\S+)", template):
        out += f"(?:[^ ]+ ){{{low},{high}}}" if low else f"(?:{'|'.join(b + ' ' for b in (optional or choice or word).split('|'))})" + "?" * bool(optional)
    return out


def _hashes(words_: list[str], keys: Keys) -> np.ndarray:
    blob = [w.encode() for w in words_]
    at = np.append(0, np.cumsum([len(b) for b in blob]))
    return keyed_hash(np.frombuffer(b"".join(blob), np.uint8), at[:-1], at[1:], keys)


def license_scan(docs: DataFrame, base=BASE, licenses=LICENSES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    automata = [(label, Automaton(t), score) for score, kind in ((1.0, licenses), (0.95, notices)) for label, t in kind]
    secret = Keys.drawn()  # no word can be written to pass for one of a phrase
    by_opening: dict[int, dict[int, list[int]]] = {}  # length, hash of the words, automata
    for k, (label, automaton, _) in enumerate(automata):
        for said in automaton.openings:
            if not said:
                raise ValueError(f"a template of {label} may begin with any word")
            by_opening.setdefault(len(said), {}).setdefault(int(window_hash(_hashes(list(said), secret), len(said))[0]), []).append(k)
    opening_keys = {n: np.sort(np.array(list(found), np.uint64)) for n, found in by_opening.items()}
    phrases = [(_hashes(p.split(), secret), label) for p, label in base]

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(1)):
                data = _lower[texts.data]
                starts, ends, first = words(texts, _split)
                hashes = keyed_hash(data, starts, ends, secret)
                row = np.repeat(np.arange(texts.n), np.diff(first))
                n_base = np.zeros(texts.n, np.int64)
                low, high = np.full(texts.n, 1 << 62), np.full(texts.n, -1)
                base_labels: list[set] = [set() for _ in range(texts.n)]
                for phrase, label in phrases:
                    n = phrase.size
                    ok = np.ones(max(hashes.size - n + 1, 0), bool)
                    for k in range(n):
                        ok &= hashes[k : k + ok.size] == phrase[k]
                    at = np.flatnonzero(ok)
                    at = at[row[at] == row[at + n - 1]]
                    np.add.at(n_base, row[at], 1)
                    np.minimum.at(low, row[at], at - first[row[at]])
                    np.maximum.at(high, row[at], at - first[row[at]])
                    for r in np.unique(row[at]).tolist():
                        base_labels[r].add(label)
                labels = [set(b) for b in base_labels]
                scores = np.where(n_base > 0, 0.9, 0.0)
                may: dict[int, list[tuple[int, int]]] = {}  # row: places and automata
                for n, keys in opening_keys.items():
                    window = window_hash(hashes, n)
                    at = np.flatnonzero(window_starts(first, n) & (keys[np.minimum(np.searchsorted(keys, window), keys.size - 1)] == window))
                    for r, p, key in zip(row[at].tolist(), at.tolist(), window[at].tolist()):
                        may.setdefault(r, []).extend((p, k) for k in by_opening[n][key])
                for r, found in may.items():
                    a, b = first[r], first[r + 1]
                    own = [data[s:e].tobytes().decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    for at, k in found:
                        label, automaton, score = automata[k]
                        if (label not in labels[r] or scores[r] < score) and automaton.accepts_from(own, at - a):
                            labels[r].add(label)
                            scores[r] = max(scores[r], score)
                place_of = lambda x: pa.array(x, pa.int64(), mask=n_base == 0)
                joined = lambda x: pa.array([",".join(sorted(s)) for s in x], pa.string())
                columns = [batch.column(0).slice(texts.first, texts.n), pa.array(np.diff(first)), pa.array(n_base), place_of(low), place_of(high), joined(base_labels), joined(labels), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs_of(docs).mapInArrow(run, schema)
