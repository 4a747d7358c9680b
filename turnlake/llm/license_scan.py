"""License scans by template-markup matching.

A template is licence wording with markup: plain words are mandatory, [ ... ] may be left out,
{n} stands for 0 to n replaceable words (a name, a year, a title), a|b are spellings that count as
the same word. Each template compiles into a token automaton; all templates run together, as a
subset automaton built lazily, from every word that can open one. A text is accepted where the
mandatory words stand exactly as written and in order. Plain phrases are templates without markup.

The templates below are the short licences in full and the notices by which the long ones are applied;
bodies of any length can be given to scan() in the same markup.

Edge cases: a null text counts as empty; without words n_words is 0, the labels are empty, first
and last are null and the score is 0. Ties need no rule: every place and every label counts. Repeated
rows and ids are rows of their own with equal results; an empty table gives an empty result; a very long
text is one row's work; other columns, whatever their names, are left out. One Arrow pass, no shuffle; a
task holds one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

#: Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Parts of wording that several templates share.
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_THIRD = " [[3] neither the name of {8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]"
_BSD_DISCLAIMER = (
    " this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
    " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
    " arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU_GRANT = (
    "free software you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software foundation"
    " either version 2|3 [1] of the license or at your option any later version"
)
_GNU_WARRANTY = (
    " {{6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    " see the gnu {name} general public license for more details"
)

#: Fixed values: (label, evidence, template). Evidence is 0.8 for a notice, 1 for licence text.
TEMPLATES = [
    ("mit", 0.8, "released|licensed|distributed|available under the [terms of the] mit license|licence"),
    ("apache-2.0", 0.8, "licensed|released|distributed under the [terms of the] apache license|licence version 2 0"),
    ("apache-2.0", 0.8, "spdx license identifier apache 2 0"),
    ("mit", 0.8, "spdx license identifier mit"),
    ("gpl-2.0", 0.8, "gnu general public license|licence [as published by the free software foundation] [either] version 2 [of the license] [or at your option any later version]"),
    ("gpl-3.0", 0.8, "gnu general public license|licence [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]"),
    ("lgpl", 0.8, "gnu lesser general public license|licence [version {2}]"),
    ("agpl", 0.8, "gnu affero general public license|licence [version {2}]"),
    ("cc-by-4.0", 0.8, "licensed|released|distributed under [a] [creative commons] cc by 4 0"),
    ("cc-by-sa-4.0", 0.8, "licensed|released|distributed under [a] [creative commons] cc by sa 4 0"),
    ("cc-by-nc-4.0", 0.8, "licensed|released|distributed under [a] [creative commons] cc by nc 4 0"),
    ("cc-by-nd-4.0", 0.8, "licensed|released|distributed under [a] [creative commons] cc by nd 4 0"),
    ("cc-by-4.0", 0.8, "creative commons attribution 4 0 [international] [public] license|licence"),
    ("cc0-1.0", 0.8, "cc0 1 0 universal"),
    (
        "mit-text",
        1.0,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software",
    ),
    (
        "mit-full",
        1.0,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the {8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        1.0,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "isc-full",
        1.0,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and {4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall {4} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
        " arising out of or in connection with the use or performance of this software",
    ),
    ("bsd-text", 1.0, _BSD + _BSD_THIRD),
    ("bsd-full", 1.0, _BSD + _BSD_THIRD + _BSD_DISCLAIMER),
    (
        "zlib-text",
        1.0,
        "this software is provided as is without any express or implied warranty in no event will the {4} be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [1] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required"
        " [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " [3] this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense-text",
        1.0,
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means",
    ),
    (
        "apache-2.0-notice",
        1.0,
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {8}"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " [see the license for the specific language governing permissions and limitations under the license]",
    ),
    ("gpl-notice", 1.0, _GNU_GRANT.format(name="") + _GNU_WARRANTY.format(name="")),
    ("lgpl-notice", 1.0, _GNU_GRANT.format(name="lesser") + _GNU_WARRANTY.format(name="lesser")),
    ("agpl-notice", 1.0, _GNU_GRANT.format(name="affero") + _GNU_WARRANTY.format(name="affero")),
    ("mpl-2.0-notice", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {8}"),
]

#: Evidence of a plain phrase.
PHRASE_EVIDENCE = 0.5

_NOT_WORD = bytes(c for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_TO_WORDS = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower-cased words of letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()


class Automaton:
    """Token automata of many templates, run as one lazily built subset automaton."""

    def __init__(self, templates: list[tuple[int, str]]):
        self.moves: list[list[tuple[frozenset | None, int]]] = []  # by state: (words, or None for any word; state)
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        starts = []
        for number, template in templates:
            start = end = self._state()
            starts.append(start)
            stack: list[int] = []
            for token in re.findall(r"[\[\]]|\{\d+\}|[^\s\[\]{}]+", template):
                if token == "[":
                    stack.append(end)
                    end = self._step(end)
                elif token == "]":
                    after = self._step(end)
                    self.free[stack.pop()].append(after)
                    end = after
                elif token[0] == "{":
                    for _ in range(int(token[1:-1])):
                        after = self._state()
                        self.moves[end].append((None, after))
                        self.free[end].append(after)
                        end = after
                else:
                    after = self._state()
                    self.moves[end].append((frozenset(x.encode() for x in token.split("|")), after))
                    end = after
            self.accepts[end] = number
        self.literal = {w for m in self.moves for words, _ in m if words for w in words}
        self.sets: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.accepted: list[frozenset] = []
        self.table: list[dict] = []
        self.dead = self._subset(frozenset())
        self.start = self._subset(self._closure(starts))
        self.openers = {w for s in self.members[self.start] for words, _ in self.moves[s] if words for w in words}

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _step(self, end: int) -> int:
        after = self._state()
        self.free[end].append(after)
        return after

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _subset(self, states: frozenset) -> int:
        if states not in self.sets:
            self.sets[states] = len(self.members)
            self.members.append(states)
            self.accepted.append(frozenset(self.accepts[s] for s in states if s in self.accepts))
            self.table.append({})
        return self.sets[states]

    def next(self, at: int, word: bytes) -> int:
        key = word if word in self.literal else None
        to = self.table[at].get(key)
        if to is None:
            to = self._subset(self._closure({s for m in self.members[at] for words, s in self.moves[m] if words is None or word in words}))
            self.table[at][key] = to
        return to

    def run(self, words: list[bytes], at: int) -> list[tuple[int, int]]:
        """(template, end) of each template accepted from the word at; end is its longest match's."""
        state, ends = self.start, {}
        for k in range(at, len(words)):
            state = self.next(state, words[k])
            if state == self.dead:
                break
            for t in self.accepted[state]:
                ends[t] = k + 1
        return sorted(ends.items())


class Scanner:
    """Compiled templates; find() gives all matches of a text."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, float, str]] = TEMPLATES):
        self.names = [*phrases.values(), *(t[0] for t in templates)]
        self.evidence = [PHRASE_EVIDENCE] * len(phrases) + [t[1] for t in templates]
        self.n_base = len(phrases)
        self.automaton = Automaton(list(enumerate([*phrases, *(t[2] for t in templates)])))
        self.opener = re.compile(b" (?:" + b"|".join(map(re.escape, sorted(self.automaton.openers))) + b")(?= )")

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) by start."""
        line, found, at, passed = b" " + b" ".join(words) + b" ", [], 0, 0
        for m in self.opener.finditer(line):
            at += line.count(b" ", passed, m.start())
            passed = m.start()
            found += [(t, at, end) for t, end in self.automaton.run(words, at)]
        return found


def _scan(templates: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = worker_state(("licences", templates), lambda: Scanner(templates=list(templates)))
    for batch in batches:
        rows = []
        for x in batch.column(1):
            words = words_of(x.as_py())
            found = s.find(words)
            base = [f for f in found if f[0] < s.n_base]
            label = lambda fs: ",".join(sorted({s.names[f[0]] for f in fs}))
            covered = len({k for _, a, b in found for k in range(a, b)})
            rows.append((len(words), len(base), base[0][1] if base else None, base[-1][1] if base else None, label(base), label(found), max((s.evidence[f[0]] for f in found), default=0.0), covered, [{"label": s.names[t], "first_word": a, "end_word": b} for t, a, b in found]))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), _PLACES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *_NAMES])


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_words", "places"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, float, str]] = TEMPLATES) -> DataFrame:
    """One row per input row: counts, labels, score (strongest evidence), words covered, all places.
    templates: (label, evidence, wording with markup), tried beside the phrases of the base scan."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_scan, tuple(templates)), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_words long, places array<struct<label:string,first_word:long,end_word:long>>"
    )
    return out.withColumnRenamed("id", id_col)
