"""License scans by template markup.

A template is license wording with regions in markup: ``<<opt>> ... <</opt>>`` may be left out, ``<<var:MIN-MAX>>`` stands for
that many words of any kind. Templates are compiled into token automata; a place in a text matches when the mandatory words
stand there exactly and in order. Single phrases (the base ones) are templates without regions.

Null text is empty: no words, no labels, score 0. A null doc_id is carried; repeated rows are scanned alike; other columns,
whatever their names, are ignored; very long texts are scanned whole; an empty table gives an empty result. Places where
several templates match count for each. The score is the share of a text's words that stand in a match.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Phrases every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Stretches that several licenses share.
AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall <<var:1-12>> be liable for any claim damages "
    "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
    "use or other dealings in the software"
)
MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
)
BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met <<opt>><<var:1-1>><</opt>> redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer <<opt>><<var:1-1>><</opt>> redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_END = (
    "this software is provided by <<var:1-20>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1-20>> be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)


def gnu(name: str, version: str) -> str:
    """The notice of the GNU licenses."""
    return (
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} license as "
        f"published by the free software foundation <<opt>>either<</opt>> version {version} of the license <<opt>>or at your option any later "
        f"version<</opt>> <<var:1-4>> is distributed in the hope that it will be useful but without any warranty without even the implied "
        f"warranty of merchantability or fitness for a particular purpose see the gnu {name} license for more details"
    )


#: Templates and their labels: the wording of licenses, and of the notices that name one. Only titles, names, numbers and what
#: licenses themselves leave open are regions.
TEMPLATES = [
    ("mit", f"{MIT_GRANT} subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software {AS_IS}"),
    ("mit-0", f"{MIT_GRANT} {AS_IS}"),
    ("bsd-2-clause", f"{BSD_START} {BSD_END}"),
    ("bsd-3-clause", f"{BSD_START} <<opt>><<var:1-1>><</opt>> neither the name of <<var:1-20>> nor the names of <<opt>>its<</opt>> <<opt>>other<</opt>> contributors may be used to endorse or promote products derived from this software without specific prior written permission {BSD_END}"),
    (
        "isc",
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and "
        "<<var:1-12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in "
        "no event shall <<var:1-12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will <<var:1-12>> be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an acknowledgment in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions "
        "must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<</opt>> this notice may not "
        "be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any "
        "means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our "
        f"heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        f"to this software under copyright law {AS_IS}",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at <<opt>>http<</opt>> <<opt>>https<</opt>> www apache org licenses license 2 0 <<opt>>txt<</opt>> unless "
        "required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<opt>>http<</opt>> <<opt>>https<</opt>> mozilla org mpl 2 0"),
    *[(f"{label}-{v}.{minor}-notice", gnu(name, f"{v} 1" if minor == 1 else f"{v}")) for label, name, v, minor in (("gpl", "general public", 2, 0), ("gpl", "general public", 3, 0), ("lgpl", "lesser general public", 2, 1), ("lgpl", "lesser general public", 3, 0), ("agpl", "affero general public", 3, 0))],
    ("mit", "released under the <<opt>>terms of the<</opt>> mit license"),
    ("mit", "licensed under the <<opt>>terms of the<</opt>> mit license"),
    ("apache-2.0", "licensed under the apache license <<opt>>version<</opt>> 2 0 <<opt>>the license<</opt>>"),
    ("gpl-3.0", "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 3"),
    ("gpl-2.0", "licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 2"),
    ("cc-by-nc-4.0", "licensed under <<opt>>the<</opt>> <<opt>>a<</opt>> cc by nc 4 0 <<opt>>international<</opt>> <<opt>>license<</opt>>"),
    ("cc-by-4.0", "licensed under <<opt>>the<</opt>> <<opt>>a<</opt>> cc by 4 0 <<opt>>international<</opt>> <<opt>>license<</opt>>"),
    ("cc-by-sa-4.0", "licensed under <<opt>>the<</opt>> <<opt>>a<</opt>> cc by sa 4 0 <<opt>>international<</opt>> <<opt>>license<</opt>>"),
    ("copyright-notice", "copyright <<opt>>c<</opt>> <<var:1-8>> all rights reserved"),
]

_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased: runs of digits, a-z and all beyond ASCII, as UTF-8."""
    return text.encode("utf-8").lower().translate(_SPACE).split()


class Automaton:
    """A template's token automaton: per state the words that lead on, and the states reached without a word.

    A state with ``any`` True is also led on by whatever word.
    """

    def __init__(self, template: str):
        self.step: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        at, opened = 0, []
        for token in re.findall(r"<<.*?>>|[^\s<>]+", template):
            if token == "<<opt>>":
                opened.append(at)
            elif token == "<</opt>>":
                self.free[opened.pop()].append(at)
            elif found := re.fullmatch(r"<<var:(\d+)-(\d+)>>", token):
                least, most = map(int, found.groups())
                skips = []
                for k in range(most):
                    if k >= least:
                        skips.append(at)
                    self.any[at] = at = self.state()
                for s in skips:
                    self.free[s].append(at)
            else:
                self.step[at][token.encode()] = at = self.state()
        if opened:
            raise ValueError(f"a region isn't closed: {template}")
        self.end = at
        self.closure = [self.reached(s) for s in range(len(self.step))]
        if self.end in self.closure[0]:
            raise ValueError(f"the template has no mandatory wording: {template}")
        if any(self.any[s] is not None for s in self.closure[0]):
            raise ValueError(f"the template begins with a replaceable region: {template}")
        self.first = {w for s in self.closure[0] for w in self.step[s]}

    def state(self) -> int:
        self.step.append({}), self.free.append([]), self.any.append(None)
        return len(self.step) - 1

    def reached(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest match that begins at a word; -1 where none does."""
        states, found, k = self.closure[0], -1, start
        while states and k < len(words):
            w, k, following = words[k], k + 1, set()
            for s in states:
                to = self.step[s].get(w)
                if to is not None:
                    following |= self.closure[to]
                if self.any[s] is not None:
                    following |= self.closure[self.any[s]]
            states = following
            if self.end in states:
                found = k
        return found


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.automata = [(label, phrase in base, Automaton(phrase)) for phrase, label in base.items()] + [(label, False, Automaton(t)) for label, t in templates]
        self.by_first: dict[bytes, list[int]] = defaultdict(list)
        for k, (_, _, a) in enumerate(self.automata):
            for w in a.first:
                self.by_first[w].append(k)
        # where a first word is followed by none of the words that can be second, no automaton is started
        self.second = {w: self.seconds(w) for w in self.by_first}

    def seconds(self, word: bytes) -> set[bytes] | None:
        """Words that can follow a first word; None where any word can, or none is needed."""
        out: set[bytes] = set()
        for k in self.by_first[word]:
            a = self.automata[k][2]
            states = {t for s in a.closure[0] if word in a.step[s] for t in a.closure[a.step[s][word]]}
            if a.end in states or any(a.any[s] is not None for s in states):
                return None
            out |= {w for s in states for w in a.step[s]}
        return out

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, int]]:
        """(label, whether base, first word, end) of every match."""
        out = []
        for first in self.by_first.keys() & set(words):
            second, at = self.second[first], -1
            try:
                while True:
                    at = words.index(first, at + 1)
                    if second is None or (at + 1 < len(words) and words[at + 1] in second):
                        for k in self.by_first[first]:
                            label, base, automaton = self.automata[k]
                            if (end := automaton.match(words, at)) >= 0:
                                out.append((label, base, at, end))
            except ValueError:
                pass
        return out


def covered(spans: list[tuple[int, int]]) -> int:
    total = reach = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first-end) of every row."""

    def rows(batches):
        scanner = Scanner(templates, base)
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text or "")
                found = sorted(scanner.scan(words), key=lambda m: (m[2], m[3], m[0]))
                starts = [m[2] for m in found if m[1]]
                labels = [",".join(sorted({m[0] for m in found if m[1] or not only})) for only in (True, False)]
                score = covered([m[2:] for m in found]) / len(words) if words else 0.0
                out.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), *labels, score, ",".join(f"{m[0]}:{m[2]}-{m[3]}" for m in found)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
