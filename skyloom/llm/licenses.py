"""Licence scans: matching statistics over a generalised suffix automaton of licence templates.

The templates' words are put into one automaton.  A text is streamed through
it; at each word it tells the longest suffix that occurs in some template.
Long maximal matches that follow each other in text and template are chained
so that each chain covers most of its template; one that covers enough labels
the text, unless a chain that covers more words lies on the same place.  Three
fixed phrases are counted on their own (``BASE``).
"""

from __future__ import annotations

from bisect import bisect
from collections import deque
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and bodies of well-known public licences, label first.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("lgpl-3.0", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
]
# Identifiers of file headers, label first; names in "under the ... license"; parts of the Creative Commons licences.
IDENTIFIERS = [
    ("apache-2.0", "apache 2 0"), ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("bsl-1.0", "bsl 1 0"), ("mpl-2.0", "mpl 2 0"), ("epl-2.0", "epl 2 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("cc0-1.0", "cc0 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"), ("agpl-3.0", "agpl 3 0"),
]
NAMES = [("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("apache-2.0", "apache 2 0"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause")]
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_PARTS = {"by": ["attribution"], "nc": ["noncommercial", "non commercial"], "sa": ["sharealike", "share alike"], "nd": ["noderivatives", "noderivs", "no derivatives"]}
CC_VERSIONS = {"4.0": "international", "3.0": "unported"}


def _templates() -> list[tuple[str, str]]:
    """The notices, and short ones made from identifiers, names and the parts of the Creative Commons licences."""
    out = list(NOTICES)
    for label, name in IDENTIFIERS:
        endings = ["", " only", " or later"] if "gpl" in label else [""]
        out += [(label, f"spdx license identifier {name}{ending}") for ending in endings]
    out += [(label, f"under {the}{name} license") for label, name in NAMES for the in ("", "the ")]
    for kind in CC_KINDS:
        for version, place in CC_VERSIONS.items():
            label, number = f"cc-{kind}-{version}", version.replace(".", " ")
            out.append((label, f"cc {kind.replace('-', ' ')} {number}"))
            out += [(label, f"creative commons {' '.join(names)} {number} {place} license") for names in product(*(CC_PARTS[part] for part in kind.split("-")))]
    return out


TEMPLATES = _templates()
#: Words of a match that counts, words that a chain may skip, and share of a template that a chain must cover.
MIN_MATCH, MAX_GAP, COVERED = 3, 8, 0.8

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class Automaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: For each state of a match that counts, the sequences in which its words occur, each with all places after them.
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.next]
        for t, seq in enumerate(sequences):
            state = 0
            for i, w in enumerate(seq, 1):
                state = up = self.next[state][w]
                while self.length[up] >= MIN_MATCH:
                    self.ends[up].setdefault(t, []).append(i)
                    up = self.link[up]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's words and w, set apart from longer ones."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def matches(self, run: list[int], start: int) -> list[tuple[int, int, int]]:
        """Maximal matches in a run of known words: (end, length, state), from the matching statistics."""
        out, state, size, previous = [], 0, 0, (0, 0, 0)
        for i, w in enumerate(run, start + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if size <= previous[1] and previous[1] >= MIN_MATCH:
                out.append(previous)
            previous = (i, size, state)
        if previous[1] >= MIN_MATCH:
            out.append(previous)
        return out


class Scanner:
    def __init__(self):
        texts = [words(t) for _, t in TEMPLATES]
        phrases = [words(p) for p in BASE]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*texts, *phrases] for w in t))}
        coded = [[self.number[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in coded]
        self.automaton = Automaton(coded)
        self.phrases = [(label, [self.number[w] for w in p]) for label, p in zip(BASE.values(), phrases, strict=True)]

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains (words covered, start, end, template) that cover enough of a template.

        A chain's matches follow each other in text and template, with at most
        ``MAX_GAP`` words of the text between two.  For each end of a match the
        chain that covers most words is found from those that ended before it;
        of equal ones the shortest.  Starts of maximal matches never decrease,
        so chains that ended too early are forgotten: time is linear in the text.
        """
        out = []
        ended: dict[int, deque[tuple[int, int, int, int]]] = {}  # by template: text end, template end, words covered, text start
        for end, size, state in matches:
            begin = end - size
            for t, places in self.automaton.ends[state].items():
                before = ended.setdefault(t, deque())
                while before and before[0][0] + MAX_GAP < begin:
                    before.popleft()
                found = []
                for at in places:
                    best = size, begin
                    for text_end, template_end, covered, start in before:
                        if template_end < at:
                            best = max(best, (covered + size - max(0, template_end - at + size, text_end - begin), start))
                    found.append((end, at, *best))
                before += found
                most, start = max(x[2:] for x in found)
                if most >= COVERED * self.sizes[t]:
                    out.append((most, start, end, t))
        return out

    def settled(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Those chains that stand, by their start: the one of most words first, no other that lies on it by more than half of its own length.

        Of equal ones the more complete, the shorter, the earlier one stands.
        """
        kept: list[tuple[int, int, int, int]] = []
        for chain in sorted(chains, key=lambda c: (-c[0], -c[0] / self.sizes[c[3]], c[2] - c[1], c[1], c[3])):
            _, a, b, _ = chain
            i = bisect(kept, a, key=lambda c: c[1])
            # kept spans overlap by less than half of theirs, so at most a few reach over a place
            near = kept[max(0, i - 3) : i] + kept[i : bisect(kept, b, key=lambda c: c[1])]
            if all(2 * (min(b, y) - max(a, x)) <= b - a for _, x, y, _ in near):
                kept.insert(i, chain)
        return kept

    def __call__(self, text: str | None) -> tuple:
        found = words(text)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        places: list[np.ndarray] = []
        base = set()
        for label, phrase in self.phrases:
            n = len(ids) - len(phrase) + 1
            hit = np.flatnonzero(np.logical_and.reduce([ids[i : n + i] == w for i, w in enumerate(phrase)])) if n > 0 else ids[:0]
            if len(hit):
                base.add(label)
                places.append(hit)
        matches = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= MIN_MATCH:
                matches += self.automaton.matches(ids[a:b].tolist(), a)
        stand = self.settled(self.chains(matches))
        score = 1.0 if base else max((c / self.sizes[t] for c, _, _, t in stand), default=0.0)
        spans = ",".join(sorted({f"{TEMPLATES[t][0]}:{a}-{b}" for _, a, b, t in stand}))
        where = np.concatenate(places) if places else None
        return len(found), 0 if where is None else len(where), None if where is None else int(where.min()), None if where is None else int(where.max()), ",".join(sorted(base)), ",".join(sorted(base | {TEMPLATES[t][0] for *_, t in stand})), score, spans


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document: base phrases, and the labels of covered templates with their ``spans`` (label:first-end in words, end excluded).

    Null and empty texts have no words and no labels (empty strings, score 0);
    repeated rows give repeated rows; other columns aren't read.
    """

    def make():
        scan = scanner()

        def work(cols):
            rows = [scan(t) for t in cols["text"]]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            return {"doc_id": cols["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCHEMA)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
