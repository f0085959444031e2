"""Licence texts in documents, by a generalised suffix automaton of the licences' words.

The templates below (notices, licence lines, SPDX lines) and the phrases form one automaton whose arcs carry word ids. A
document streams through it once: at every word the automaton holds the longest run of words that ends there and stands in
some template. Along the state's suffix links stand the longest runs of all other templates: the matching statistics of
each. From them come

* the places of whole phrases: a phrase ends where its own state lies on the suffix-link path of the current state;
* matches: runs of at least ``MIN_MATCH`` words of a template (of all its words, where it has fewer) that can't be extended to
  the right, with every place where they stand in the template. Matches of one template that follow each other in the
  document and in the template, with small gaps, are chained into spans. A span that covers ``MIN_COVER`` of its template,
  or all of a template of at most ``SHORT`` words, gives the template's label.

Words that no template holds reset the automaton, so only runs of template words are walked.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import packed, row_field, unpacked
from ladderworks.llm.words import ALNUM, Words, pieces, split_words

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public notices that licences ask to put into files.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
}
#: Lines by which texts say their licence.
LINES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["MIT License", "SPDX-License-Identifier: MIT"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "SPDX-License-Identifier: GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3.0": ["GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl-2.0": ["Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["CC BY-NC", "Creative Commons Attribution-NonCommercial"],
    "cc-by-sa": ["CC BY-SA", "Creative Commons Attribution-ShareAlike"],
    "cc-by-nd": ["CC BY-ND", "Creative Commons Attribution-NoDerivatives"],
    "cc-by-nc-sa": ["CC BY-NC-SA"],
    "cc-by-nc-nd": ["CC BY-NC-ND"],
    "cc0-1.0": ["CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
MIN_MATCH = 4
MAX_GAP = 6
MIN_COVER = 0.2
SHORT = 12

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class SuffixAutomaton:
    """Of several word sequences, built word by word; a state knows its longest length, its link and all its ends in templates."""

    def __init__(self, sequences: list[list[int]]):
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for which, words in enumerate(sequences):
            state = 0
            for at, word in enumerate(words, 1):
                state = self._add(state, word)
                self.ends[state].setdefault(which, set()).add(at)
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            for which, places in self.ends[state].items():
                self.ends[self.link[state]].setdefault(which, set()).update(places)

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.arcs.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the shorter strings of q that p leads to by the word."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.arcs[p].get(word) == q:
            self.arcs[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.arcs[last]:
            return self._split(last, word, self.arcs[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.arcs[p]:
            self.arcs[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.arcs[p][word])
        return new

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: (state, matched length) after each word."""
        state = length = 0
        arcs, link, longest = self.arcs, self.link, self.length
        for word in words:
            while state and word not in arcs[state]:
                state = link[state]
                length = longest[state]
            if word in arcs[state]:
                state, length = arcs[state][word], length + 1
            yield state, length


Match = tuple[int, int, tuple[int, ...]]


class Scanner:
    """Templates compiled for scanning. A label may have several templates."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str | list[str]]):
        templates = [(label, t) for label, own in notices.items() for t in ([own] if isinstance(own, str) else own)]
        self.names = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases = len(phrases)
        sequences = [template_words(t) for t in [*phrases, *(t for _, t in templates)]]
        flat = [w for s in sequences for w in s]
        table = split_words([" ".join(flat).encode()], ALNUM, lower=True)
        self.hashes, first = np.unique(table.hashes, return_index=True)
        ids = {flat[i]: k for k, i in enumerate(first.tolist())}
        self.sequences = [[ids[w] for w in s] for s in sequences]
        self.least = [min(MIN_MATCH, len(s)) for s in self.sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        self.phrases_at, self.held_at = self._phrases_at(), self._held_at()
        self.shortest = min([MIN_MATCH, *(n for n in self.least if n)])

    def _phrases_at(self) -> dict[int, list[tuple[int, int]]]:
        """Per state, the phrases (index, words) that end there: their own states are on the state's link path."""
        a, own = self.automaton, defaultdict(list)
        for i, s in enumerate(self.sequences[: self.n_phrases]):
            state = 0
            for w in s:
                state = a.arcs[state][w]
            own[state].append((i, len(s)))
        out = {}
        for state in range(1, len(a.length)):
            s, found = state, []
            while s > 0:
                found += own.get(s, ())
                s = a.link[s]
            if found:
                out[state] = found
        return out

    def _held_at(self) -> dict[int, list[tuple[int, int | None, tuple[int, ...]]]]:
        """Per state and template: the longest run that ends there (None: all that the automaton has matched) and its ends."""
        a, out = self.automaton, {}
        for state in range(1, len(a.length)):
            found: dict[int, tuple[int, int | None, tuple[int, ...]]] = {}
            s = state
            while s > 0:
                for which, places in a.ends[s].items():
                    if which >= self.n_phrases and which not in found and a.length[s] >= self.least[which]:
                        found[which] = (which, None if s == state else a.length[s], tuple(sorted(places)))
                s = a.link[s]
            if found:
                out[state] = list(found.values())
        return out

    def scan(self, ids: list[int], at: int) -> tuple[list[tuple[int, int, int]], dict[int, list[Match]]]:
        """A run of template words from word ``at`` on: phrase places (start, phrase, words), and per template its maximal
        matches (past last word, length, ends in the template)."""
        places: list[tuple[int, int, int]] = []
        matches: dict[int, list[Match]] = defaultdict(list)
        held: dict[int, Match] = {}
        for k, (state, length) in enumerate(self.automaton.walk(ids), at):
            for phrase, n in self.phrases_at.get(state, ()):
                if n <= length:
                    places.append((k - n + 1, phrase, n))
            now = {}
            for which, n, ends in self.held_at.get(state, ()):
                n = length if n is None else n
                if n >= self.least[which]:
                    now[which] = (k + 1, n, ends)
            for which, before in held.items():
                if which not in now or now[which][1] <= before[1]:
                    matches[which].append(before)
            held = now
        for which, before in held.items():
            matches[which].append(before)
        return places, matches

    def chained(self, which: int, matches: list[Match]) -> list[tuple[int, int, float]]:
        """(first word, past last word, covered share) of the spans of a template: chains of its matches in document order
        that cover enough of it. Of chains that overlap in the document, the one that covers most stays."""
        size = len(self.sequences[which])
        chains: list[tuple[int, int, int, int]] = []  # first, past, covered words, end in the template
        open_chains: list[tuple[int, int, int, int]] = []
        for end, length, ends in matches:
            start = end - length
            open_chains = [c for c in open_chains if start - c[1] <= MAX_GAP]
            fresh = []
            for stop in ends:
                begin = stop - length
                best = (start, end, length, stop)
                for first, past, cover, last in open_chains:
                    gain = length - max(0, past - start, last - begin)
                    if gain > 0 and begin - last <= MAX_GAP and cover + gain > best[2]:
                        best = (first, end, cover + gain, stop)
                fresh.append(best)
            chains += fresh
            open_chains += fresh
        need = size if size <= SHORT else MIN_COVER * size
        out: list[tuple[int, int, float]] = []
        past_all = -1
        for first, past, cover, _ in sorted((c for c in chains if c[2] >= need), key=lambda c: (c[0], -c[2], c[1])):
            if first >= past_all:
                out.append((first, past, min(1.0, cover / size)))
                past_all = past
            elif cover / size > out[-1][2]:
                out[-1] = (min(first, out[-1][0]), max(past, past_all), min(1.0, cover / size))
                past_all = out[-1][1]
        return out

    def texts(self, words: Words) -> Iterator[tuple]:
        """Per text: words, phrase places (start, words, label), spans (first, past last, label, share)."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        known = self.hashes[at] == words.hashes
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], known[a:b].astype(np.int8), [0]])))
            places: list[tuple[int, int, int]] = []
            matches: dict[int, list[Match]] = defaultdict(list)
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - s >= self.shortest:
                    p, found = self.scan(at[a + s : a + e].tolist(), s)
                    places += p
                    for which, own in found.items():
                        matches[which] += own
            spans = sorted((s, e, self.names[w], share) for w, own in matches.items() for s, e, share in self.chained(w, own))
            yield b - a, [(s, n, self.names[i]) for s, i, n in places], spans


_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])
_ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
_scanners: dict[str, Scanner] = {}


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], notices: dict[str, str | list[str]]) -> Iterator[pa.RecordBatch]:
    key = repr((phrases, notices))
    scanner = _scanners.setdefault(key, None) or Scanner(phrases, notices)
    _scanners[key] = scanner
    for batch in batches:
        texts = batch.column("_text").cast(pa.binary()).to_pylist()
        found = [x for lo, hi in pieces(texts) for x in scanner.texts(split_words(texts[lo:hi], ALNUM, lower=True))]
        places = [[{"first": s, "past": s + n, "label": label, "share": 1.0} for s, n, label in p] for _, p, _ in found]
        spans = [[{"first": s, "past": e, "label": label, "share": share} for s, e, label, share in x] for _, _, x in found]
        yield pa.RecordBatch.from_pydict({"_row": batch.column("_row"), "n_words": pa.array([n for n, _, _ in found], pa.int64()), "phrases": pa.array(places, _ARROW_SPANS), "spans": pa.array(spans, _ARROW_SPANS)})


def scan_licenses(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str | list[str]] | None = None) -> DataFrame:
    """The documents without their text, and ``n_words``, ``phrases`` and ``spans``: arrays of (first word, past last word,
    label, covered share of the template). ``notices`` has a template or several by label.

    * A null or empty text has no words, phrases or spans.
    * Overlapping places of phrases all count; repeated rows each have their own result.
    * An empty table gives an empty table. Input columns of the names of the results are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    if notices is None:
        notices = {k: [*([NOTICES[k]] if k in NOTICES else []), *LINES.get(k, ())] for k in [*NOTICES, *(k for k in LINES if k not in NOTICES)]}
    schema = T.StructType([row_field(docs, text_col), T.StructField("n_words", T.LongType()), T.StructField("phrases", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))])
    scanned = packed(docs, text_col).mapInArrow(lambda batches: _scan(batches, phrases, notices), schema)
    return unpacked(scanned, docs, text_col, None, n_words=F.col("n_words"), phrases=F.col("phrases"), spans=F.col("spans"))
