"""Licence scans: a suffix automaton of all licence templates reads the texts word by word.

1. The templates' words make one generalised suffix automaton. It is small and fixed, so every task builds it once.
2. A text is streamed through it. After each word the state and the match length say how many of the last words stand
   together in some template (matching statistics). A word pair that no template holds ends every match, so only the
   stretches between such pairs are walked.
3. Phrases are strings of the automaton too: one ends at a word when its state, or a state on the suffix links from there,
   is the phrase's. These places are exact.
4. Matches that cannot be extended, of MIN_MATCH words or more, are anchors (place in the text, place in the template). For each
   template anchors are chained in ascending order of both with gaps of at most GAP words; a chain covers a span. Spans that
   cover MIN_SHARE of their template stay; where spans of several templates lie on each other, the one that covers most
   words stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewise.llm import common
from zonewise.llm.decontaminate import words

MIN_MATCH, GAP, MIN_SHARE = 3, 12, 0.7

# Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public wording of licence notices and grants, by label. A year or a name is left out: gaps are allowed.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "released under the MIT License",
        "licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    ],
    "apache": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License",
    ],
    "gpl": [
        "this work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation",
    ],
    "agpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation",
    ],
    "bsd": [
        "licensed under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software",
    ],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": [
        "licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-nd": [
        "licensed under CC BY-ND 4.0",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "cc0": ["dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal Public Domain Dedication"],
}


class Automaton:
    """Generalised suffix automaton of number sequences; state 0 is the empty string."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].append((number, at + 1))
        # A state's string ends wherever those of the states that link to it end.
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that ``p`` reaches by ``c``, cut off where it holds longer strings than that."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def find(self, sequence: list[int]) -> int:
        state = 0
        for c in sequence:
            state = self.next[state][c]
        return state

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """After each number its state and the length of the longest match that ends there."""
        state = length = 0
        out = []
        for c in sequence:
            while c not in self.next[state] and state:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            out.append((state, length))
        return out


@dataclass
class Span:
    """Words first to behind (not included) of a text, of which ``covered`` match a template."""

    label: str
    template: int
    first: int
    behind: int
    covered: int
    share: float


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        sequences = [words(t.encode()) for texts in templates.values() for t in texts]
        known = [words(p.encode()) for p in phrases]
        self.number: dict[bytes, int] = {}
        coded = [[self.number.setdefault(w, len(self.number)) for w in s] for s in [*sequences, *known]]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(coded)
        self.pairs = np.zeros((len(self.number) + 1,) * 2, bool)
        for s in coded:
            self.pairs[s[:-1], s[1:]] = True
        # Where a phrase is a suffix of what a state holds: always below its own state, there from its length on.
        own: dict[int, list[tuple[int, str]]] = {}
        for s, label in zip(coded[len(sequences) :], phrases.values(), strict=True):
            own.setdefault(self.automaton.find(s), []).append((len(s), label))
        self.phrases: dict[int, list[tuple[int, str]]] = {}
        for v in sorted(range(1, len(self.automaton.next)), key=self.automaton.length.__getitem__):
            here = self.phrases.get(self.automaton.link[v], []) + own.get(v, [])
            if here:
                self.phrases[v] = here

    def scan(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, str]], list[Span]]]:
        """For each text the places of phrases (first word, label) and the spans of templates."""
        places: list[list[tuple[int, str]]] = [[] for _ in documents]
        anchors: list[list[tuple[int, int, int, int]]] = [[] for _ in documents]
        tokens = [w for d in documents for w in d]
        behind = np.cumsum([len(d) for d in documents])
        unknown = len(self.number)
        codes = np.fromiter((self.number.get(w, unknown) for w in tokens), np.int64, len(tokens))
        if len(codes) > 1:
            joined = self.pairs[codes[:-1], codes[1:]]
            cuts = behind[(behind > 0) & (behind < len(codes))]
            joined[cuts - 1] = False
            edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True):
                d = int(np.searchsorted(behind, a, side="right"))
                self._walk(codes[a:b].tolist(), a - (int(behind[d - 1]) if d else 0), places[d], anchors[d])
        return [(p, _settled(self._chained(a))) for p, a in zip(places, anchors, strict=True)]

    def _walk(self, stretch: list[int], offset: int, places: list, anchors: list) -> None:
        statistics = self.automaton.statistics(stretch)
        for i, (state, length) in enumerate(statistics):
            for size, label in self.phrases.get(state, ()):
                if length >= size:
                    places.append((offset + i + 1 - size, label))
            extended = i + 1 < len(statistics) and statistics[i + 1][1] > length
            if length >= MIN_MATCH and not extended:
                for template, end in self.automaton.ends[state]:
                    if template < len(self.sizes):
                        anchors.append((template, offset + i + 1 - length, end - length, length))

    def _chained(self, anchors: list[tuple[int, int, int, int]]) -> list[Span]:
        """Best chains of each template: ascending in text and template, gaps and overlaps allowed for."""
        spans = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for template, first, start, length in anchors:
            by_template.setdefault(template, []).append((first, start, length))
        for template, own in by_template.items():
            own.sort()
            covered, before = [], []
            for j, (first, start, length) in enumerate(own):
                best, via = length, -1
                for i in range(j - 1, -1, -1):
                    f, s, n = own[i]
                    if f + self.sizes[template] + GAP < first:
                        break
                    lap = max(0, f + n - first, s + n - start)
                    near = first - (f + n) <= GAP and start - (s + n) <= GAP
                    if f < first and s < start and near and lap < length and covered[i] + length - lap > best:
                        best, via = covered[i] + length - lap, i
                covered.append(best)
                before.append(via)
            used = [False] * len(own)
            for j in sorted(range(len(own)), key=lambda j: (-covered[j], own[j])):
                chain, i = [], j
                while i >= 0 and not used[i]:
                    chain.append(i)
                    i = before[i]
                if i >= 0:
                    continue
                for i in chain:
                    used[i] = True
                share = covered[j] / self.sizes[template]
                if share >= MIN_SHARE:
                    first, behind = own[chain[-1]][0], own[j][0] + own[j][2]
                    spans.append(Span(self.labels[template], template, first, behind, covered[j], min(1.0, share)))
        return spans


def _settled(spans: list[Span]) -> list[Span]:
    """Spans by first word; of those that share over half of the shorter one the one that covers most stays."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (-s.covered, -s.share, s.first, s.template)):
        if all(
            2 * (min(span.behind, o.behind) - max(span.first, o.first)) <= min(span.behind - span.first, o.behind - o.first)
            for o in out
        ):
            out.append(span)
    return sorted(out, key=lambda s: (s.first, s.template))


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner({label: list(texts) for label, texts in templates}, dict(phrases))


_PLACE = pa.struct([("first", pa.int64()), ("label", pa.string())])
_SPAN = pa.struct(
    [("label", pa.string()), ("first", pa.int64()), ("behind", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]
)
_SCHEMA = (
    "n_words bigint, places array<struct<first:bigint,label:string>>, "
    "spans array<struct<label:string,first:bigint,behind:bigint,covered:bigint,share:double>>"
)


def scan(
    docs: DataFrame,
    keep: list[str],
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """The columns ``keep`` as a struct (row), with n_words, the ``places`` of phrases and the ``spans`` of templates.

    Words are runs of letters, digits and characters beyond ASCII, A-Z as a-z. A null or empty text has none. Rows are read
    each on its own: repeated ones get equal results; an empty table gives an empty one, other columns are not touched.
    """
    common.prepare(docs.sparkSession)
    held = (
        tuple((k, tuple(v)) for k, v in (TEMPLATES if templates is None else templates).items()),
        tuple((PHRASES if phrases is None else phrases).items()),
    )
    given = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].cast("binary").alias("text"))
    row_type = given.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        documents = [words(t) for t in batch.column("text").to_pylist()]
        found = _scanner(*held).scan(documents)
        places = [[{"first": f, "label": label} for f, label in p] for p, _ in found]
        spans = [
            [{"label": s.label, "first": s.first, "behind": s.behind, "covered": s.covered, "share": s.share} for s in own]
            for _, own in found
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array([len(d) for d in documents], pa.int64()),
                pa.array(places, pa.list_(_PLACE)),
                pa.array(spans, pa.list_(_SPAN)),
            ],
            ["row", "n_words", "places", "spans"],
        )

    return common.over_batches(given, run, f"row {row_type}, {_SCHEMA}")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is the largest covered share of a template; a phrase, which is always covered whole, scores 1.
    """
    firsts, base, spans = F.col("places.first"), F.col("places.label"), F.col("spans.label")

    def named(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, spans)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
        "spans",
    )
