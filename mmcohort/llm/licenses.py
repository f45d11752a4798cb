"""Operator 9: licence scans with a generalised suffix automaton.

The automaton holds every substring of the licence templates' words. A file
streams through it and gives, at each word, the longest template substring
ending there (matching statistics). Long maximal matches are chained along a
template to covered spans; a chain that covers enough of its template labels
the file. The base phrases are templates too: a phrase stands where its state
is the current one or above it by suffix links, at its full length.

The default templates are short opening passages or notices; whole licence
texts of any length go in by ``templates``. A passage that a template holds
several times keeps all its places there.

A match of two words or more consists of word pairs that stand in a template,
so only runs of such pairs are walked; all other words are passed in numpy.

Defined results: null or empty texts have no words and no label (score 0);
repeated rows get the same answer each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort.llm.text import ALNUM, hash_words, text_groups

# Phrases that always count, and opening passages of public
# licences (words only; case and punctuation do not matter).
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied."
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
}
MIN_MATCH = 4  # words of a match that takes part in a chain
MAX_GAP = 40  # words between two matches of a chain
MIN_COVER = 0.5  # share of a template that labels a file


def words_of(text: str) -> np.ndarray:
    return hash_words(np.frombuffer(text.encode(), np.uint8), ALNUM)[0]


class Automaton:
    """Generalised suffix automaton over token numbers."""

    def __init__(self, sequences: list[list[int]], least: int = 1):
        """``least``: places are kept for strings of so many tokens or more."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # template -> the places where the state's strings end
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._add(last, c)
                self.ends[last].setdefault(t, []).append(i)
        # places hold for all suffixes; suffixes shorter than any match are left out
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            if self.len[self.link[v]] >= least:
                up = self.ends[self.link[v]]
                for t, places in self.ends[v].items():
                    up.setdefault(t, []).extend(places)
        for places in self.ends:
            for t in places:
                places[t] = sorted(set(places[t]))

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier template has this prefix
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def walk(self, tokens) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each token."""
        v = n = 0
        nxt, link, length = self.next, self.link, self.len
        for c in tokens:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            yield v, n


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.labels, seqs = [], []
        for phrase, label in phrases.items():
            self.labels.append(label)
            seqs.append(words_of(phrase))
        self.n_phrases = len(seqs)
        for label, texts in templates.items():
            for x in texts:
                self.labels.append(label)
                seqs.append(words_of(x))
        self.vocab = np.unique(np.concatenate(seqs))
        ids = [np.searchsorted(self.vocab, s) for s in seqs]
        v = len(self.vocab)
        self.pair = np.zeros((v + 1, v + 1), bool)  # a last row and column for other words
        for s in ids:
            self.pair[s[:-1], s[1:]] = True
        self.size = [len(s) for s in ids]
        self.first = [int(s[0]) if len(s) else -1 for s in ids]
        self.single = [p for p in range(self.n_phrases) if self.size[p] == 1]
        self.auto = Automaton([s.tolist() for s in ids], MIN_MATCH)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocab & np.uint64(0xFFFF)] = True
        # phrases that end at a state: its own and those above it
        a = self.auto
        state = []
        for s in ids[: self.n_phrases]:
            x = 0
            for c in s:
                x = a.next[x][int(c)]
            state.append(x)
        self.phrases: list[list[int]] = [[] for _ in a.len]
        for x in sorted(range(len(a.len)), key=lambda x: a.len[x]):
            up = self.phrases[a.link[x]] if x else []
            self.phrases[x] = up + [p for p, y in enumerate(state) if y == x]

    def tokens(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.vocab), np.int64)
        pick = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        i = np.minimum(np.searchsorted(self.vocab, h[pick]), len(self.vocab) - 1)
        out[pick] = np.where(self.vocab[i] == h[pick], i, len(self.vocab))
        return out

    def scan(self, tok: np.ndarray):
        """(places of base phrases as (start, phrase), best chain as
        {template: (covered share, first word, last word)})."""
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # (last word, length, state), maximal
        pair = np.concatenate([[False], self.pair[tok[:-1], tok[1:]], [False]])
        edge = np.flatnonzero(pair[1:] != pair[:-1])
        for p in self.single:  # a phrase of one word is no pair
            places += [(int(j), p) for j in np.flatnonzero(tok == self.first[p])]
        for lo, hi in zip(edge[::2], edge[1::2]):
            prev = (0, 0)
            for j, (v, n) in enumerate(self.auto.walk(tok[lo : hi + 1].tolist()), int(lo)):
                for p in self.phrases[v]:
                    if 1 < self.size[p] <= n:
                        places.append((j - self.size[p] + 1, p))
                if n <= prev[1] and prev[1] >= MIN_MATCH:
                    matches.append((j - 1, prev[1], prev[0]))
                prev = (v, n)
            if prev[1] >= MIN_MATCH:
                matches.append((int(hi), prev[1], prev[0]))
        return places, self.chains(matches)

    def chains(self, matches) -> dict[int, tuple[float, int, int]]:
        """{template: (covered share, first word, last word)} of the best chain.
        A match goes on where its template's chain stands: at its first place
        behind the chain's last, if it comes within MAX_GAP words; else it begins
        a chain at its first place."""
        best: dict[int, tuple[float, int, int]] = {}
        live: dict[int, list] = {}  # template -> [covered words, first word, last word, last place in template]
        for j, n, v in matches:
            for t, places in self.auto.ends[v].items():
                if t < self.n_phrases:
                    continue
                c = live.get(t)
                i = bisect_right(places, c[3]) if c and j - n - c[2] <= MAX_GAP else len(places)
                if i < len(places):
                    e = places[i]
                    c[0] += min(n, e - c[3], j - c[2])
                    c[2], c[3] = j, e
                else:
                    c = live[t] = [n, j - n + 1, j, places[0]]
                share = min(1.0, c[0] / self.size[t])
                if share > best.get(t, (0.0, 0, 0))[0]:
                    best[t] = (share, c[1], c[2])
        return best


_SCHEMA = (
    "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, span_labels array<string>, span_first array<long>, span_last array<long>, span_cover array<double>"
)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: dict[str, list[str]] | None = None,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Per document: word and base-phrase counts, labels, score and the covered
    template spans (label, first and last word, share of the template)."""
    phrases = BASE_PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = _SCHEMA.format(id=src.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(phrases, templates)
        for b in batches:
            rows = []
            for _, _, t in text_groups(b.column(1), ALNUM):
                tok = s.tokens(t.hash)
                for i in range(len(t)):
                    places, chains = s.scan(tok[t.at[i] : t.at[i + 1]])
                    spans = sorted((s.labels[k], f, l, c) for k, (c, f, l) in chains.items() if c >= min_cover)
                    base = {s.labels[p] for _, p in places}
                    starts = [x for x, _ in places]
                    rows.append((
                        int(t.at[i + 1] - t.at[i]),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {x[0] for x in spans})),
                        1.0 if base else float(max((c for c, _, _ in chains.values()), default=0.0)),
                        *([x[k] for x in spans] for k in range(4)),
                    ))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                kinds += [pa.list_(x) for x in (pa.string(), pa.int64(), pa.int64(), pa.float64())]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    return src.mapInArrow(run, schema)
