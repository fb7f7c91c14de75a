"""Licence scans with a generalised suffix automaton.

The automaton holds the word sequences of all templates.  A document's words are streamed
through it, which gives the matching statistics: at each word the longest match that ends
there.  Where a match stops growing it is an anchor; anchors of one template that advance
in both text and template are chained into a span, and a span that covers enough of its
template yields the template's label.  Base phrases are templates too: a phrase ends at a
word when the automaton's state there has the phrase as a suffix.

Cases: null text is empty; a document without words has no places and score 0; repeated
rows are scanned each; very long texts are streamed whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

# The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Notices as their licences state them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words a match needs to be an anchor (a shorter template needs all of its words).
ANCHOR_WORDS = 4
#: Words that may be skipped in text or template between chained anchors.
GAP_WORDS = 12
#: Share of a template that a span must cover.
COVERAGE = 0.8

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,stop:long,coverage:double>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())])))]
)


class SuffixAutomaton:
    """States of all substrings of several sequences, with the places where each state's strings end."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((which, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def walk(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], length + 1
        return 0, 0


class Scanner:
    def __init__(self, base: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], anchor: int, gap: int, coverage: float):
        self.anchor, self.gap, self.coverage = anchor, gap, coverage
        self.n_base = len(base)
        self.labels = [k for k, _ in [*base, *templates]]
        number: dict[int, int] = {}
        sequences = []
        for _, body in [*base, *templates]:
            raw, offs = T.flatten(pa.array([body], pa.string()))
            sequences.append([number.setdefault(h, len(number)) for h in T.word_hashes(raw, offs, T.ALNUM)[0].tolist()])
        self.sizes = [len(s) for s in sequences]
        vocabulary = np.array(list(number), np.uint64)
        by = np.argsort(vocabulary)
        self.vocabulary, self.codes = vocabulary[by], by
        self.automaton = a = SuffixAutomaton(sequences)
        whole = []
        for s in sequences[: self.n_base]:
            state = length = 0
            for symbol in s:
                state, length = a.walk(state, length, symbol)
            whole.append(state)
        self.base_at: list[list[int]] = []
        for state in range(len(a.next)):
            up, found = state, []
            while up > 0:
                found += [k for k, w in enumerate(whole) if w == up]
                up = a.link[up]
            self.base_at.append(found)
        self.shortest = min(self.sizes)

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Over a run of known words: base places as (start, phrase), anchors as (stop, length, state)."""
        walk, base_at, sizes = self.automaton.walk, self.base_at, self.sizes
        places, anchors = [], []
        state = length = 0
        for i, symbol in enumerate(codes):
            before, old = state, length
            state, length = walk(state, length, symbol)
            if length <= old and old >= self.shortest:
                anchors.append((i, old, before))
            for k in base_at[state]:
                if length >= sizes[k]:
                    places.append((i + 1 - sizes[k], k))
        if length >= self.shortest:
            anchors.append((len(codes), length, state))
        return places, anchors

    def chain(self, anchors: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of templates that chained anchors (stop, length, state) cover well enough."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for stop, length, state in anchors:
            for which, place in self.automaton.ends[state]:
                if which >= self.n_base and length >= min(self.anchor, self.sizes[which]):
                    by.setdefault(which, []).append((stop, place + 1, length))
        spans = []
        for which, pieces in by.items():
            pieces.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain that ends here, its first word
            for k, (stop, at, length) in enumerate(pieces):
                covered, start = length, stop - length
                for j in range(k - 1, -1, -1):
                    s2, a2, _ = pieces[j]
                    if stop - length - s2 > self.gap:
                        break
                    new = min(length, stop - s2, at - a2)
                    if new > 0 and at - length - a2 <= self.gap and best[j][0] + new > covered:
                        covered, start = best[j][0] + new, best[j][1]
                best.append((covered, start))
            held = None
            for (stop, _, _), (covered, start) in zip(pieces, best, strict=True):
                if covered >= self.coverage * self.sizes[which]:
                    if held and start < held["stop"]:
                        if covered / self.sizes[which] > held["coverage"]:
                            held.update(start=start, stop=stop, coverage=covered / self.sizes[which])
                    else:
                        held = {"label": self.labels[which], "start": start, "stop": stop, "coverage": covered / self.sizes[which]}
                        spans.append(held)
        return sorted(spans, key=lambda s: (s["start"], s["stop"], s["label"]))

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offs = T.flatten(batch.column(1))
        hashes, doc, _, _ = T.word_hashes(raw, offs, T.ALNUM)
        first = T.segment_ids(doc, batch.num_rows)
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[slot] == hashes)
        opens = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0))) if len(at) else np.zeros(0, np.int64)
        closes = np.append(opens[1:], len(at))
        keep = closes - opens >= self.shortest
        places: dict[int, list] = {}
        anchors: dict[int, list] = {}
        for a, b in zip(opens[keep].tolist(), closes[keep].tolist(), strict=True):
            d = int(doc[at[a]])
            shift = int(at[a] - first[d])
            p, m = self.stream(self.codes[slot[at[a:b]]].tolist())
            if p:
                places.setdefault(d, []).extend((s + shift, k) for s, k in p)
            if m:
                anchors.setdefault(d, []).extend((s + shift, n, q) for s, n, q in m)
        rows = []
        n_words = np.diff(first).tolist()
        for d, key in enumerate(batch.column(0).to_pylist()):
            p = places.get(d, [])
            spans = self.chain(anchors[d]) if d in anchors else []
            starts = [s for s, _ in p]
            mine = sorted({self.labels[k] for _, k in p})
            score = 1.0 if p else max((s["coverage"] for s in spans), default=0.0)
            rows.append((key, n_words[d], len(p), min(starts, default=None), max(starts, default=None), mine, sorted({*mine, *(s["label"] for s in spans)}), min(1.0, score), spans))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def scan_licenses(
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = tuple(BASE),
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    anchor: int = ANCHOR_WORDS,
    gap: int = GAP_WORDS,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Per document: words, base places with first and last start, labels, score and template spans (in words).

    The score is the largest share of a template that a span covers; a base place covers all of its phrase.
    """
    scanner = Scanner(base, templates, anchor, gap, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            yield scanner.scan(batch)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
