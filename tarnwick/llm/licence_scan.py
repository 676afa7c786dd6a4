"""Licence scan with a generalised suffix automaton over the tokens of licence templates.

The automaton recognises every run of tokens of every template.  Streaming a text through it gives the
matching statistics: the longest run that ends at each token and occurs in a template.  Long matches
are chained, in order both in the text and in the template, into spans that cover part of a template.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm import textkernel as tk

#: Notices and permission texts, by name.  Any other set of templates can be given instead.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-notice": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


class SuffixAutomaton:
    """Generalised suffix automaton; occurs[state] lists (template, end position) of the state's runs."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.occurs: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(texts):
            last = 0
            for pos, token in enumerate(text):
                last = self._extend(last, token)
                self.occurs[last].append((k, pos + 1))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.occurs[self.link[s]].extend(self.occurs[s])
        self.occurs[0] = []

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.occurs.append([])
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        own, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = own
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return own

    def matching_statistics(self, text: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run that ends at each token of text."""
        out, s, n = [], 0, 0
        for token in text:
            while s and token not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if token in self.next[s]:
                s, n = self.next[s][token], n + 1
            out.append((n, s))
        return out


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of matches (start in the text, start in the template, length) of one template.

    A chain grows in the text and in the template alike, with at most gap tokens of text between matches;
    it is the one of most tokens, then the one whose last match comes first, again and again among the
    matches outside the spans found; no chain goes over such a span.  A match only looks back as far as a
    predecessor may lie, and after a chain is taken only the matches that it may have served are solved
    again, so the work grows with the number of matches.
    """
    own = sorted(set(matches))
    starts, longest = [a for a, _, _ in own], max((n for _, _, n in own), default=0)
    best, back, alive = [0] * len(own), [-1] * len(own), [True] * len(own)
    ends: list[int] = []  # of the spans found, in order

    def solve(i: int) -> bool:
        a, b, n = own[i]
        k = bisect.bisect_right(ends, a)
        least = max(a - gap - longest, ends[k - 1] if k else 0)
        top, at, j = n, -1, i - 1
        while j >= 0 and starts[j] >= least:
            x, y, m = own[j]
            if alive[j] and x < a and y < b and a - (x + m) <= gap:
                over = max(0, x + m - a, y + m - b)
                value = best[j] + n - over
                if over < n and (value > top or value == top and at >= 0):
                    top, at = value, j
            j -= 1
        changed = (top, at) != (best[i], back[i])
        best[i], back[i] = top, at
        return changed

    for i in range(len(own)):
        solve(i)
    heap = [(-best[i], i) for i in range(len(own))]
    heapq.heapify(heap)
    out = []
    while heap:
        w, k = heapq.heappop(heap)
        if not alive[k] or -w != best[k]:
            continue
        chain = []
        while k >= 0:
            chain.append(own[k])
            k = back[k]
        chain.reverse()
        out.append(chain)
        first, last = chain[0][0], max(a + n for a, _, n in chain)
        for i in range(bisect.bisect_left(starts, first - longest), bisect.bisect_left(starts, last)):
            alive[i] &= own[i][0] + own[i][2] <= first
        bisect.insort(ends, last)
        reach, i = last + longest + gap, bisect.bisect_left(starts, last)
        while i < len(own) and starts[i] <= reach:
            if alive[i] and solve(i):
                reach = max(reach, starts[i] + own[i][2] + gap)
                heapq.heappush(heap, (-best[i], i))
            i += 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], min_match: int = 4, min_cover: float = 0.75, gap: int = 12):
        self.names = list(templates)
        self.min_match, self.min_cover, self.gap = min_match, min_cover, gap
        h, row = tk.token_hashes(pa.array(list(templates.values()), pa.string()), tk.ALNUM)
        self.vocabulary = tk.sorted_unique(h)
        ids = np.searchsorted(self.vocabulary, h)
        self.tokens = [ids[row == k].tolist() for k in range(len(self.names))]
        self.automaton = SuffixAutomaton(self.tokens)
        self.least = [min(min_match, len(t)) for t in self.tokens]
        self.grams = {n: tk.sorted_unique(np.concatenate([self._grams(h[row == k], n) for k, m in enumerate(self.least) if m == n])) for n in sorted(set(self.least) - {0})}

    def _grams(self, h: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(h) - n + 1)
        g = h[:m].copy()
        for k in range(1, n):
            g = g * np.uint64(0x9FB21C651E98DF25) + h[k : k + m]
        return g

    def spans(self, text: list[int], at: int) -> list[tuple[int, int, int, int]]:
        """(template, start, end, tokens covered) of all chains in a run of tokens that begins at position at."""
        stats = self.automaton.matching_statistics(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (n, s) in enumerate(stats):
            while s and n >= min(self.grams):  # shorter runs at this end may occur in more templates
                for k, end in self.automaton.occurs[s]:
                    if n < self.least[k] or (i + 1 < len(text) and end < len(self.tokens[k]) and self.tokens[k][end] == text[i + 1]):
                        continue  # too short for the template, or its occurrence goes on
                    found.setdefault(k, []).append((at + i + 1 - n, end - n, n))
                s = self.automaton.link[s]
                n = self.automaton.length[s]
        return [(k, a, b, n) for k, m in found.items() for a, b, n in m]

    def scan(self, col: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, template, start, end, tokens covered) of every span that covers enough of its template.

        Only runs of tokens that hold the shortest match of some template go through the automaton: no
        match lies elsewhere.
        """
        h, row = tk.token_hashes(col, tk.ALNUM)
        inside = np.zeros(len(h) + 1, np.int64)
        for n, grams in self.grams.items():
            g = self._grams(h, n)
            where = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            hit = np.flatnonzero((grams[where] == g) & (row[: len(g)] == row[n - 1 :])) if len(g) else np.zeros(0, np.int64)
            inside[hit] += 1
            np.subtract.at(inside, hit + n, 1)
        hit = np.flatnonzero(np.cumsum(inside)[:-1])
        if not len(hit):
            return []
        first = np.searchsorted(row, np.arange(len(col)))
        cut = np.flatnonzero(np.r_[True, (hit[1:] > hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1])])
        by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for a, b in zip(cut, np.r_[cut[1:], len(hit)]):
            start, end = int(hit[a]), int(hit[b - 1]) + 1
            r = int(row[start])
            for k, x, y, n in self.spans(np.searchsorted(self.vocabulary, h[start:end]).tolist(), start - int(first[r])):
                by.setdefault((r, k), []).append((x, y, n))
        out = []
        for (r, k), matches in sorted(by.items()):
            for chain in chains(matches, self.gap):
                covered = len({p for _, y, n in chain for p in range(y, y + n)})
                if covered >= self.min_cover * len(self.tokens[k]):
                    out.append((r, k, chain[0][0], max(a + n for a, _, n in chain), covered))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, min_match: int = 4, min_cover: float = 0.75, gap: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, start, end, covered, coverage) of every covered template span in every text.

    Tokens are runs of letters and digits, in lower case; start and end count tokens of the text, and
    coverage is the share of the template's tokens.  min_match is the shortest match (of a shorter
    template, its whole length), min_cover the least coverage, gap the most tokens of text between two
    matches of a span.  Spans of different templates may overlap.

    Defined cases: null and empty texts have no span; a very long text is scanned whole, with work that
    grows with its length; of chains of equal tokens the one that ends first is taken; a null id is carried
    as it is; repeated rows give repeated spans; an empty table, or no template, gives an empty result;
    other columns, whatever their names, are not read.  The automaton is broadcast; it has at most two
    states for each token of the templates, which the caller holds.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, min_match, min_cover, gap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, col in tk.slices(b.column(1)):
                found = s.scan(col)
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[at + r] for r, *_ in found], pa.int64()), pa.array([s.names[k] for _, k, *_ in found]),
                        pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.int32()),
                        pa.array([round(x[4] / len(s.tokens[x[1]]), 6) for x in found], pa.float64())],
                        ["doc_id", "licence", "start", "end", "covered", "coverage"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, licence string, start int, end int, covered int, coverage double")
