"""Licence scans by a generalised suffix automaton of licence words.

The automaton holds all substrings of all templates and phrases, word by word. A text streams through it once: after
each word it knows the longest run of words, ending there, that occurs in some template (the matching statistics). Runs
that cannot be extended and reach ``LEAST_MATCH`` words are chained, for each template, where they follow each other in the
text and in the template with small gaps. A run may stand at several places of a template, and each is tried: of all chains the one that
covers most words of the template is taken first, then the best one of what lies before or behind it, and so on. A chain that
covers enough of the template is a span of it. Phrases are found in the same pass: a phrase ends wherever the current run ends with it.

The automaton has a size given by the templates and is broadcast. Words outside the templates reset it, so that most words
of other texts cost one look into a dictionary.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. Words are numbered from 0.

Defined results: null and empty texts have no words, no labels and score 0. Repeated rows get the same result. A table
without rows gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import arrow_type, blocks

#: fixed values: the phrases and labels asked for
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: fixed values: notices as their issuers publish them
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions"
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied"
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"
    ),
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: words of the shortest run that counts, words that may lie between two chained runs, and the share of a template to be covered
LEAST_MATCH = 4
GAP = 10
LEAST_COVER = 0.5

#: bytes to word bytes: letters in lower case, everything that parts words to a space
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


@dataclass
class Automaton:
    """States of the suffix automaton of several word sequences.

    ``ends`` tells, for each state, behind which words of which template its runs end; ``phrases`` which phrases end there.
    """

    numbers: dict[bytes, int] = field(default_factory=dict)
    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[str, set[int]]] = field(default_factory=lambda: [{}])
    phrases: list[tuple[tuple[int, str], ...]] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, templates: Mapping[str, str], phrases: Mapping[str, str]) -> Automaton:
        a = cls()
        for name, text in templates.items():
            a.sizes[name] = a._add([a.numbers.setdefault(w, len(a.numbers)) for w in words_of(text)], name)
        for text in phrases:
            a._add([a.numbers.setdefault(w, len(a.numbers)) for w in words_of(text)], None)
        # longer runs hand their places on to the runs they end with
        for state in sorted(range(1, len(a.link)), key=lambda s: -a.length[s]):
            for name, ends in a.ends[state].items():
                a.ends[a.link[state]].setdefault(name, set()).update(ends)
        own: dict[int, list[tuple[int, str]]] = {}
        for text, label in phrases.items():
            state = 0
            numbers = [a.numbers[w] for w in words_of(text)]
            for n in numbers:
                state = a.follow[state][n]
            own.setdefault(state, []).append((len(numbers), label))
        found: list[tuple[tuple[int, str], ...]] = [()] * len(a.link)
        for state in sorted(range(1, len(a.link)), key=lambda s: a.length[s]):
            found[state] = found[a.link[state]] + tuple(own.get(state, ()))
        a.phrases = found
        return a

    def _add(self, numbers: list[int], name: str | None) -> int:
        last = 0
        for place, n in enumerate(numbers):
            last = self._extend(last, n)
            if name is not None:
                self.ends[last].setdefault(name, set()).add(place + 1)
        return len(numbers)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.follow.append(follow)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, state: int, n: int, target: int) -> int:
        """A state of its own for the runs of ``target`` that are no longer than what precedes them in ``state``."""
        twin = self._state(self.length[state] + 1, dict(self.follow[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.follow[state].get(n) == target:
            self.follow[state][n] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, n: int) -> int:
        target = self.follow[last].get(n)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, n, target)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and n not in self.follow[state]:
            self.follow[state][n] = new
            state = self.link[state]
        if state >= 0:
            target = self.follow[state][n]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, n, target)
        return new


@dataclass
class Found:
    n_words: int
    places: list[tuple[int, str]]
    spans: list[tuple[str, int, int, float]]


def runs(a: Automaton, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
    """Longest runs as (first word, words, state), and phrases as (first word, label)."""
    found, places = [], []
    state = size = 0
    follow, link, length, phrases = a.follow, a.link, a.length, a.phrases
    at = -1
    for place, n in [(i, n) for i, n in enumerate(map(a.numbers.get, words)) if n is not None]:
        if place != at + 1 and size:
            if size >= LEAST_MATCH:
                found.append((at + 1 - size, size, state))
            state = size = 0
        nxt = follow[state].get(n)
        if nxt is None:
            if size >= LEAST_MATCH:
                found.append((place - size, size, state))
            while state and nxt is None:
                state = link[state]
                nxt = follow[state].get(n)
            size = length[state]
        state, size, at = (nxt, size + 1, place) if nxt is not None else (0, 0, place)
        for width, label in phrases[state]:
            if width <= size:
                places.append((place + 1 - width, label))
    if size >= LEAST_MATCH:
        found.append((at + 1 - size, size, state))
    return found, places


Match = tuple[int, int, int, int]


def gain(before: Match, match: Match) -> int:
    """Words of the template that a match (first word, end, end in the template, words) adds to a chain that ends with ``before``; 0 if it may not follow."""
    start, end, place, size = match
    if end <= before[1] or place <= before[2] or start - before[1] > GAP or place - size - before[2] > GAP:
        return 0
    # words that both could claim count once
    return min(size, end - before[1], place - before[2])


def best_chain(matches: list[Match]) -> tuple[int, int, int]:
    """First word, end and covered words of the chain that covers most, of these the one that ends first (``matches`` by their ends)."""
    ends = [m[1] for m in matches]
    covered, first = [], []
    for start, end, place, size in matches:
        match, most, at = (start, end, place, size), size, start
        for i in range(bisect_left(ends, start - GAP), bisect_left(ends, end)):
            more = gain(matches[i], match)
            if more and covered[i] + more > most:
                most, at = covered[i] + more, first[i]
        covered.append(most)
        first.append(at)
    j = covered.index(max(covered))
    return first[j], ends[j], covered[j]


def apart(matches: list[Match]) -> Iterator[list[Match]]:
    """The matches (by their ends) in groups that neither overlap nor can be chained with each other."""
    ends = [m[1] for m in matches]
    low = []
    for j, m in enumerate(matches):
        after = bisect_right(ends, m[0])
        chained = (i for i in range(bisect_left(ends, m[0] - GAP), min(after, j)) if gain(matches[i], m))
        low.append(min(next(chained, j), after, j))
    stop = len(matches)
    for k in range(len(matches) - 1, -1, -1):
        low[k] = min(low[k], low[k + 1]) if k + 1 < len(matches) else low[k]
        # nothing from k on is tied to what stands before k
        if low[k] >= k:
            yield matches[k:stop]
            stop = k


def best_chains(matches: list[Match]) -> list[tuple[int, int, int]]:
    """Disjoint chains as (first word, end, covered words): the best one, then the best ones of what lies before and behind it."""
    found = []
    open_groups = list(apart(sorted(matches, key=lambda m: (m[1], m[2], m[0]))))
    while open_groups:
        group = open_groups.pop()
        first, end, covered = best_chain(group)
        found.append((first, end, covered))
        open_groups += [g for g in ([m for m in group if m[1] <= first], [m for m in group if m[0] >= end]) if g]
    return sorted(found)


def chains(a: Automaton, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans as (template, first word, behind the last word, share of the template that is covered)."""
    spans = []
    for name, whole in a.sizes.items():
        matches = [(start, start + size, end, size) for start, size, state in found for end in a.ends[state].get(name, ())]
        spans += [(name, first, end, min(1.0, covered / whole)) for first, end, covered in best_chains(matches)]
    return spans


def scan(a: Automaton, text: str) -> Found:
    words = words_of(text)
    found, places = runs(a, words)
    return Found(len(words), places, chains(a, found) if found else [])


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES
) -> DataFrame:
    """Phrases, labels, covered spans and score of each document.

    The score is 1 where a phrase occurs, else the largest share of a template that a span covers. ``spans`` lists the
    spans of covered templates as label:start:end in words, end exclusive.
    """
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(Automaton.build(templates, phrases))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        a = sent.value
        kinds = (id_arrow, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string())
        for rows, texts in blocks(batches, "_t"):
            out = []
            for (doc,), t in zip(rows, texts):
                f = scan(a, t)
                starts = [p for p, _ in f.places]
                base = {label for _, label in f.places}
                covered = sorted((s for s in f.spans if s[3] >= LEAST_COVER), key=lambda s: (s[1], s[0]))
                labels = base | {s[0] for s in covered}
                score = 1.0 if base else max((s[3] for s in f.spans), default=0.0)
                out.append((
                    doc, f.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                    score, ",".join(f"{n}:{s}:{e}" for n, s, e, _ in covered),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

    return slim.mapInArrow(run, f"doc_id {kind}, {SCHEMA}, spans string")
