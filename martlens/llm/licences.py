"""Licence texts in documents, by a suffix automaton of licence templates.

The automaton holds every run of words of every template. A document is read
through it word by word; at each word the automaton knows the longest run that
ends there and occurs in a template (matching statistics). Runs that cannot be
lengthened are anchored at all places of the templates where they occur, and
anchors that follow each other in the document and in a template are chained
into spans.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlens.llm.store import ship
from martlens.llm.words import _blocks, _segments, word_hashes

#: (phrase, label): a place where the words of a phrase stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening words of public licences and usual one-line notices.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
)

#: Least words of an anchor; words that anchors of a chain may lie apart.
ANCHOR_WORDS, GAP_WORDS = 3, 20
#: A chain is a span if it covers this share of its template, or so many words.
SPAN_SHARE, SPAN_WORDS = 0.9, 16

# Words are runs of 0-9, A-Z, a-z and bytes above 127; the rest stands between them.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

Span = tuple[int, int, int, int]  # template, first word, last word, words covered


def _words_of(text: str) -> list[bytes]:
    data = text.encode()
    marked = bytes(32 if _BETWEEN[b] else b for b in data).lower()
    return marked.split()


class Automaton:
    """Generalised suffix automaton of several sequences of numbers.

    ``places[state]`` are the (sequence, last place) at which the state's runs
    end; ``whole[state]`` are the sequences that are suffixes of its runs.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        wholes: list[list[int]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extended(last, word)
                while len(ends) < len(self.step):
                    ends.append([])
                    wholes.append([])
                ends[last].append((number, place))
            if sequence:
                wholes[last].append(number)
        by_length = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for state in reversed(by_length):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        for state in by_length:
            wholes[state] = wholes[self.link[state]] + wholes[state]
        self.places = [sorted(set(e)) for e in ends]
        self.whole = [tuple(w) for w in wholes]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the runs of ``target`` that are one word longer than ``state``'s."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.step[state][word])
        return new

    def read(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run that ends at each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            yield state, length


class Chains:
    """Chains of anchors of one document, per template."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.sizes = sizes
        self.open: dict[int, list[tuple[int, int, int, int]]] = {}
        self.found: list[Span] = []

    def add(self, template: int, first: int, last: int, t_last: int) -> None:
        """An anchor; anchors come in the order of their last words.

        Chains end within GAP_WORDS before it or inside it, so the number of
        those looked at is bounded by the templates, not by the document.
        """
        size = last - first + 1
        held = self.open.setdefault(template, [])
        held[:] = [c for c in held if c[0] >= first - GAP_WORDS - 1]
        best, start = size, first
        for end, t_end, covered, began in held:
            new = min(size, last - end, t_last - t_end)
            if new > 0 and began < first and covered + new > best:
                best, start = covered + new, began
        held.append((last, t_last, best, start))
        if best >= SPAN_WORDS or best >= SPAN_SHARE * self.sizes[template]:
            self.found.append((template, start, last, best))

    def spans(self) -> list[Span]:
        """Spans that do not overlap; of those that do, the one that covers most words."""
        taken: list[tuple[int, int, int, int]] = []
        for template, first, last, covered in sorted(
            self.found, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])
        ):
            at = bisect_left(taken, (first,))
            free = (at == len(taken) or taken[at][0] > last) and (
                at == 0 or taken[at - 1][1] < first
            )
            if free:
                insort(taken, (first, last, template, covered))
        return [(template, first, last, covered) for first, last, template, covered in taken]


@dataclass(frozen=True)
class Found:
    n_words: int
    base: list[tuple[int, int]]  # (first word, phrase)
    spans: list[Span]
    longest: int


class Scanner:
    """Phrases and templates, and the automaton of both."""

    def __init__(
        self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES
    ) -> None:
        self.phrases, self.templates = tuple(phrases), tuple(templates)
        texts = [_words_of(text) for text, _ in phrases] + [_words_of(text) for _, text in templates]
        self.sizes = [len(words) for words in texts]
        self.vocabulary = sorted({word for words in texts for word in words})
        number = {word: i for i, word in enumerate(self.vocabulary)}
        sequences = [[number[word] for word in words] for words in texts]
        self.automaton = Automaton(sequences)
        hashes = [word_hashes(word, _BETWEEN)[0][0] for word in self.vocabulary]
        self.order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[self.order]
        n = len(self.vocabulary)
        # Whether two words follow each other in a text; number n is any other word.
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for words in sequences:
            self.pairs[words[:-1], words[1:]] = True

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), n - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], n).astype(np.int32)

    def _is(self, data: bytes, start: int, number: int) -> bool:
        """Whether the word at ``start`` is that word, and not only of the same hash."""
        word = self.vocabulary[number]
        end = start + len(word)
        return data[start:end].lower() == word and (end == len(data) or _BETWEEN[data[end]])

    def _text(self, data: bytes, numbers: np.ndarray, starts: np.ndarray) -> Found:
        """What stands in one text. Runs of one word matter to nothing, so the
        automaton reads on from each pair of words that some template has."""
        base: list[tuple[int, int]] = []
        chains, longest = Chains(self.sizes), 0
        paired = self.pairs[numbers[:-1], numbers[1:]] if len(numbers) > 1 else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(paired, prepend=False, append=False)).tolist()
        if not edges and (numbers < len(self.vocabulary)).any():
            longest = 1
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            run = numbers[low : high + 1].tolist()
            for i, word in enumerate(run):
                if not self._is(data, int(starts[low + i]), word):
                    run[i] = -1
            before = (0, 0)
            for i, (state, length) in enumerate(self.automaton.read(run), low):
                for phrase in self.automaton.whole[state]:
                    if phrase < len(self.phrases) and length >= self.sizes[phrase]:
                        base.append((i - self.sizes[phrase] + 1, phrase))
                if length <= before[1]:
                    self._anchor(chains, i - 1, *before)
                before, longest = (state, length), max(longest, length)
            self._anchor(chains, high, *before)
        return Found(len(numbers), base, chains.spans(), longest)

    def _anchor(self, chains: Chains, last: int, state: int, length: int) -> None:
        if length >= ANCHOR_WORDS:
            for text, place in self.automaton.places[state]:
                if text >= len(self.phrases):
                    chains.add(text, last - length + 1, last, place)

    def scan(self, texts: Iterable[str | None]) -> Iterator[Found]:
        for block in _blocks(texts):
            if len(block) == 1:
                # A long text alone: its words are hashed part by part.
                numbers, starts, at = [], [], 0
                for part in _segments(block[0], _BETWEEN):
                    hashes, places = word_hashes(part, _BETWEEN)
                    numbers.append(self._numbers(hashes))
                    starts.append(places + at)
                    at += len(part)
                yield self._text(block[0], np.concatenate(numbers), np.concatenate(starts))
                continue
            data = b"\n".join(block)
            hashes, starts = word_hashes(data, _BETWEEN)
            numbers = self._numbers(hashes)
            ends = np.cumsum([len(text) + 1 for text in block])
            bounds = [0, *np.searchsorted(starts, ends).tolist()]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                yield self._text(data, numbers[low:high], starts[low:high])


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(phrases, templates)


_SPAN = pa.struct(
    [("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()),
     ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]
)
_SPAN_DDL = (
    "array<struct<label string, template int, first_word long, last_word long, "
    "covered long, share double>>"
)


def scan_licences(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """Licence phrases and spans of licence templates in each whole text.

    ``phrases`` are (words, label), ``templates`` (label, text); both go into
    one automaton. Returns one row per document: doc_id; n_words; n_base, all
    places of phrases; first_word and last_word, their smallest and largest
    first word (NULL without any); base_labels; labels, with those of the
    spans; score, the largest share of a template that a span covers, a phrase
    counting as a whole one; longest_match, the longest run of words of any
    template; spans. A document is read on its own, in a few megabytes plus
    its text, so any number of documents and any length will do.

    A null or empty text has no words, no labels (empty strings) and score 0.
    Null and repeated ids are rows of their own. Other columns are not read.
    """
    ship(docs.sparkSession)
    phrases, templates = tuple(map(tuple, phrases)), tuple(map(tuple, templates))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "longest_match", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(_SPAN)]
    ddl = ["long"] * 4 + ["string"] * 2 + ["double", "long", _SPAN_DDL]

    def row(scanner: Scanner, found: Found) -> tuple:
        places = [place for place, _ in found.base]
        base = {phrases[phrase][1] for _, phrase in found.base}
        spans = []
        for text, first, last, covered in found.spans:
            template = text - len(phrases)
            share = covered / scanner.sizes[text]
            spans.append(
                {"label": templates[template][0], "template": template, "first_word": first,
                 "last_word": last, "covered": covered, "share": share}
            )
        labels = base | {span["label"] for span in spans}
        score = 1.0 if base else max((span["share"] for span in spans), default=0.0)
        ends = (min(places), max(places)) if places else (None, None)
        return (
            found.n_words, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)),
            score, found.longest, spans,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, templates)
        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            columns = list(zip(*(row(scanner, found) for found in scanner.scan(texts)), strict=True))
            columns = columns or [()] * len(names)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    schema = f"doc_id {kind}, " + ", ".join(f"{n} {d}" for n, d in zip(names, ddl, strict=True))
    return docs.select("doc_id", "text").mapInArrow(read, schema)
