"""License scans by template markup.

A template is license wording with markup: <<optional>> ... <<end>> may be missing as a whole,
<<any a|b|c>> is one of these words, <<fill m-n>> is any m to n words (names, years).  Templates are
compiled into automata over words; a text is accepted where all mandatory wording stands exactly, in order.
Words are compared in lower case without punctuation.

Beside them, the base phrases are found wherever their words stand consecutively.  Null and empty texts
have no words and no labels.  Rows repeat as the input's do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, map_rows, table, text_bytes

# Base phrases and their labels.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

# Public license notices and texts as templates.
TEMPLATES = {
    "MIT": (
        "<<any released|licensed|distributed|available|provided>> under the <<optional>> terms of the <<end>> MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<fill 1-20>> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies""",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License <<optional>> Version <<end>> 2.0 <<optional>> (the License) <<end>>",
        "<<any released|licensed|distributed|available|provided>> under <<optional>> the terms of <<end>> <<optional>> the <<end>> Apache 2.0 License",
    ),
    "GPL": (
        "licensed under the <<optional>> terms of the <<end>> GNU General Public License <<optional>> version <<any 1|2|3>> <<end>>",
        "under the terms of the GNU <<optional>> <<any lesser|affero|library>> <<end>> General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""",
    ),
    "CC-BY": ("<<any licensed|released|available>> under <<optional>> a <<end>> <<any cc|creative>> <<optional>> commons <<end>> BY <<optional>> <<any nc|sa|nd>> <<end>> <<optional>> <<any nd|sa>> <<end>> <<any 1|2|3|4>> 0",),
}


def words_of(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


class Template:
    """steps[s]: (word set or None for any word, next state) and free[s]: states reached without a word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.steps: list[tuple[frozenset[bytes] | None, int] | None] = [None]
        self.free: list[list[int]] = [[]]
        self.must: set[bytes] = set()
        opened: list[int] = []
        state = 0
        for piece in re.split(r"(<<[^>]*>>)", markup):
            if not piece.startswith("<<"):
                for w in words_of(piece.encode()):
                    state = self._word(state, frozenset([w]))
                    if not opened:
                        self.must.add(w)
                continue
            kind, _, rest = piece[2:-2].partition(" ")
            if kind == "optional":
                state = self._empty(state)
                opened.append(state)
            elif kind == "end":
                state = self._empty(state)
                self.free[opened.pop()].append(state)
            elif kind == "any":
                state = self._word(state, frozenset(x.encode() for x in rest.split("|")))
            elif kind == "fill":
                low, high = map(int, rest.split("-"))
                for _ in range(low):
                    state = self._word(state, None)
                begin = [state]
                for _ in range(high - low):
                    state = self._word(state, None)
                    begin.append(state)
                end = self._empty(state)
                for s in begin[:-1]:
                    self.free[s].append(end)
                state = end
            else:
                raise ValueError(f"unknown markup {piece}")
        self.last = state
        reach = self.closure({0})
        if any(self.steps[s] and self.steps[s][0] is None for s in reach):
            raise ValueError("a template begins with wording")
        self.first = frozenset(w for s in reach if self.steps[s] for w in self.steps[s][0])

    def _word(self, state: int, words: frozenset[bytes] | None) -> int:
        state = self._empty(state) if self.steps[state] else state
        self.steps.append(None)
        self.free.append([])
        self.steps[state] = (words, len(self.steps) - 1)
        return len(self.steps) - 1

    def _empty(self, state: int) -> int:
        self.steps.append(None)
        self.free.append([])
        self.free[state].append(len(self.steps) - 1)
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def at(self, words: list[bytes], start: int) -> int:
        """Where the longest match from start ends, or -1."""
        states, end = self.closure({0}), -1
        for i in range(start, len(words)):
            states = self.closure({step[1] for s in states if (step := self.steps[s]) and (step[0] is None or words[i] in step[0])})
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end


def compiled(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Template]:
    return [Template(label, markup) for label, own in templates.items() for markup in own]


def scan_words(data: bytes, templates: list[Template]) -> tuple[int, list[int], set[str], list[tuple[str, int, int]]]:
    """Number of words, starts of base phrases, base labels, (label, start, end) of template matches."""
    words = words_of(data)
    plain = b" ".join(words).join((b" ", b" "))
    starts: list[int] = []
    labels: set[str] = set()
    for phrase, label in PHRASES:
        at = plain.find(b" " + phrase + b" ")
        word = last = 0  # words before last
        while at >= 0:
            word, last = word + plain.count(b" ", last, at), at
            starts.append(word)
            labels.add(label)
            at = plain.find(b" " + phrase + b" ", at + 1)
    found: list[tuple[str, int, int]] = []
    for t in templates:
        if all(b" " + w + b" " in plain for w in t.must):
            i = 0
            while i < len(words):
                if words[i] in t.first and (end := t.at(words, i)) > 0:
                    found.append((t.label, i, end))
                    i = end
                else:
                    i += 1
    return len(words), sorted(starts), labels, found


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end in words).

    score: 1 where a template is accepted, else 0.5 with a base phrase, else 0."""

    def make():
        own = compiled(templates)

        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for data in columns[1]:
                n, starts, base, found = scan_words(data, own)
                labels = base | {x[0] for x in found}
                row = (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)))
                for c, v in zip(out, (*row, 1.0 if found else 0.5 if base else 0.0, ",".join(f"{k}:{a}:{b}" for k, a, b in found)), strict=True):
                    c.append(v)
            return [columns[0], *out]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"
    return map_rows(docs.select("doc_id", text_bytes().alias("t")), make, ddl)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
