"""License scans by template markup: optional and replaceable regions compiled into token automata.

Markup: ``[[ ... ]]`` may be missing (nesting allowed), ``{{name:least-most}}`` stands for so many
words of any kind (``#`` at its end: numbers only); all other words are mandatory and must stand exactly so, one after the other.
Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, so layout
and punctuation don't matter. A template is looked for at every place of a text, and the longest
reading from a place counts; readings of one template that end at the same word are one, from the
earliest place. A template may begin with replaceable regions, but needs a mandatory word.

Null and empty texts have no words and no labels. Repeated rows give repeated results; other
columns are not read. Each text is scanned where it lies, in time in proportion to its length; an
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license texts and notices, with their replaceable and optional parts marked.
TEMPLATES = (
    ("mit", "[[This {{thing:1-4}} is]] released under the [[terms of the]] MIT License"),
    ("mit", """[[MIT License]] [[Copyright [[c]] {{holder:1-12}}]] Permission is hereby granted, free of charge, to any person
     obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
     restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
     copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
     OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {{holders:1-6}} BE LIABLE
     FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
     CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "[[{{thing:0-4}} is]] licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{thing:1-3}} except in
     compliance with the License. You may obtain a copy of the License at {{place:1-8}}"""),
    ("gpl", "[[This {{thing:1-4}} is]] licensed under the [[terms of the]] GNU [[Lesser|Affero]] General Public License[[, version {{version:1-2#}}]] [[or later]]"),
    ("gpl", """This {{thing:1-3}} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
     as published by the Free Software Foundation[[, either version {{version:1-1#}} of the License, or (at your option) any later version]]"""),
    ("cc-by", "[[This {{thing:1-4}} is]] licensed under [[a]] CC BY {{version:1-2#}}"),
    ("cc-by-nc", "[[This {{thing:1-4}} is]] licensed under [[a]] CC BY-NC {{version:1-2#}}"),
    ("cc-by-sa", "[[This {{thing:1-4}} is]] licensed under [[a]] CC BY-SA {{version:1-2#}}"),
    ("cc-by-nd", "[[This {{thing:1-4}} is]] licensed under [[a]] CC BY-ND {{version:1-2#}}"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
     following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution.
     [[[[3.]] Neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote products derived
     from this software without specific prior written permission.]]
     THIS SOFTWARE IS PROVIDED BY {{holders:1-12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
     IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holders:1-12}}
     BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
     PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
     THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
     OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
     that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
     {{holders:1-8}} [[DISCLAIMS|DISCLAIM]] ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
     MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{holders:1-8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
     DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
     OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "[[Copyright [[c]] {{holder:1-8}}]] All rights reserved"),
)

_MARKUP = re.compile(r"\[\[|\]\]|\||\{\{[a-z]+:\d+-\d+#?\}\}|[^\[\]|{}]+")


#: Kind of step that takes any number; words never hold a blank.
NUMBER = " number"


class Automaton:
    """The word automaton of one template; sets of states are made into one state when first met."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.steps: list[dict[str | None, set[int]]] = []
        self.free: list[set[int]] = []
        self.pieces = _MARKUP.findall(markup)
        self.at = 0
        start = self._state()
        end = self._choice(start)
        if self.at != len(self.pieces):
            raise ValueError(f"unbalanced markup in the template for {label}")
        self.end, self.known = end, {}
        self.start = self._reach({start})
        self._anchor()

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _step(self, a: int, word: str | None) -> int:
        b = self._state()
        self.steps[a].setdefault(word, set()).add(b)
        return b

    def _choice(self, a: int) -> int:
        """Alternatives between bars, up to a closing bracket or the end."""
        ends = [self._run(a)]
        while self.at < len(self.pieces) and self.pieces[self.at] == "|":
            self.at += 1
            ends.append(self._run(a))
        join = self._state()
        for e in ends:
            self.free[e].add(join)
        return join

    def _run(self, a: int) -> int:
        while self.at < len(self.pieces) and self.pieces[self.at] not in ("|", "]]"):
            piece = self.pieces[self.at]
            self.at += 1
            if piece == "[[":
                inner = self._state()
                self.free[a].add(inner)
                b = self._choice(inner)
                if self.at == len(self.pieces):
                    raise ValueError("a bracket is not closed")
                self.at += 1
                self.free[a].add(b)
                a = b
            elif piece.startswith("{{"):
                kind, span = NUMBER if piece.endswith("#}}") else None, piece[2:-2].rstrip("#").split(":")[1]
                least, most = map(int, span.split("-"))
                end = self._state()
                for k in range(most + 1):
                    if k >= least:
                        self.free[a].add(end)
                    if k < most:
                        a = self._step(a, kind)
                a = end
            else:
                for word in WORD.findall(piece.lower()):
                    a = self._step(a, word)
        return a

    def _reach(self, states: set[int]) -> frozenset[int]:
        found, open_ = set(states), list(states)
        while open_:
            for s in self.free[open_.pop()] - found:
                found.add(s)
                open_.append(s)
        return frozenset(found)

    def _anchor(self) -> None:
        """First mandatory words, how many words may stand before them, and the states after them.

        Every reading holds such a word, so only their places in a text are looked at.
        """
        self.before: dict[str, list[int]] = {}
        after: dict[str, set[int]] = {}
        states, before = self.start, 0
        while states:
            if self.end in states:
                raise ValueError(f"the template for {self.label} needs a mandatory word")
            for word in {w for s in states for w in self.steps[s]} - {None, NUMBER}:
                self.before.setdefault(word, []).append(before)
                after.setdefault(word, set()).update(t for s in states for t in self.steps[s].get(word, ()))
            states = self._reach({t for s in states for kind in (None, NUMBER) for t in self.steps[s].get(kind, ())})
            before += 1
        self.after = {word: self._reach(found) for word, found in after.items()}

    def _next(self, states: frozenset[int], word: str) -> frozenset[int]:
        key = (states, word if any(word in self.steps[s] for s in states) else None, word.isdigit())
        if key not in self.known:
            kinds = {key[1], None} | ({NUMBER} if key[2] else set())
            self.known[key] = self._reach({t for s in states for k in kinds for t in self.steps[s].get(k, ())})
        return self.known[key]

    def _walk(self, states: frozenset[int], words: list[str], at: int) -> int:
        best = at if self.end in states else -1
        for i in range(at, len(words)):
            states = self._next(states, words[i])
            if not states:
                break
            if self.end in states:
                best = i + 1
        return best

    def longest(self, words: list[str], start: int) -> int:
        """End of the longest reading from ``start``, or -1."""
        return self._walk(self.start, words, start)

    def around(self, words: list[str], i: int) -> Iterator[tuple[int, int]]:
        """Longest readings (start, end) from each place where word ``i`` can be the first mandatory one."""
        word = words[i]
        if self._walk(self.after[word], words, i + 1) < 0:
            return
        for start in (i - k for k in self.before[word] if k <= i):
            if (end := self.longest(words, start)) >= 0:
                yield start, end


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.by_first: dict[str, list[tuple[bool, object]]] = {}
        for words, label in self.phrases:
            self.by_first.setdefault(words[0], []).append((True, (words, label)))
        for label, markup in templates:
            made = Automaton(label, markup)
            for word in made.before:
                self.by_first.setdefault(word, []).append((False, made))

    def scan(self, words: list[str]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int]]]:
        """Places of phrases (label, start) and readings of templates (label, start, end)."""
        base: list[tuple[str, int]] = []
        found: dict[tuple[Automaton, int], int] = {}
        for i in [i for i, w in enumerate(words) if w in self.by_first]:
            for is_phrase, what in self.by_first[words[i]]:
                if is_phrase:
                    if words[i:i + len(what[0])] == what[0]:
                        base.append((what[1], i))
                else:
                    for start, end in what.around(words, i):
                        found[what, end] = min(start, found.get((what, end), start))
        return base, sorted(((a.label, start, end) for (a, end), start in found.items()), key=lambda f: (f[1], f[2], f[0]))


RESULT = "doc_id long, n_words long, base array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long>>"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
])


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, base (places of phrases), matches (of templates), in words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = WORD.findall(body or "")
                base, found = scanner.scan(words)
                rows.append({
                    "doc_id": key, "n_words": len(words), "base": [{"label": a, "start": i} for a, i in base],
                    "matches": [{"label": a, "start": i, "end": j} for a, i, j in found]})
            yield pa.RecordBatch.from_pylist(rows, _RESULT)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), lower_ascii(F.col(text)).alias("text"))
    return source.mapInArrow(scan, RESULT)


def report(docs: DataFrame) -> DataFrame:
    """Labels and places per document; the score is 1 if a template is met, 0.5 if only a phrase is."""
    found = find_licenses(docs)
    starts = F.transform("base", lambda b: b["start"])
    own = F.transform("base", lambda b: b["label"])
    every = F.concat(own, F.transform("matches", lambda m: m["label"]))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(own).alias("base_labels"), listed(every).alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_matches"))
