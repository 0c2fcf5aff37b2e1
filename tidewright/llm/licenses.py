"""Licence scans by template-markup matching.

A template is wording with marked regions: ``<<opt>> … <<end>>`` may be left out, ``<<any:lo:hi>>`` stands for lo to hi words of any
kind. Each is compiled into an automaton over word hashes; a text is accepted where the mandatory wording stands exactly.
Automata run only from places where the first words of a template stand, which numpy finds in all texts of a slice at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<opt>> NONINFRINGEMENT <<end>> <<opt>> NON INFRINGEMENT <<end>> IN NO EVENT SHALL THE <<any:1:8>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<opt>> 1. <<end>>
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<opt>> 2. <<end>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version <<any:1:2>> of the License, or <<opt>> (at your option) <<end>> any later version"
#: Public licence notices. Every template begins with three mandatory words.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "isc-text": "Permission to use, copy, modify, and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": _BSD,
    "bsd-3-clause": _BSD + " <<opt>> 3. <<end>> Neither the name of <<any:1:12>> nor the names of <<any:1:6>> may be used to endorse or promote products derived from this software without <<opt>> specific <<end>> prior written permission.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the <<any:1:4>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<opt>> v <<end>> 2.0",
    "lgpl-notice": _GNU.format("Lesser"),
    "agpl-notice": _GNU.format("Affero"),
    "cc0-1.0": "To the extent possible under law, <<any:1:12>> waived all copyright and related or neighboring rights to",
    "cc-by-4.0": "is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<opt>> <<any:1:9>> <<end>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <<any:1:1>> of the License, or <<opt>> (at your option) <<end>> any later version",
    "apache-2.0": "Licensed under the Apache License <<opt>> , Version <<end>> 2.0",
    "gpl-3.0": "is licensed under the GNU General Public License <<opt>> , version <<end>> 3",
    "gpl-2.0": "is licensed under the GNU General Public License <<opt>> , version <<end>> 2",
    "mit-statement": "under the MIT License",
    "cc-by-nc": "Licensed under CC BY-NC <<opt>> <<any:1:2>> <<end>>",
}
#: Score of a text with a template, and of one with phrases only.
FULL, PARTIAL = 1.0, 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(opt|end|any:\d+:\d+)>>")
_CAPITALS = {c: c + 32 for c in range(0x41, 0x5B)}


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.translate(_CAPITALS))


def parse(template: str) -> list:
    """Words, ("any", lo, hi) and lists, which are optional."""
    stack: list[list] = [[]]
    for i, part in enumerate(_MARKUP.split(template)):
        if i % 2 == 0:
            stack[-1] += tokens(part)
        elif part == "opt":
            stack.append([])
        elif part == "end":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(("any", *map(int, part.split(":")[1:])))
    if len(stack) != 1 or not all(isinstance(x, str) for x in stack[0][:3]) or len(stack[0]) < 3:
        raise ValueError("a template has closed regions and begins with three words")
    return stack[0]


@dataclass
class Automaton:
    """steps[state]: word hash, or None for any word, and the next state; free[state]: next states that take no word."""

    anchor: list[int]
    steps: list[list[tuple[int | None, int]]]
    free: list[list[int]]

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[int]) -> int:
        """Words that the longest match from the first one on takes; 0 if none."""
        states, longest, final = self.closed({0}), 0, len(self.steps) - 1
        for k, w in enumerate(words):
            states = self.closed({t for s in states for v, t in self.steps[s] if v is None or v == w})
            if not states:
                break
            if final in states:
                longest = k + 1
        return longest

    @property
    def most(self) -> int:
        """Words that a match takes at most: no region repeats."""
        return len(self.steps)


def compile_template(template: str) -> Automaton:
    parts = parse(template)
    steps: list[list[tuple[int | None, int]]] = [[]]
    free: list[list[int]] = [[]]

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    def add(at: int, xs: list) -> int:
        for x in xs:
            if isinstance(x, str):
                new = state()
                steps[at].append((tn.hash_text(x), new))
                at = new
            elif isinstance(x, list):
                end = add(at, x)
                free[at].append(end)
                at = end
            else:
                leave = []
                for k in range(x[2]):
                    if k >= x[1]:
                        leave.append(at)
                    new = state()
                    steps[at].append((None, new))
                    at = new
                for s in leave:
                    free[s].append(at)
        return at

    end = add(0, parts)
    new = state()  # the final state is the last one
    free[end].append(new)
    return Automaton([tn.hash_text(x) for x in parts[:3]], steps, free)


def template_regex(template: str, words: bool = False) -> str:
    """The same language as a regular expression over words joined by single spaces, each followed by one (RE2 and Java)."""

    def of(xs: list) -> str:
        return "".join(re.escape(x) + " " if isinstance(x, str) else f"(?:{of(x)})?" if isinstance(x, list) else f"(?:[^ ]+ ){{{x[1]},{x[2]}}}" for x in xs)

    return " " + of(parse(template))


def _places(h: np.ndarray, owner: np.ndarray, wanted: list[int]) -> np.ndarray:
    at = np.flatnonzero(h == np.uint64(wanted[0]))
    at = at[at + len(wanted) <= len(h)]
    for j, w in enumerate(wanted[1:], 1):
        at = at[h[at + j] == np.uint64(w)]
    return at[owner[at] == owner[at + len(wanted) - 1]] if len(at) else at


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licence labels of each document: columns of SCHEMA plus ``spans``, the template matches as (label, first word, words).

    A null or empty text has no words, no labels and score 0; null ids stay; repeated rows are scanned each; other columns are
    ignored. One narrow pass without shuffles; the memory needed is that of one slice of texts.
    """
    look = [(label, [tn.hash_text(w) for w in tokens(p)]) for p, label in phrases.items()]
    automata = [(label, compile_template(t)) for label, t in templates.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in tn.slices(batch.column(1)):
                n = b - a
                buf = tn.lower_ascii(buf)
                start, end, first = tn.words(buf, at, tn.PUNCT)
                owner = tn.owners(first)
                h = tn.span_hash(tn.prefix_hash(buf), start, end)
                n_base, lo, hi = np.zeros(n, np.int64), np.full(n, len(h)), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, wanted in look:
                    p = _places(h, owner, wanted)
                    o = owner[p]
                    np.add.at(n_base, o, 1)
                    np.minimum.at(lo, o, p)
                    np.maximum.at(hi, o, p)
                    for i in np.unique(o):
                        base[i].add(label)
                spans: list[list[tuple]] = [[] for _ in range(n)]
                for label, auto in automata:
                    for p in _places(h, owner, auto.anchor):
                        i = owner[p]
                        if took := auto.accepts(h[p : min(first[i + 1], p + auto.most)].tolist()):
                            spans[i].append((label, int(p - first[i]), took))
                has = n_base > 0
                labels = [sorted(base[i] | {s[0] for s in spans[i]}) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        pa.array(np.diff(first)),
                        pa.array(n_base),
                        pa.array(np.where(has, lo - first[:-1], 0), mask=~has),
                        pa.array(np.where(has, hi - first[:-1], 0), mask=~has),
                        pa.array([",".join(sorted(x)) for x in base], pa.string()),
                        pa.array([",".join(x) for x in labels], pa.string()),
                        pa.array([FULL if s else PARTIAL if x else 0.0 for s, x in zip(spans, labels, strict=True)], pa.float64()),
                        pa.array([[{"label": x, "first": f, "words": k} for x, f, k in sorted(s)] for s in spans], _SPANS),
                    ],
                    names=[*(x.split()[0] for x in SCHEMA.split(", ")), "spans"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + ", spans array<struct<label:string,first:long,words:long>>")


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
