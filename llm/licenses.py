"""License scan: exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow

# Phrases that name a license; short grants, and the notices that licenses ask for or consist of.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
_ISC = """Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"""
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        _MIT,
        _MIT
        + """ (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
        the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software.""",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "This work is licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "bsd": [
        _BSD,
        _BSD
        + """: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
    "isc": [
        _ISC,
        _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ],
}
#: Words that tell a license from its kin: of each group a block holds one phrase, its words one after
#: another. Without them GPL 2 holds enough of GPL 3, and CC BY-SA of CC BY-NC.
_VERSIONS = ("1", "2", "3", "4", "international", "license", "unported", "generic")
MARKS = {
    "mit": [("mit license", "this software and associated documentation files", "to deal in the software without restriction")],
    "apache-2": [("apache license version 2", "apache license v2", "apache license 2", "apache org licenses license 2", "apache org")],
    "cc-by-nc": [("cc by nc 4", *(f"attribution noncommercial {v}" for v in _VERSIONS), *(f"attribution non commercial {v}" for v in _VERSIONS))],
    "cc-by-sa": [("cc by sa 4", *(f"attribution sharealike {v}" for v in _VERSIONS), *(f"attribution share alike {v}" for v in _VERSIONS))],
    "gpl-3": [("gnu general public license",), ("version 3", "license v3", "license 3")],
    "bsd": [("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice")],
    "mpl-2": [("mozilla public license", "mozilla org mpl"), ("v 2", "version 2", "license 2", "mpl 2")],
    "isc": [("for any purpose with or without fee",)],
    "unlicense": [("unencumbered software", "publish use compile sell or distribute this software")],
}
#: Least share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words that a block may have beyond its template's: this share of them, and SLACK at least.
LONGER = 0.25
SLACK = 2

_WORDS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256))


def words(data: bytes) -> list[bytes]:
    """Words of lower-cased text: runs of digits, letters a-z and non-ASCII characters."""
    return data.translate(_WORDS).split()


@dataclass
class Template:
    """Distinct words, rarest first, how many of them a block must hold, and how many words a block has at most."""

    label: str
    tokens: tuple[bytes, ...]
    need: int
    width: int
    marks: list[list[tuple[bytes, ...]]]

    @property
    def sought(self) -> set[bytes]:
        return {w for group in self.marks for phrase in group for w in phrase}.union(self.tokens)

    def blocks(self, places: dict[bytes, list[int]]) -> Iterator[tuple[int, float]]:
        """(first word, containment) of the best block of each run of overlapping blocks that hold enough.

        A block is ``width`` words in a row, wherever the lines break, with a phrase of each of the marks.
        One that begins with a word of the template or its marks is enough: any other holds no more
        than the one that begins at its first such word.
        """
        marked = [sorted((first, first + len(phrase)) for phrase in group for first in _runs(phrase, places)) for group in self.marks]
        if not all(marked):
            return
        at = sorted((place, number) for number, token in enumerate(self.tokens) for place in places.get(token, ()))
        at = sorted(at + [(first, -1) for group in marked for first, _ in group])
        held, distinct, end = [0] * len(self.tokens), 0, 0
        best: tuple[int, int] | None = None
        last = 0
        for first, number in at:
            while end < len(at) and at[end][0] < first + self.width:
                if at[end][1] >= 0:
                    distinct += not held[at[end][1]]
                    held[at[end][1]] += 1
                end += 1
            if distinct >= self.need and all(_inside(group, first, first + self.width) for group in marked):
                if best and first >= last + self.width:
                    yield best[0], best[1] / len(self.tokens)
                    best = None
                if best is None or distinct > best[1]:
                    best = first, distinct
                last = first
            if number >= 0:
                held[number] -= 1
                distinct -= not held[number]
        if best:
            yield best[0], best[1] / len(self.tokens)


def _runs(phrase: tuple[bytes, ...], places: dict[bytes, list[int]]) -> list[int]:
    """Where the words of a phrase begin to stand one after another."""
    found = set(places.get(phrase[0], ()))
    for k, word in enumerate(phrase[1:], 1):
        found = found and found.intersection(p - k for p in places.get(word, ()))
    return sorted(found)


def _inside(spans: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether one of the sorted spans lies within [first, last)."""
    k = bisect_left(spans, (first, 0))
    while k < len(spans) and spans[k][0] < last:
        if spans[k][1] <= last:
            return True
        k += 1
    return False


@dataclass
class Index:
    """Templates, and which of them each prefix word opens."""

    templates: list[Template]
    opens: dict[bytes, list[tuple[int, int]]]

    def matches(self, own: list[bytes]) -> Iterator[tuple[str, int, float]]:
        """(label, first word, containment) of the blocks of a text that hold a template to the threshold."""
        held = set(own)
        best: dict[int, int] = {}
        for word in self.opens.keys() & held:
            for number, position in self.opens[word]:
                best[number] = min(position, best.get(number, position))
        found = []
        for number, position in best.items():
            t = self.templates[number]
            # Length filter: a text of fewer words can't hold enough. Positional filter: the words
            # before the first that matches are missing. Then the whole text is asked, then its blocks.
            if len(held) >= t.need and len(t.tokens) - position >= t.need and sum(w in held for w in t.tokens[position:]) >= t.need:
                found.append(t)
        if found:
            sought = set().union(*(t.sought for t in found))
            places: dict[bytes, list[int]] = {}
            for place, word in enumerate(own):
                if word in sought:
                    places.setdefault(word, []).append(place)
            for t in found:
                for first, containment in t.blocks(places):
                    yield t.label, first, containment


def index(frequency: dict[bytes, int], templates: dict[str, list[str]], least: float = CONTAINMENT, marks: dict[str, list[tuple[str, ...]]] = MARKS) -> Index:
    """Prefix index: of n words, o of which must be held, one of the n - o + 1 globally rarest is held."""
    made, opens = [], {}
    for label in sorted(templates):
        told = [[tuple(words(phrase.encode())) for phrase in group] for group in marks.get(label, [])]
        for text in templates[label]:
            own = words(text.encode())
            tokens = tuple(sorted(set(own), key=lambda w: (frequency.get(w, 0), w)))
            need = max(1, math.ceil(least * len(tokens) - 1e-9))
            for position, word in enumerate(tokens[: len(tokens) - need + 1]):
                opens.setdefault(word, []).append((len(made), position))
            made.append(Template(label, tokens, need, len(own) + max(SLACK, math.ceil(LONGER * len(own))), told))
    return Index(made, opens)


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of ``vocabulary``; one row for each word and task is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.update(vocabulary.intersection(words(value.encode("utf-8", "surrogatepass"))))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = map_arrow(docs.select(F.col(text).cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, list[str]] = TEMPLATES,
    least: float = CONTAINMENT,
    marks: dict[str, list[tuple[str, ...]]] = MARKS,
) -> DataFrame:
    """(ident, n_words, places array<struct<label, word>>, blocks array<struct<label, block, containment>>) of each row.

    places are where a phrase's words stand one after another; blocks are words in a row, about as many
    as a template has and across line breaks, that hold at least ``least`` of its distinct words and
    the label's ``marks``, by their first word. A null text is empty. Rows may repeat.
    Templates are a parameter, so their index is sent to every task; texts are not shuffled.
    """
    vocabulary = {w for texts in templates.values() for t in texts for w in words(t.encode())}
    known = index(frequencies(docs, vocabulary, text), templates, least, marks)
    named = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in sorted(phrases.items())]

    def found(value: str | None) -> tuple[int, list[dict], list[dict]]:
        data = (value or "").encode("utf-8", "surrogatepass")
        own = words(data)
        places, blocks = [], []
        joined = b" " + b" ".join(own) + b" "
        for phrase, label in named:
            at, before, word = joined.find(phrase), 0, 0
            while at >= 0:
                word, before = word + joined.count(b" ", before, at), at
                places.append({"label": label, "word": word})
                at = joined.find(phrase, at + 1)
        if not known.opens.keys().isdisjoint(own):
            blocks = [{"label": label, "block": first, "containment": c} for label, first, c in known.matches(own)]
        return len(own), sorted(places, key=lambda p: (p["word"], p["label"])), blocks

    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("block", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places, blocks = zip(*map(found, batch.column(1).to_pylist()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(blocks, block)], names=["id", "n_words", "places", "blocks"])

    kind = dict(docs.dtypes)[ident]
    schema = f"id {kind}, n_words long, places array<struct<label:string,word:long>>, blocks array<struct<label:string,block:long,containment:double>>"
    return map_arrow(docs.select(F.col(ident), F.col(text).cast("string")), run, schema).withColumnRenamed("id", ident)


def digest(scanned: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, n_words, n_base, first_word, last_word, base_labels, labels, score); the score is the best containment, a phrase's 1."""
    base = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "blocks.label")))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return scanned.select(
        ident,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
