"""License scans: phrase places, and an exact containment join of word windows with license templates."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches
from barloom.llm.decontaminate import words_of

# Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("spdx:AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("spdx:Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("spdx:Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("spdx:BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("spdx:CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("spdx:CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("spdx:CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("spdx:CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("spdx:GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("spdx:GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("spdx:ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("spdx:LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("spdx:MIT", "Released under the MIT License"),
    ("spdx:MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("spdx:MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("spdx:Unlicense", "This is free and unencumbered software released into the public domain"),
]
PERCENT = 80  #: of a template's distinct words that a window must hold
SHORT = 8  #: a template of so many distinct words or fewer must be held whole
NAMES = {b"2", b"3", b"4", b"affero", b"apache", b"attribution", b"commons", b"creative", b"gnu", b"lesser", b"mit", b"mozilla", b"nc", b"noncommercial", b"public", b"sharealike", b"unencumbered"}  #: words that tell licenses apart: a window must hold those of its template
TURNS = {b"affero", b"lesser", b"nc", b"nd", b"noderivatives", b"noncommercial", b"sa", b"sharealike"}  #: words that turn a license into another one: a window ends before one that its template lacks
BASE_SCORE = 0.5  #: of a document with a phrase and no template

_LINES = [f" {p} ".encode() for p in PHRASES]


def template_sets() -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text.encode()))) for label, text in TEMPLATES]


class Index:
    """Templates with their words in global order, rarest first, and the prefix of each by word.

    A window of a template is a run of words of the text, over line ends, that is longer than the template by the share
    it may miss. It meets the template when it holds `need` of the n distinct words, all NAMES among them, and no TURNS
    but the template's. A text with such a window holds `need` of them itself, so with its own words in the same order:
    it has `need` words of the templates (length filter), one of the template's first n - need + 1 (prefix filter), and
    behind the first common word both have need - 1 more (positional filter). Only then are its windows read, once.
    """

    def __init__(self, counts: dict[bytes, int], percent: int = PERCENT):
        sets = template_sets()
        self.ranks = {w: i for i, w in enumerate(sorted(frozenset().union(*(words for _, words in sets)), key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.prefixes = [], {}
        for (label, words), (_, text) in zip(sets, TEMPLATES, strict=True):
            order = sorted(words, key=self.ranks.__getitem__)
            need = needed(len(order), percent)
            for place, w in enumerate(order[: len(order) - need + 1]):
                self.prefixes.setdefault(w, []).append((len(self.templates), place))
            self.templates.append((label, words, need, words & NAMES, TURNS - words, width_of(text, percent)))
        self.keys = frozenset(self.prefixes)

    def candidates(self, whole: set[bytes]) -> list[int]:
        """Templates that the filters leave for the distinct words of a text."""
        own = sorted(self.ranks.keys() & whole, key=self.ranks.__getitem__)
        found = set()
        for q, w in enumerate(own):
            for t, p in self.prefixes.get(w, ()):
                _, words, need, *_ = self.templates[t]
                if 1 + min(len(words) - p - 1, len(own) - q - 1) >= need:
                    found.add(t)
        return sorted(found)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label -> best containment of the templates that a window of the text meets."""
        found: dict[str, float] = {}
        whole = set(words)
        for t in self.candidates(whole):
            label, own, need, names, turns, width = self.templates[t]
            if names <= whole and len(own & whole) >= need:
                held = _best_window(words, own, names, turns, width)
                if held >= need:
                    found[label] = max(found.get(label, 0.0), held / len(own))
        return found


def needed(words: int, percent: int = PERCENT) -> int:
    """Distinct words of a template of so many that a window must hold."""
    return words if words <= SHORT else -(-percent * words // 100)


def width_of(template: str, percent: int = PERCENT) -> int:
    """Words of a template's window."""
    return -(-100 * len(words_of(template.encode())) // percent)


def _best_window(words: list[bytes], own: frozenset[bytes], names: frozenset[bytes], turns: frozenset[bytes], width: int) -> int:
    """The most distinct words of `own` in a run of `width` words that holds all `names` and no `turns`."""
    places, inside, best, first = [i for i, w in enumerate(words) if w in own or w in turns], Counter(), 0, 0
    for k, i in enumerate(places):
        if words[i] in turns:
            inside.clear()
            first = k + 1
            continue
        inside[words[i]] += 1
        while i - places[first] >= width:
            gone = words[places[first]]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            first += 1
        if len(inside) > best and all(w in inside for w in names):
            best = len(inside)
    return best


def _count(vocabulary: frozenset[bytes]):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def _places(words: list[bytes]) -> dict[str, list[int]]:
    line, found = b" " + b" ".join(words) + b" ", {}
    for phrase, label in zip(_LINES, PHRASES.values(), strict=True):
        at, seen, word = line.find(phrase), 0, 0
        while at >= 0:
            word, seen = word + line.count(b" ", seen, at), at
            found.setdefault(label, []).append(word)
            at = line.find(phrase, at + 1)
    return found


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                base, own = _places(words), {} if index.keys.isdisjoint(words) else index.matches(words)
                places = [p for x in base.values() for p in x]
                rows.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *own})), max(own.values(), default=BASE_SCORE if base else 0.0)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row
    for each input row.

    Base: all places where the words of a phrase stand consecutively. The method: blocks are windows of words sized to
    each template, which slide over line ends; a template's label is added when a window holds PERCENT of its distinct
    words (all of a template of SHORT words), its NAMES and no other TURNS; words are ordered by the number of times they stand in the
    texts, counted over all rows. score is the best containment, BASE_SCORE for a phrase alone, else 0. A null text is
    empty: no words, null places, empty labels. A very long text is read
    whole inside its row. Repeated rows give repeated results; ties of frequency are ordered by
    word; an empty table gives an empty result; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    vocabulary = frozenset().union(*(words for _, words in template_sets()))
    counts = rows.select("text").mapInArrow(_count(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    index = Index({bytes(r["word"]): r["n"] for r in counts.collect()})  # as many rows as the templates have words
    return rows.mapInArrow(_scan(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
