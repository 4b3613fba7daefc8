"""License scans: templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelf.llm import textbytes as tb

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license and notice wordings. ``[[...]]`` is optional; ``{{n}}`` stands for up to n words of any kind.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license [[,]] version 2.0 [[(the \"license\"); you may not use this file except in compliance with the license]]",
    "mit-notice": "[[released]] [[licensed]] under the mit license",
    "gpl-notice": "licensed under the gnu [[lesser]] [[affero]] general public license [[,]] [[version {{1}}]] [[or any later version]]",
    "gpl-free-software": "this program is free software [[:]] you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-notice": "licensed under [[a]] [[the]] cc by 4.0",
    "cc-by-sa-notice": "licensed under [[a]] [[the]] cc by-sa 4.0",
    "cc-by-nc-notice": "licensed under [[a]] [[the]] cc by-nc 4.0",
    "cc-by-nc-sa-notice": "licensed under [[a]] [[the]] cc by-nc-sa 4.0",
    "cc-by-nd-notice": "licensed under [[a]] [[the]] cc by-nd 4.0",
    "cc0-notice": "[[released]] [[dedicated to the public domain]] under cc0 [[1.0]] [[universal]]",
    "copyright-reserved": "copyright [[(c)]] {{12}} all rights reserved",
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "[[(the \"software\")]] to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions [[the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software]]"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution [[3]] [[neither the name of "
        "{{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission]]"
    ),
    "isc": (
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies"
    ),
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license [[,]] v [[.]] 2.0",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PIECE = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """States of a template: ``words[i]`` leads from state i to i + 1; ``gaps[i]`` = n words of any kind may be
    passed in state i; ``skips[i]`` are the states reached from i by leaving optional regions out."""

    def __init__(self, template: str):
        self.words: list[bytes] = []
        self.gaps: dict[int, int] = {}
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        optional: list[tuple[int, int]] = []
        for piece in _PIECE.findall(template.lower()):
            if piece == "[[":
                opened.append(len(self.words))
            elif piece == "]]":
                optional.append((opened.pop(), len(self.words)))
            elif piece.startswith("{{"):
                self.gaps[len(self.words)] = self.gaps.get(len(self.words), 0) + int(piece[2:-2])
            else:
                self.words.append(piece.encode())
        if opened or not self.words:
            raise ValueError(f"not a template: {template}")
        for start, end in optional:
            self.skips.setdefault(start, []).append(end)
        self.first = {self.words[i] for i, _ in self._closure({(0, 0)}) if i < len(self.words)}
        if any(i == len(self.words) for i, _ in self._closure({(0, 0)})):
            raise ValueError(f"a template needs a mandatory word: {template}")

    def _closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """``states`` (place, words passed in a gap) and what they reach without a word."""
        found, work = set(states), list(states)
        while work:
            at, _ = work.pop()
            for to in self.skips.get(at, ()):
                if (to, 0) not in found:
                    found.add((to, 0))
                    work.append((to, 0))
        return found

    def longest(self, word, start: int, stop: int) -> int:
        """Where the longest accepted run of words from ``start`` ends, or -1. ``word(i)`` gives word i < stop."""
        states, best = self._closure({(0, 0)}), -1
        for i in range(start, stop):
            w, then = word(i), set()
            for at, passed in states:
                if at < len(self.words) and self.words[at] == w:
                    then.add((at + 1, 0))
                if passed < self.gaps.get(at, 0):
                    then.add((at, passed + 1))
            states = self._closure(then)
            if not states:
                break
            if any(at == len(self.words) for at, _ in states):
                best = i + 1
        return best


def compiled(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in sorted(templates.items())}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every whole text.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. A template matches where
    its automaton accepts consecutive words from one place: mandatory words exactly, optional regions there or
    not, replaceable ones up to their length. ``spans`` has the label, first word and end (exclusive) of each
    longest match; every place is tried. n_base counts all places of the phrases, overlapping ones too. ``score``
    is the share of the text's words that phrases and matches cover. Null or empty texts have no words, no
    labels and score 0. Only doc_id and text are read; repeated rows give repeated rows.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        known = [(p.encode().split(), label) for p, label in phrases.items()]
        by_first: dict[bytes, list[str]] = {}
        for label, a in automata.items():
            for w in a.first:
                by_first.setdefault(w, []).append(label)
        starters = sorted({*by_first, *(p[0] for p, _ in known)})
        h = np.sort(np.array([tb.range_hash(tb.prefix_hash(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0] for w in starters], np.uint64))
        for batch in batches:
            rows = []
            for chunk in tb.chunks(batch.column("text")):
                rows += _scan_chunk(chunk, automata, known, by_first, h)
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [f.type for f in result][1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], [f.name for f in result]
            )

    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = [pa.field("doc_id", pa.null())] + [
        pa.field(n, t) for n, t in (
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span),
        )
    ]
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,end:long>>",
    )


def _scan_chunk(chunk: tb.Chunk, automata, known, by_first, starter_hashes) -> list[tuple]:
    data = tb.LOWER[chunk.data]
    start, end, text = tb.tokens(data, chunk.bounds, _WORD)
    h = tb.range_hash(tb.prefix_hash(data), start, end)
    place = np.minimum(np.searchsorted(starter_hashes, h), len(starter_hashes) - 1)
    hits = np.flatnonzero(starter_hashes[place] == h)
    first = np.searchsorted(text, np.arange(len(chunk) + 1))
    raw = data.tobytes()

    def word(i: int) -> bytes:
        return raw[start[i] : end[i]]

    found: dict[int, list[tuple[bool, str, int, int]]] = {}
    for i in hits.tolist():
        t = int(text[i])
        w, stop = word(i), int(first[t + 1])
        for parts, label in known:
            if w == parts[0] and i + len(parts) <= stop and all(word(i + k) == parts[k] for k in range(1, len(parts))):
                found.setdefault(t, []).append((True, label, i, i + len(parts)))
        for label in by_first.get(w, ()):
            to = automata[label].longest(word, i, stop)
            if to > 0:
                found.setdefault(t, []).append((False, label, i, to))
    rows = []
    for t in range(len(chunk)):
        zero, n = int(first[t]), int(first[t + 1] - first[t])
        own = found.get(t, [])
        base = [(label, a - zero) for is_base, label, a, _ in own if is_base]
        spans = [{"label": label, "first": a - zero, "end": b - zero} for is_base, label, a, b in own if not is_base]
        covered, reach = 0, 0
        for a, b in sorted((a - zero, b - zero) for _, _, a, b in own):
            covered += max(0, b - max(a, reach))
            reach = max(reach, b)
        rows.append((
            n, len(base), min((p for _, p in base), default=None), max((p for _, p in base), default=None),
            ",".join(sorted({x for x, _ in base})), ",".join(sorted({x[1] for x in own})), covered / n if n else 0.0, spans,
        ))
    return rows
