"""Licence scans by a generalised suffix automaton (operator 5).

All licence templates and phrases, as words, are the strings of one suffix automaton.
Files are streamed through it for matching statistics: at every word, the longest template
substring that ends there. Long maximal matches of one template, in its order and close
together, are chained into covered spans; a template covered far enough gives its label.
A phrase stands where the automaton's match is at least as long and has it as a suffix.

The automaton is a few hundred states and is built in each worker; files are scanned where
they lie, without a shuffle.

Defined cases: a null or empty text has no words, empty labels, score 0 and null places;
repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

#: Phrases whose places are counted, and their labels: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licences that name them, by label: fixed values.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
]
MIN_MATCH = 3
MAX_GAP = 6
MIN_COVER = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes from 0x80 on are those of other letters."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class _State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    where: dict[int, int] = field(default_factory=dict)  # template -> its first end place here
    phrases: tuple[tuple[int, int], ...] = ()  # (length, phrase), through suffix links


class Automaton:
    """A generalised suffix automaton over words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.strings = [(label, text.encode().split(), False) for label, text in templates]
        self.strings += [(label, text.encode().split(), True) for text, label in phrases.items()]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws, _ in self.strings for w in ws))}
        self.states = [_State(0, -1)]
        ends: dict[int, int] = {}
        for k, (_, ws, is_phrase) in enumerate(self.strings):
            last = 0
            for w in ws:
                last = self._extend(last, self.words[w])
            if is_phrase:
                ends[k] = len(ws)
        for k, (_, ws, _) in enumerate(self.strings):  # places, for every suffix of every prefix
            s = 0
            for at, w in enumerate(ws):
                s = self.states[s].next[self.words[w]]
                t = s
                while t > 0 and k not in self.states[t].where:
                    self.states[t].where[k] = at
                    t = self.states[t].link
        by_state: dict[int, list[tuple[int, int]]] = {}
        for k, n in ends.items():
            s = 0
            for w in self.strings[k][1]:
                s = self.states[s].next[self.words[w]]
            by_state.setdefault(s, []).append((n, k))
        for s in sorted(range(1, len(self.states)), key=lambda i: self.states[i].length):
            self.states[s].phrases = (*self.states[self.states[s].link].phrases, *by_state.get(s, ()))
        n = len(self.words)
        self.pairs = np.zeros((n + 1) * (n + 1), dtype=bool)  # two words that stand together somewhere
        for _, ws, _ in self.strings:
            for a, b in zip(ws, ws[1:], strict=False):
                self.pairs[self.words[a] * (n + 1) + self.words[b]] = True

    def _extend(self, last: int, c: int) -> int:
        states = self.states
        if c in states[last].next:
            q = states[last].next[c]
            if states[q].length == states[last].length + 1:
                return q
            return self._clone(last, q, c)
        cur = len(states)
        states.append(_State(states[last].length + 1, 0))
        p = last
        while p >= 0 and c not in states[p].next:
            states[p].next[c] = cur
            p = states[p].link
        if p >= 0:
            q = states[p].next[c]
            states[cur].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        states = self.states
        new = len(states)
        states.append(_State(states[p].length + 1, states[q].link, dict(states[q].next)))
        while p >= 0 and states[p].next.get(c) == q:
            states[p].next[c] = new
            p = states[p].link
        states[q].link = new
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word; -1 is no known word."""
        s = n = 0
        states = self.states
        for c in ids:
            while s and c not in states[s].next:
                s = states[s].link
                n = states[s].length
            if c in states[s].next:
                s, n = states[s].next[c], n + 1
            else:
                s = n = 0
            yield s, n


def scan(words: list[bytes], a: Automaton, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
    """Of one file: phrase places (start, phrase), and covered spans (template, first word,
    last word, share of the template)."""
    n = len(a.words)
    ids = np.fromiter(map(a.words.get, words, [n] * len(words)), dtype=np.int32, count=len(words))
    if len(ids) < 2 or not (hit := a.pairs[ids[:-1] * (n + 1) + ids[1:]]).any():
        return [], []
    places, matches = [], []
    inside = np.concatenate((hit, [False])) | np.concatenate(([False], hit))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        run = list(a.statistics([c if c < n else -1 for c in ids[start:stop].tolist()]))
        for k, (s, length) in enumerate(run):
            places += [(start + k - m + 1, p) for m, p in a.states[s].phrases if m <= length]
            if length >= min_match and (k + 1 == len(run) or run[k + 1][1] <= length):
                matches += [(t, start + k - length + 1, start + k, at - length + 1, at) for t, at in a.states[s].where.items() if not a.strings[t][2] and at + 1 >= length]
    spans = []
    for t in {m[0] for m in matches}:
        size = len(a.strings[t][1])
        chain: list[tuple[int, int, int, int]] = []

        def close(chain=chain, t=t, size=size):
            covered = len(set().union(*(range(m[2], m[3] + 1) for m in chain))) / size if chain else 0
            if covered >= min_cover:
                spans.append((t, chain[0][0], chain[-1][1], covered))
            chain.clear()

        for _, w0, w1, t0, t1 in sorted(m for m in matches if m[0] == t):
            if chain and (w0 - chain[-1][1] > max_gap or t1 <= chain[-1][3]):
                close()
            chain.append((w0, w1, t0, t1))
        close()
    return sorted(places), sorted(spans, key=lambda s: s[1:])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))])
_DDL = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>"


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """Counts, labels and spans of every row of ``docs`` (doc_id, text)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(templates, phrases)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                places, spans = scan(words, a, min_match, max_gap, min_cover)
                base = {a.strings[p][0] for _, p in places}
                row = (doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {a.strings[t][0] for t, *_ in spans})), 1.0 if base else max((s[3] for s in spans), default=0.0), [{"label": a.strings[t][0], "first": i, "last": j, "cover": c} for t, i, j, c in spans])
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _OUT], schema=_OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _DDL)
