"""Licence scan: a generalised suffix automaton over the words of licence templates.

Each text streams through the automaton once, which gives its matching statistics: at
each word the longest run ending there that occurs in any template. Runs that no longer
run extends and that have ``min_match`` words are matches; those of one template that
follow each other in text and template, at most ``max_gap`` words apart, are chained,
and a chain's covered words make a span of the template. Short phrases are templates
that must occur in full; they are found as suffixes of the current run. The automaton
reads only stretches of words that the templates know (the others lead back to its
start), which numpy finds by the words' hashes; in a stretch words are compared as bytes.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.common import U64, ByteHash, row_slices, text_groups
from lendspark.session import ensure_checkpoint_dir

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# fixed values: phrases of the contract, then the wording of public licences and notices
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def word_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of digits, letters and bytes beyond ASCII."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], WORD[data], [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def words_of(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode() or b" ", np.uint8)]
    return [data[s:e].tobytes() for s, e in zip(*word_runs(data))]


class TemplateAutomaton:
    """Suffix automaton of several word sequences, each read from the start state."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}      # state -> (template, words read)
        texts = [words_of(t) for _, t in [*templates, *phrases]]
        if not all(texts):
            raise ValueError("a template has no words")
        self.labels = [name for name, _ in templates]
        self.sizes = [len(t) for t in texts[:len(templates)]]
        for t, seq in enumerate(texts):
            state = 0
            for k, w in enumerate(seq):
                state = self._extend(state, w)
                if t < len(templates):
                    ends.setdefault(state, []).append((t, k + 1))
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in self.link]
        for (name, _), seq in zip(phrases, texts[len(templates):]):
            state = 0
            for w in seq:
                state = self.next[state][w]
            self.phrases[state].append((name, len(seq)))
        order = sorted(range(1, len(self.link)), key=self.size.__getitem__)
        for s in order:                                  # phrases that end every run of the state
            self.phrases[s] = self.phrases[s] + self.phrases[self.link[s]]
        self.ends: list[list[tuple[int, int]]] = [ends.get(s, []) for s in range(len(self.link))]
        for s in reversed(order):                        # where the runs of a state end
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.known = sorted({w for seq in texts for w in seq})

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        q = nxt[last].get(w)
        if q is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        state = len(link)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[state] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return state

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        state = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = state
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = state
            p = link[p]
        return state

    def statistics(self, words):
        """(state, matched length) after each word."""
        state, length = 0, 0
        for w in words:
            go = self.next[state].get(w)
            while go is None and state:
                state = self.link[state]
                length = self.size[state]
                go = self.next[state].get(w)
            if go is None:
                length = 0
            else:
                state, length = go, length + 1
            yield state, length


def chain(matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """Best chains (text start, text end, words covered) of one template that do not
    overlap in the text, the most covering first. ``matches``: (text start, template
    start, words) by text start. Links look back ``max_gap`` words, so the work is linear."""
    value, begin, best = [], [], []
    low = 0
    for i, (d, t, n) in enumerate(matches):
        while low < i and matches[low][0] + matches[low][2] < d - max_gap:
            low += 1
        v, b = n, d
        for j in range(low, i):
            e, u, m = matches[j]
            if e < d and u < t and u + m < t + n and e + m >= d - max_gap:
                more = value[j] + n - max(0, e + m - d, u + m - t)
                if more > v:
                    v, b = more, begin[j]
        value.append(v)
        begin.append(b)
        best.append((-v, b, d + n))
    taken: list[tuple[int, int]] = []
    out = []
    for v, b, e in sorted(best):
        at = bisect_left(taken, (b, b))
        if (at < len(taken) and taken[at][0] < e) or (at and taken[at - 1][1] > b):
            continue
        insort(taken, (b, e))
        out.append((b, e, -v))
    return out


def scan_words(automaton: TemplateAutomaton, stretches, min_match: int, max_gap: int, min_share: float):
    """(phrases, spans) of one text. ``stretches``: (first word's index, words)."""
    phrases, matches = [], {}
    for first, words in stretches:
        before = (0, 0)
        for i, (state, n) in enumerate([*automaton.statistics(words), (0, 0)], first):
            if before[1] >= min_match and n != before[1] + 1:
                for t, end in automaton.ends[before[0]]:
                    matches.setdefault(t, []).append((i - before[1], end - before[1], before[1]))
            for name, size in automaton.phrases[state]:
                if n >= size:
                    phrases.append((name, i - size + 1))
            before = (state, n)
    spans = []
    for t, found in matches.items():
        size = automaton.sizes[t]
        for b, e, v in chain(sorted(found), max_gap):
            if v >= min_share * size:
                spans.append((automaton.labels[t], t, b, e, v / size))
    return sorted(phrases, key=lambda p: p[1]), sorted(spans, key=lambda s: (s[2], s[1]))


PHRASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()),
                                ("end", pa.int64()), ("share", pa.float64())]))


def _scan(phrases, templates, min_match: int, max_gap: int, min_share: float):
    def run(batches):
        automaton = TemplateAutomaton(phrases, templates)
        hasher = ByteHash()
        flat = np.frombuffer(b"".join(automaton.known), np.uint8)
        stop = np.cumsum([len(w) for w in automaton.known])
        known = np.sort(hasher.spans(hasher.sums(flat), np.concatenate(([0], stop[:-1])), stop))
        for b in (part for whole in batches for part in row_slices(whole, 1)):
            count, places, spans = [], [None] * b.num_rows, [None] * b.num_rows
            for first, bounds, data in text_groups(b.column(1)):
                data = LOWER[data]
                start, end = word_runs(data)
                lo = np.searchsorted(start, bounds)
                count.append(np.diff(lo))
                h = hasher.spans(hasher.sums(data), start, end)
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                row = np.searchsorted(bounds, start, side="right") - 1
                far = np.flatnonzero(hit)
                cut = np.flatnonzero((np.diff(far) > 1) | (np.diff(row[far]) > 0)) + 1
                todo: dict[int, list] = {}
                for s, e in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(far)])).tolist()):
                    if e - s >= min_words:
                        i = far[s:e]
                        r = int(row[i[0]])
                        todo.setdefault(r, []).append((int(i[0] - lo[r]), [
                            data[x:y].tobytes() for x, y in zip(start[i].tolist(), end[i].tolist())]))
                for r, stretches in todo.items():
                    found, covered = scan_words(automaton, stretches, min_match, max_gap, min_share)
                    places[first + r] = [{"label": n, "start": i} for n, i in found]
                    spans[first + r] = [dict(zip(("label", "template", "start", "end", "share"), s)) for s in covered]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate([*count, np.zeros(0, np.int64)]).astype(np.int64)),
                 pa.array([p or [] for p in places], PHRASE_TYPE), pa.array([s or [] for s in spans], SPAN_TYPE)],
                names=["id", "n_words", "phrases", "spans"])
    min_words = min([min_match, *(len(words_of(t)) for _, t in phrases)])
    return run


def find_licences(docs: DataFrame, phrases: list[tuple[str, str]] | None = None,
                  templates: list[tuple[str, str]] | None = None, min_match: int = 4, max_gap: int = 24,
                  min_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, phrases, spans).

    Words are runs of ASCII digits and letters and of characters beyond ASCII, A-Z
    lower-cased. ``phrases``: every place where a phrase's words stand consecutively, as
    (label, index of the first word). ``spans``: stretches [start, end) of words that
    hold ``share`` (``min_share`` or more) of a template's words in matches of
    ``min_match`` words or more; spans of one template do not overlap. Null texts are
    empty and have no words; null ids and repeated rows are kept as they are. Whole texts
    of any length; texts do not touch one another. Other columns are not read. An
    empty table gives an empty result. Templates and phrases: (label, text with words).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
            .mapInArrow(_scan(phrases, templates, min_match, max_gap, min_share),
                        f"id {kind}, n_words long, phrases array<struct<label:string,start:long>>, "
                        "spans array<struct<label:string,template:int,start:long,end:long,share:double>>")
            .withColumnRenamed("id", id_col))


def licence_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of ``find_licences``' rows; the score is the largest
    share of a template in one span, 1 where a phrase stands."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")     # noqa: E731
    start = F.col("phrases.start")
    return found.select(
        id_col, "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"), names(F.col("phrases.label")).alias("base_labels"),
        names(F.concat("phrases.label", "spans.label")).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
        .alias("score"))
