"""License scan: winnowed fingerprints pick candidates, banded alignment reports them.

Templates and texts are runs of letters and digits, A-Z lower-cased.  Every
template is winnowed: of each WINNOW consecutive GRAM-word hashes the least is a
fingerprint, kept in an inverted index.  A text looks up all its GRAM-word
hashes, so each common run of WINNOW + GRAM - 1 words, or of a whole shorter
template, gives a hit.  Hits on diagonals within BAND of a first one form one
candidate, which is aligned with the template inside a band about those diagonals
(local alignment; match +1, mismatch and gap -1), many candidates at a time.  What
is left on either side of a notice inside a candidate's few words is aligned again,
so notices that follow each other closely are all found, and of two that overlap
the one with more matches stays.  Coverage is the share of the template's words
that the alignment matches.  The work is in proportion to the hits.

The templates are a parameter; the index grows with them only.

Nulls and odd cases: a null or empty text has no matches; a null id is carried;
repeated rows and repeated notices in a text are reported each; a template
without words is never found; texts of any length are scanned whole; an output
column whose name is taken by a kept one gets an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import bound_batches, fresh_names

GRAM, WINNOW, BAND, MIN_COVERAGE = 3, 3, 8, 0.8

#: The opening notices of public licenses.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BITMAP = 16
_BATCH = 2048  # candidates aligned at once
_ONE, _MATCH, _FIRST = 1 << 42, 1 << 21, (1 << 21) - 1  # a cell: score, matches, first word + 1


def words_of(arr: pa.Array) -> K.Words:
    return K.Words(arr, lower=True, space=_BREAK)


def winnow(h: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the fingerprints: the rightmost least hash of each window, or of all if there are fewer."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(rows)) + window - 1 - np.argmin(rows[:, ::-1], axis=1))


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = words_of(K.strings(pa.array(list(templates.values()), pa.string())))
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in range(len(self.names))]
        of: dict[int, list[tuple[int, int]]] = {}
        for t, h in enumerate(self.words):
            g = K.ngrams(h, min(GRAM, len(h)))[: max(0, len(h) - GRAM + 1) or 1] if len(h) >= GRAM else np.zeros(0, np.uint64)
            for p in winnow(g):
                of.setdefault(int(g[p]), []).append((t, int(p)))
        keys = np.array(sorted(of), np.uint64)
        self.table = K.HashTable(keys)
        posts = [of[int(k)] for k in keys]
        self.first = np.cumsum([0, *map(len, posts)])
        self.template, self.offset = np.array([x for own in posts for x in own], np.int64).reshape(-1, 2).T
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(keys >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True

    def candidates(self, w: K.Words) -> np.ndarray:
        """Rows (template, text, least, greatest start of the template in words of the run), a span of BAND at most."""
        h = K.ngrams(w.hashes, GRAM)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITMAP)).astype(np.int64)] & (w.room() >= GRAM))
        got = self.table.find(h[at])
        at, got = at[got >= 0], got[got >= 0]
        n = self.first[got + 1] - self.first[got]
        post = np.repeat(self.first[got] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        hits = np.unique(np.stack([self.template[post], np.searchsorted(w.first, at, "right") - 1, at - self.offset[post]], 1), axis=0)
        out, now = [], None
        for t, d, s in hits.tolist():
            if now and now[:2] == [t, d] and s - now[2] <= BAND:
                now[3] = s
            else:
                now = [t, d, s, s]
                out.append(now)
        return np.array(out, np.int64).reshape(-1, 4)

    def scan(self, arr: pa.Array, min_coverage: float) -> list[tuple]:
        """(text, template, coverage, matched, first code point, last code point + 1) of every notice found."""
        w = words_of(arr)
        todo = self.candidates(w)
        if not len(todo):
            return []
        size = np.array([len(x) for x in self.words])
        t, d, lo, hi = todo.T
        a, z = w.first[d], w.first[d + 1]
        # (template, text, first word, last word + 1, least and greatest diagonal)
        todo = np.stack([t, d, np.maximum(a, lo - BAND), np.minimum(z, hi + BAND + size[t]), lo - BAND, hi + BAND], 1)
        found = []
        while len(todo):
            again = []
            for t in np.unique(todo[:, 0]).tolist():
                own = todo[todo[:, 0] == t]
                for i in range(0, len(own), _BATCH):
                    part = own[i : i + _BATCH]
                    k, first, last = align(self.words[t], w.hashes, *part[:, 2:].T)
                    ok = (k > 0) & (k >= min_coverage * size[t])
                    part, k, first, last = part[ok], k[ok], first[ok], last[ok]
                    found.append(np.stack([part[:, 1], part[:, 0], first, last, k], 1))
                    for x, y in ((part[:, 2], first), (last + 1, part[:, 3])):  # on either side of the notice
                        more = part.copy()
                        more[:, 2], more[:, 3] = x, y
                        again.append(more[y - x >= min_coverage * size[t]])
            todo = np.concatenate(again) if again else todo[:0]
        rows = np.unique(np.concatenate(found), axis=0)
        kept: list[list[int]] = []
        for r in rows.tolist():  # by text, template and first word
            if kept and kept[-1][:2] == r[:2] and r[2] <= kept[-1][3]:
                if r[4] > kept[-1][4]:
                    kept[-1] = r
            else:
                kept.append(r)
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        return [(d, t, k / int(size[t]), k, int(points[w.starts[x]] - points[w.offs[d]]), int(points[w.ends[y]] - points[w.offs[d]])) for d, t, x, y, k in kept]


def align(template: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of a template with text[start:stop] on the diagonals (text word - template word) lo to hi: (matches, first, last text word).

    Column c of a row of the band is diagonal lo + c, so what comes before a cell
    diagonally is in its own column, and what comes before it in the template in
    the next one; gaps in the text are a running maximum along the row.
    """
    width = int((hi - lo).max()) + 1 if len(lo) else 0
    col = np.arange(width)
    step, text = col * _ONE, np.concatenate([text, np.zeros(1, text.dtype)])
    row, best = np.zeros((len(lo), width + 1), np.int64), np.zeros(len(lo), np.int64)
    last = np.full(len(lo), -1)
    inside = col <= (hi - lo)[:, None]
    for i, word in enumerate(template):
        at = (lo + i)[:, None] + col
        same = inside & (at >= start[:, None]) & (at < stop[:, None])
        same &= text[np.clip(at, 0, len(text) - 1)] == word
        before = row[:, :-1]
        new = _ONE + _MATCH + at - start[:, None] + 1
        cell = np.where(same, np.where(before > 0, before + (_ONE + _MATCH), new), before - _ONE)
        cell = np.maximum(cell, row[:, 1:] - _ONE)
        cell[cell < _ONE] = 0
        cell = np.maximum.accumulate(cell + step, axis=1) - step
        cell[(cell < _ONE) | ~inside] = 0
        row[:, :-1] = cell
        top = np.where(same, cell >> 21, 0)
        c = top.argmax(axis=1)
        own = top[np.arange(len(lo)), c]
        better = own > best >> 21
        best[better] = cell[np.flatnonzero(better), c[better]]
        last[better] = lo[better] + i + c[better]
    return (best >> 21) & _FIRST, (best & _FIRST) - 1 + start, last


def scan_licenses(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The columns `keep` of docs, license, coverage, n_matched, start and end (code points, end exclusive) of every notice."""
    index = TemplateIndex(templates or TEMPLATES)
    names = [f"c{i}" for i in range(len(keep))]
    more = (("license", T.StringType()), ("coverage", T.DoubleType()), ("n_matched", T.LongType()), ("start", T.LongType()), ("end", T.LongType()))
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)] + [T.StructField(c, t) for c, t in more])
    src = bound_batches(docs).select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col("text").alias("__text"))

    def run(batches):
        for batch in batches:
            for part, arr in K.slices(batch, "__text"):
                found = index.scan(arr, min_coverage)
                if not found:
                    continue
                at = pa.array([f[0] for f in found], pa.int64())
                cols = [part.column(i).take(at) for i in range(len(keep))]
                cols += [pa.array([index.names[f[1]] for f in found]), pa.array([f[2] for f in found]), *(pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return src.mapInArrow(run, schema).toDF(*keep, *fresh_names(keep, [c for c, _ in more]))
