"""License scans: winnowed fingerprints find candidates, banded alignment confirms them.

Templates and texts are compared by words (letters and digits, A-Z in lower
case).  Every run of ``k`` words of a template is hashed; of each ``w``
neighbouring hashes the least is kept (winnowing), so any passage of k + w - 1
words in common has a fingerprint in common.  The inverted index maps a
fingerprint to its templates and places.  A text looks all its own runs up,
so no fingerprint of a shared run is missed.  Hits of one template on nearby
diagonals become one candidate region; there a local alignment (match 2,
mismatch or gap -1), banded around the region's diagonals, counts the matched
words.  Regions that cover at least ``min_coverage`` of the template are
reported, each with its span.

The index is as large as the template list the caller passes, not the data;
texts are scanned in their own tasks and nothing is shuffled.

Defined cases: null, empty and white texts match nothing and give no row; a
null doc_id is kept; repeated rows give their rows each; a passage found
several times gives several rows; an empty table gives no rows; templates
shorter than ``k`` words are matched as one whole run; other columns play no
part.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, pieces, python_ready, span_hash, text_bytes

SCAN_BYTES = 4 << 20

# Public licence notices and texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-line": "Released under the MIT License.",
}


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the kept hashes: of each ``w`` neighbours the least, the last of equals."""
    n = len(hashes)
    kept = set()
    for a in range(max(1, n - w + 1)):
        part = hashes[a:a + w]
        kept.add(a + len(part) - 1 - int(part[::-1].argmin()))
    return np.array(sorted(kept), np.int64)


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], k: int, w: int):
        self.names, self.k = sorted(templates), k
        words = Words(*text_bytes(pa.array([templates[n] for n in self.names], pa.string())), alnum=True)
        self.words = [words.hash[a:z] for a, z in zip(words.bounds, words.bounds[1:])]
        self.places = defaultdict(list)  # (run length, fingerprint) -> (template, place)
        for t, h in enumerate(self.words):
            if not len(h):
                continue
            run = min(k, len(h))
            at = np.arange(len(h) - run + 1)
            grams = span_hash(h, at, at + run)
            for p in winnow(grams, w).tolist():
                self.places[run, int(grams[p])].append((t, p))
        self.runs = {r: np.array(sorted(f for n, f in self.places if n == r), np.uint64) for r in {n for n, _ in self.places}}

    def hits(self, words: Words) -> dict[int, list[tuple[int, int, int]]]:
        """text -> (template, diagonal, place) of every run of its words that is a template's fingerprint."""
        out = defaultdict(list)
        n = len(words.hash)
        doc = words.doc_of()
        for run, known in self.runs.items():
            at = np.arange(max(n - run + 1, 0))
            at = at[at + run <= words.bounds[1:][doc[at]]]
            grams = span_hash(words.hash, at, at + run)
            found = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams
            for p, g in zip(at[found].tolist(), grams[found].tolist()):
                d = int(doc[p])
                own = p - int(words.bounds[d])
                out[d] += [(t, own - q, own) for t, q in self.places[run, g]]
        return out


def regions(hits: list[tuple[int, int, int]], sizes: list[int], band: int):
    """(template, least diagonal, greatest diagonal) of hits that can belong to one passage."""
    held = None
    for t, diagonal, _ in sorted(hits):
        if held and held[0] == t and diagonal - held[2] <= min(band, max(2, sizes[t] // 4)):
            held[2] = diagonal
        else:
            if held:
                yield tuple(held)
            held = [t, diagonal, diagonal]
    if held:
        yield tuple(held)


def align(text: list[int], template: list[int], low: int, high: int):
    """Best local alignment with place - template place in [low, high]: (matched words, first, last) in the text."""
    best = (0, 0, 0, 0)  # score, matched, first, last
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for p in range(max(0, i + low), min(len(text), i + high + 1)):
            score, matched, first = before.get(p - 1, (0, 0, p))
            if score <= 0:
                score, matched, first = 0, 0, p
            same = text[p] == word
            cell = (score + 2, matched + 1, first) if same else (score - 1, matched, first)
            for other in (row.get(p - 1), before.get(p)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            row[p] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], p + 1)
        before = row
    return best[1:]


def scan(words: Words, index: Index, band: int, min_coverage: float):
    """(text, template, matched, words of the template, first, last) of every confirmed passage."""
    sizes = [len(t) for t in index.words]
    plain = [t.tolist() for t in index.words]
    for d, hits in sorted(index.hits(words).items()):
        a, z = int(words.bounds[d]), int(words.bounds[d + 1])
        found = set()
        for t, low, high in regions(hits, sizes, band):
            reach = min(band, max(2, sizes[t] // 4))
            first = max(0, low - reach)
            last = min(z - a, high + sizes[t] + reach)
            matched, s, e = align(words.hash[a + first:a + last].tolist(), plain[t], low - reach - first, high + reach - first)
            if matched >= min_coverage * sizes[t]:
                found.add((t, matched, s + first, e + first))
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, matched, s, e in sorted(found, key=lambda x: (x[0], -x[1], x[2], x[3])):
            if all(e <= a2 or s >= e2 for a2, e2 in taken[t]):  # overlapping passages of one template: the better one
                taken[t].append((s, e))
                yield d, t, matched, sizes[t], s, e


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 3, w: int = 4, band: int = 8,
                  min_coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage: doc_id, template, matched and template words, coverage, word span [first, last), its text."""
    spark = docs.sparkSession
    python_ready(spark)
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches):
        index = Index(templates, k, w)
        for b in batches:
            body, offsets = text_bytes(b.column(1))
            for a, z in pieces(offsets, SCAN_BYTES):
                part = body[offsets[a]:offsets[z]]
                words = Words(part, offsets[a:z + 1] - offsets[a], alnum=True)
                rows = list(scan(words, index, band, min_coverage))
                at = [int(words.bounds[r[0]]) for r in rows]
                spans = [part[words.start[p + r[4]]:words.end[p + r[5] - 1]].tobytes().decode() for p, r in zip(at, rows)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a).take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([index.names[r[1]] for r in rows], pa.string()), *[pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3)],
                     pa.array([r[2] / r[3] for r in rows], pa.float64()), *[pa.array([r[c] for r in rows], pa.int64()) for c in (4, 5)],
                     pa.array(spans, pa.string())],
                    names=["doc_id", "template", "matched", "template_words", "coverage", "first", "last", "span"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, template string, matched long, template_words long, coverage double, first long, last long, span string")
