"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

A template's fingerprints are hashes of pairs of neighbouring words. Of a long template's they are winnowed: of any
``WINNOW`` in a row the least is kept, so a run of ``WINNOW`` + 1 words that a text has in common with the template always
holds one. A match has such a run if less than a third as many words were changed as match (without insertions always).
Short notices have no such runs once a word is changed, so all of their pairs are kept.

An inverted index leads from a fingerprint to template and position. All pairs of a text are looked up at once; hits of
a template that lie near each other are one candidate place, where the template's words are aligned with the text's in a
band around the hits' diagonals. A place is reported if the matched words cover at least ``LEAST`` of the template and it
holds a fingerprint; what is left before and after it is then aligned again. Places that hold too few words of the
template for that are not aligned.

Defined cases: a null text, or one without words, has no match; a long text is scanned whole; templates of one word are
indexed by that, of none never found; with no templates nothing is found; overlapping places of one template are
reported once (of ties the first place), of different templates each; repeated rows stay; keys may be of any type; an
empty table gives no rows; columns other than key and text are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from .common import LOWER_ASCII, by_text, joined, quoted, runs, span_hashes
from .decontaminate import _WORD

K, BAND, LEAST = 2, 6, 0.8
#: Pairs of which the least is kept, in templates of at least so many words.
WINNOW, LONG = 3, 16

#: Public notices, by name.
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-name": "GNU General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}


def _scan_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, starts = joined(texts)
    low = np.frombuffer(data.tobytes().translate(LOWER_ASCII), np.uint8)
    begin, end = runs(_WORD[low])
    return low, starts, begin, end, np.searchsorted(starts, begin, "right") - 1


def _gram_hash(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word numbers."""
    h = np.full(max(0, len(numbers) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ numbers[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, width: int) -> list[int]:
    """Places of the least of each ``width`` hashes in a row, the last of equals."""
    return sorted({i + width - 1 - int(np.argmin(hashes[i : i + width][::-1])) for i in range(max(1, len(hashes) - width + 1))})


def align(template: list[int], text: list[int], low: int, high: int, need: int = 1) -> tuple[int, int, int]:
    """Best local alignment of at least ``need`` matched words within the diagonals low..high (text position - template
    position): matched words (0 if there is none), begin, end in the text.

    A match counts 1, a mismatch or a gap -1.
    """
    best, above = (0, 0, 0, 0), {}
    for i, a in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}  # diagonal: score, matched, begin
        for d in range(max(low, -i), min(high, len(text) - 1 - i) + 1):
            j = i + d
            s, m, b = above.get(d, (0, 0, j))
            if s <= 0:
                s, m, b = 0, 0, j
            cell = (s + 1, m + 1, b) if a == text[j] else (s - 1, m, b)
            if (up := above.get(d + 1)) and up[0] - 1 > cell[0]:  # a template word without a partner
                cell = (up[0] - 1, up[1], up[2])
            if (left := row.get(d - 1)) and left[0] - 1 > cell[0]:  # a text word without one
                cell = (left[0] - 1, left[1], left[2])
            row[d] = cell
            if a == text[j] and cell[1] >= need and (cell[0], cell[1]) > best[:2]:
                best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


@dataclass
class Index:
    names: list[str]
    words: list[list[int]]
    vocabulary: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by n: sorted hashes, template, position

    @classmethod
    def build(cls, templates: dict[str, str]) -> Index:
        names = sorted(templates)
        low, _, begin, end, of = _scan_words([templates[n] for n in names])
        vocabulary, number = np.unique(span_hashes(low, begin, end), return_inverse=True)
        words = [(number[of == i] + 1).tolist() for i in range(len(names))]
        found: dict[int, list] = {}
        for t, w in enumerate(words):
            n = min(K, len(w))
            if n:
                h = _gram_hash(np.array(w), n)
                kept = winnow(h, WINNOW) if len(w) >= LONG else range(len(h))
                found.setdefault(n, []).extend((int(h[i]), t, i) for i in kept)
        grams = {n: tuple(np.array(c, kind) for c, kind in zip(zip(*sorted(x)), (np.uint64, np.int64, np.int64))) for n, x in found.items()}
        return cls(names, words, vocabulary, grams)

    @staticmethod
    def _free(x: int, y: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What of x..y lies outside the spans ``taken``."""
        out = []
        for a, b in sorted(taken):
            if a < y and b > x:
                out.append((x, a))
                x = max(x, b)
        return [(a, b) for a, b in [*out, (x, y)] if a < b]

    def find(self, texts: list[str | None], least: float = LEAST) -> list[list[tuple[int, int, str, float]]]:
        """Of each text: (begin, end in code points, template, coverage)."""
        low, starts, begin, end, of = _scan_words(texts)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if not len(begin) or not len(self.vocabulary):
            return out
        h = span_hashes(low, begin, end)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == h, at + 1, 0)
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        hits = []
        for n, (hashes, template, position) in self.grams.items():
            own = number > 0
            whole = np.logical_and.reduce([own[k : len(own) - n + 1 + k] for k in range(n)]) if len(own) >= n else np.zeros(0, bool)
            whole &= of[: len(whole)] == of[n - 1 : n - 1 + len(whole)]
            places = np.flatnonzero(whole)
            g = _gram_hash(number, n)[places]
            a, b = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
            size = b - a
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            hits.append(np.column_stack([of[np.repeat(places, size)], template[k], np.repeat(places, size), position[k]]))
        hits = np.unique(np.concatenate(hits), axis=0)
        held: dict[int, np.ndarray] = {}  # by template: how many of the words before each one it has
        raw = low.tobytes()
        new = np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0) != 0, axis=1)) + 1
        edges = [0, *new.tolist(), len(hits)] if len(hits) else []
        for first_hit, last_hit in zip(edges, edges[1:]):  # of one text and template
            d, t = hits[first_hit, :2].tolist()
            words, base = self.words[t], int(starts[d])
            need, slack = math.ceil(least * len(words) - 1e-9), len(words) // 2 + BAND
            if t not in held:
                held[t] = np.concatenate(([0], np.cumsum(np.isin(number, words))))
            if held[t][first[d + 1]] - held[t][first[d]] < need:
                continue
            place, diagonal = hits[first_hit:last_hit, 2].tolist(), (hits[first_hit:last_hit, 2] - hits[first_hit:last_hit, 3]).tolist()
            taken, a = [], 0
            while a < len(place):
                b = a + 1
                while b < len(place) and place[b] - place[b - 1] <= len(words) and diagonal[b] <= diagonal[a] + slack:
                    b += 1
                lo, hi = min(diagonal[a:b]) - slack, max(diagonal[a:b]) + slack
                taken = [s for s in taken if s[1] > place[a] - len(words) - slack]  # later places don't reach back further
                free = self._free(max(int(first[d]), lo), min(int(first[d + 1]), hi + len(words)), taken)
                while free:
                    x, y = free.pop()
                    if held[t][y] - held[t][x] < need:
                        continue
                    matched, s, e = align(words, number[x:y].tolist(), lo - x, hi - x, need)
                    if not matched:
                        continue
                    free += [(x, x + s), (x + e, y)]
                    if not any(x + s <= p < x + e for p in place[a:b]):
                        continue
                    taken.append((x + s, x + e))
                    p, q = int(begin[x + s]), int(end[x + e - 1])
                    chars = len(raw[base:p].decode("utf-8", "surrogatepass"))
                    out[d].append((chars, chars + len(raw[p:q].decode("utf-8", "surrogatepass")), self.names[t], matched / len(words)))
                a = b
        return [sorted(x) for x in out]


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, n_matches, licenses (names, joined) and matches (name, begin, end, coverage)."""
    shared = spark.sparkContext.broadcast(Index.build(templates))
    kind = pa.list_(pa.struct([("name", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def work(texts: list) -> pa.Array:
        found = shared.value.find(texts)
        columns = [
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([",".join(sorted({m[2] for m in x})) for x in found], pa.string()),
            pa.array([[{"name": n, "begin": a, "end": b, "coverage": c} for a, b, n, c in x] for x in found], kind),
        ]
        return pa.StructArray.from_arrays(columns, names=["n_matches", "licenses", "matches"])

    found = by_text("n_matches long, licenses string, matches array<struct<name:string,begin:long,end:long,coverage:double>>", work, 1_000_000)
    return docs.select(quoted(key).alias("doc_id"), found(quoted(text).cast("string")).alias("found")).select("doc_id", "found.*")
