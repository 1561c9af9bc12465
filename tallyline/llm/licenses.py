"""License scans: winnowed fingerprints and shared words pick candidates, a banded alignment reports coverage and spans.

Of every window of k-gram hashes of a template the smallest is kept, in an inverted index with
its places. A document's k-grams are all looked up, so a run of k + window - 1 words of a
template is always found. Places that agree on where the template would begin are aligned.
A copy can keep coverage without any run (a word put between every two), so stretches with as
many of a template's words as coverage asks for are aligned too. Copies whose words stand at
their places are told by counting, which keeps a text of nothing but notices linear.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.aligning import Vocabulary, banded, grams, spans_of

#: Notices by which common licenses are granted, as their publishers word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}

_FOUND = "array<struct<license:string,coverage:double,matched_words:int,template_words:int,start:int,end:int>>"


def winnowed(hashes: list[int], window: int) -> list[int]:
    """Positions kept: the rightmost smallest of every window, all windows of a shorter list being itself."""
    out: list[int] = []
    for a in range(max(1, len(hashes) - window + 1)):
        part = range(a, min(a + window, len(hashes)))
        least = min(part, key=lambda i: (hashes[i], -i), default=None)
        if least is not None and (not out or out[-1] != least):
            out.append(least)
    return out


class Index:
    """Templates as numbers and their winnowed k-grams. Its size is that of the templates."""

    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 4):
        self.k, self.vocabulary = k, Vocabulary()
        self.templates = [(name, w) for name, t in sorted(templates.items()) if len(w := self.vocabulary.learn(t))]
        self.base = len(self.vocabulary.number) + 1
        if self.base**k >= 2**64:
            raise ValueError("too many words in the templates for k-grams as 64-bit numbers")
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, (name, words) in enumerate(self.templates):
            if len(words) < k:
                raise ValueError(f"{name} has fewer than {k} words")
            _, found = grams(words, k, self.base)
            for at in winnowed([g * 0x9E3779B97F4A7C15 % 2**64 for g in found.tolist()], window):
                self.places.setdefault(int(found[at]), []).append((t, at))
        self.wanted = np.sort(np.fromiter(self.places, np.uint64))
        self.member = np.zeros((len(self.templates), self.base), bool)
        for t, (_, words) in enumerate(self.templates):
            self.member[t, words] = True

    def in_place(self, t: int, words: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Where copies begin that have their words at their places, and how many of them."""
        template = self.templates[t][1]
        same = np.zeros(max(0, len(words) - len(template) + 1), np.int32)
        for i, w in enumerate(template):
            same += words[i : i + len(same)] == w
        begins = np.flatnonzero(same >= least * len(template))
        return begins, same[begins]

    def by_words(self, t: int, held: np.ndarray, words: np.ndarray, least: float, band: int) -> Iterator[int]:
        """Diagonals, ascending: bands round them hold all copies of coverage `least` whose diagonals are within `band` of each other."""
        template = self.templates[t][1]
        n, length = len(template), len(template) + band
        total = np.r_[0, np.cumsum(held)]
        begins = np.arange(1 - length, len(words))
        many = total[np.minimum(begins + length, len(words))] - total[np.maximum(begins, 0)]
        done = None
        for d in begins[many >= least * n].tolist():  # a copy of diagonals d to d + band has its words in d to d + length
            if done is not None and d <= done + _step(n, band) // 2:
                continue
            done = d
            part = words[max(0, d - band) : max(0, d + n + 2 * band)]
            if np.isin(template, part).sum() >= least * n:
                yield d

    def scan(self, text: str, least: float, band: int) -> list[dict]:
        words = self.vocabulary.read(text)
        held = self.member[:, words] if (words != 0).any() else np.zeros((len(self.templates), 0), bool)
        possible = np.flatnonzero(held.sum(axis=1) >= [least * len(w) for _, w in self.templates])
        if not len(possible):
            return []
        out = []
        left: dict[int, np.ndarray] = {}  # by template: words that whole copies do not explain
        for t in possible.tolist():
            name, template = self.templates[t]
            n = len(template)
            whole = np.zeros(len(words) + 1, np.int32)
            for d, matched in zip(*(x.tolist() for x in self.in_place(t, words, least))):
                same = np.flatnonzero(words[d : d + n] == template)
                out.append((d + int(same[0]), d + int(same[-1]) + 1, matched, t, name, matched / n))
                if matched == n:
                    whole[d] += 1
                    whole[d + n] -= 1
            left[t] = held[t] & (np.cumsum(whole[:-1]) == 0)
        at, gram = grams(words, self.k, self.base)
        begins: dict[int, list[int]] = {}
        if len(at) and len(self.wanted):
            near = np.minimum(np.searchsorted(self.wanted, gram), len(self.wanted) - 1)
            for i in np.flatnonzero(self.wanted[near] == gram):
                for t, place in self.places[int(gram[i])]:
                    if t in left and left[t][at[i]]:
                        begins.setdefault(t, []).append(int(at[i]) - place)
        for t, unexplained in left.items():
            name, template = self.templates[t]
            done = None
            for d in [*sorted(set(begins.get(t, ()))), None, *self.by_words(t, unexplained, words, least, band)]:
                if d is None or (done is not None and d - done <= _step(len(template), band)):
                    done = None if d is None else done
                    continue
                done = d
                matched, first, last = banded(template, words, d + band // 2, band)
                if matched >= least * len(template):
                    out.append((first, last, matched, t, name, matched / len(template)))
        # of finds that overlap, the one with more matched words stays, then the one of higher coverage, then the shorter
        kept: list[tuple] = []
        for find in sorted(out, key=lambda f: (-f[2], -f[5], f[1] - f[0], f[0], f[4])):
            i = bisect.bisect_left(kept, find[:2])
            if (not i or kept[i - 1][1] <= find[0]) and (i == len(kept) or kept[i][0] >= find[1]):
                kept.insert(i, find)
        spans = spans_of(text) if kept else []
        return [{"license": f[4], "coverage": f[5], "matched_words": f[2], "template_words": len(self.templates[f[3]][1]), "start": spans[f[0]][0], "end": spans[f[1] - 1][1]} for f in kept]


def _step(n: int, band: int) -> int:
    """Copies of a template of n words begin at least half its length apart."""
    return min(band, n // 2)


def with_licenses(df: DataFrame, text: str = "text", licenses: str = "licenses", templates: dict[str, str] = TEMPLATES, k: int = 3, window: int = 4, least: float = 0.8, band: int = 8) -> DataFrame:
    """Adds the license notices of the whole text, in order of place: which, share of its words matched, character span.

    A null or empty text has none. A notice that comes several times is reported each time; of
    overlapping ones the longest is. Repeated rows get the same each, an empty table stays
    empty. Other columns are kept; one named as `licenses` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(Index(templates, k, window))

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("template_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([shared.value.scan(t.as_py(), least, band) for t in pc.fill_null(texts, "")], kind)

    return df.withColumn(licenses, found(F.col(text)))


def license_finds(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row for each notice: doc_id, license, coverage, matched and template words, start, end."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_licenses(narrow, "text", "licenses", **more).select(F.col("doc_id").alias(doc_id), F.explode("licenses").alias("found")).select(doc_id, "found.*")
