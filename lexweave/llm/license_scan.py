"""License scan: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates and texts are cut into words. The index maps the winnowed word-gram hashes of every template to the template; a
template that a text meets is looked for by its words. Their places lie on diagonals (text word minus template word); a
band of diagonals that begins at one and holds enough of the template's words is a candidate, and a banded local alignment
inside it counts equal words in order, allowing words to be changed, added or dropped within the band. A candidate is
reported if its matched words cover enough of the template; of reports that overlap, the one with more matched words stays.

Grams and winnows are as long as keeps every text that would be reported: with ``d`` template words changed or dropped and
the words added in the band, the matched words fall into at most ``2 * d + 2 * BAND + 1`` runs, and the longest run holds a
whole winnow. For few words that is a single word.

Texts are scanned whole, in one Arrow pass without a shuffle; the index is a fixed parameter of checked size.

Defined results: a null or empty text reports nothing; repeated rows report each; a null id is carried as null; an
empty table gives an empty table; only the id is carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import gram_hashes, winnow, word_hashes

GRAM, WIDTH, BAND, COVERAGE = 3, 2, 4, 0.8  # the first two at the most
TEMPLATE_BYTES = 4 << 20  # of all templates, since their index goes to every task

# Public license notices and whole short licenses.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        f"Software. {_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
        "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
        "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
        f"law. {_AS_IS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-cased words and their character spans."""
    found = [(m.group().lower().encode(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


class Index:
    """``fingerprints``: the templates of each hash, for each length of gram; ``tokens``: the templates' words one after the other, by ``vocabulary``."""

    def __init__(self, templates: dict[str, str]):
        if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {TEMPLATE_BYTES} bytes")
        self.names = list(templates)
        self.words = [words_of(t)[0] for t in templates.values()]
        self.least = [math.ceil(COVERAGE * len(w) - 1e-9) for w in self.words]
        self.fingerprints: dict[int, dict[int, set[int]]] = {}
        for of, words in enumerate(self.words):
            if words:
                gram, width = lengths(len(words), self.least[of])
                hashes = gram_hashes(word_hashes(words), gram)
                for p in winnow(hashes, width).tolist():
                    self.fingerprints.setdefault(gram, {}).setdefault(int(hashes[p]), set()).add(of)
        self.keys = {gram: np.array(sorted(found), np.uint64) for gram, found in self.fingerprints.items()}
        tokens = [word_hashes(w) for w in self.words]
        self.vocabulary = np.unique(np.concatenate([*tokens, np.zeros(0, np.uint64)]))
        self.tokens = [np.searchsorted(self.vocabulary, t) for t in tokens]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, matched words, template words, start, end) of every report, in order."""
        if not len(self.vocabulary):
            return []
        words, spans = words_of(text)
        hashes = word_hashes(words)
        at, token = meetings(self.vocabulary, hashes)
        if not len(at):
            return []
        present = np.zeros(len(self.vocabulary), bool)
        present[token] = True
        some = {of for of, t in enumerate(self.tokens) if len(t) and np.count_nonzero(present[t]) >= self.least[of]}
        if not some:
            return []
        met: set[int] = set()
        for gram, keys in self.keys.items():
            for k in np.unique(meetings(keys, gram_hashes(hashes, gram))[1]).tolist():
                met |= self.fingerprints[gram][int(keys[k])]
        order = np.argsort(token, kind="stable")
        at, token = at[order], token[order]
        found = set()
        for of in sorted(some & met):
            size = len(self.words[of])
            for shift in self.bands(of, at, token):
                matched, first, end = aligned(words, self.words[of], shift, BAND)
                if matched >= self.least[of]:
                    found.add((matched, matched / size, of, first, end))
        found = list(found)
        found.sort(key=lambda x: (-x[0], -x[1], x[3], x[2]))
        taken: list[tuple[int, float, int, int, int]] = []
        for x in found:
            if all(x[4] <= t[3] or x[3] >= t[4] for t in taken):
                taken.append(x)
        return [(self.names[of], share, matched, len(self.words[of]), spans[first][0], spans[end - 1][1]) for matched, share, of, first, end in sorted(taken, key=lambda x: x[3])]

    def bands(self, of: int, at: np.ndarray, token: np.ndarray) -> list[int]:
        """Middles of the bands that begin at a meeting and hold enough of the template's words; ``at`` in order of ``token``."""
        begin, end = np.searchsorted(token, self.tokens[of], "left"), np.searchsorted(token, self.tokens[of], "right")
        word = np.repeat(np.arange(len(begin)), end - begin)
        shift = np.concatenate([at[a:b] - q for q, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True))])
        order = np.argsort(shift, kind="stable")
        shift, word = shift[order], word[order]
        first = np.unique(shift)
        a, b = np.searchsorted(shift, first, "left"), np.searchsorted(shift, first + 2 * BAND, "right")
        full = np.flatnonzero(b - a >= self.least[of])
        return [int(first[i]) + BAND for i in full.tolist() if len(np.unique(word[a[i] : b[i]])) >= self.least[of]]


def lengths(size: int, least: int) -> tuple[int, int]:
    """(gram, winnow width) with which every ``least`` of ``size`` words, in order and in the band, hold a fingerprint."""
    run = -(-least // (2 * (size - least) + 2 * BAND + 1))
    gram = max(1, min(GRAM, run - WIDTH + 1))
    return gram, run - gram + 1


def meetings(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are among the sorted keys, and of their keys."""
    near = np.searchsorted(keys, hashes)
    near[near == len(keys)] = 0
    at = np.flatnonzero(keys[near] == hashes)
    return at, near[at]


def aligned(words: list[bytes], template: list[bytes], shift: int, band: int) -> tuple[int, int, int]:
    """Most equal words in order with the text word within ``band`` of ``template word + shift``: (count, first, end)."""
    width = 2 * band + 1
    best: list[tuple[int, int, int]] = [(0, -1, -1)] * width  # by offset in the band: (count, -first, -end) of the rows before
    for q, word in enumerate(template):
        now = []
        for k in range(width):
            p = q + shift - band + k
            from_row = best[k + 1] if k + 1 < width else (0, -1, -1)  # this template word is left out
            from_text = now[k - 1] if k else (0, -1, -1)  # this text word is left out
            top = max(from_row, from_text)
            if 0 <= p < len(words) and words[p] == word:
                n, first, _ = best[k]
                top = max(top, (n + 1, first if n else -p, -(p + 1)))
            now.append(top)
        best = now
    n, first, end = max(best)
    return n, -first, -end


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, license, coverage, matched_words, template_words, start_char, end_char), a row per report."""
    kind = df.schema[id_col].dataType.simpleString()
    used = TEMPLATES if templates is None else templates
    fields = "license string, coverage double, matched_words long, template_words long, start_char long, end_char long"
    names = ["id", *(f.split()[0] for f in fields.split(", "))]
    types = [pa.string(), pa.float64(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(used)
        for batch in batches:
            at, reports = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for report in index.scan(text or ""):
                    at.append(i)
                    reports.append(report)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in reports], t) for k, t in enumerate(types)]], names)

    found = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {fields}")
    return found.withColumnRenamed("id", id_col)
