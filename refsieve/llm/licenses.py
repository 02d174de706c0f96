"""Operator 6: license scans by winnowed fingerprints and banded alignment.

Templates and texts are word sequences (ASCII case folded, runs of letters and
digits). The winnowed hashes of their ``K``-word shingles are fingerprints: of
each ``WINDOW`` consecutive shingles the least is kept, so any match of K +
WINDOW - 1 words shares one. An inverted index from fingerprint to template
places picks candidate diagonals in a text. Those around which the text shares
too few of the template's words, with repeats, are left; for the rest a banded
alignment of the template against the text around each diagonal gives its
matched words, coverage and span. Matches of ``COVERAGE`` or more are reported; where two overlap, the one
with more matched words stays, then the one of the earlier name, and the
diagonals of the other are aligned again with the words beside it.

Templates too short for that guarantee are looked up at every shingle of a text.
The index is of the size of the templates, not of the corpus. Null and empty
texts match nothing. Templates of fewer than K words are refused. Repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import LOWER, map_rows, rows_of, send, span_hashes, tidied, utf8, word_spans

K, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: From so many diagonals of a template on they are aligned together, so many at once.
TOGETHER, AT_ONCE = 6, 20_000
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = 1 << 16

#: Notices and license texts, in the words of their publishers; whole texts follow.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
TEMPLATES |= {
    "mit-text": TEMPLATES["mit"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": TEMPLATES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-3-clause-text": TEMPLATES["bsd-clauses"] + ' 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER).translate(_SPLIT).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each K-word shingle, in order (of all words, if fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, max(1, len(words) - K + 1), _STEP):
        data, starts, ends = word_spans(words[at : at + _STEP + K - 1])
        n = max(1, len(starts) - K + 1)
        parts.append(span_hashes(data, starts[:n], ends[-n:]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash of each WINDOW consecutive ones (the last of equals), each once."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))


class Index:
    """Fingerprints of the templates, sorted, with their template and place."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        if any(len(words) < K for words in self.words):
            raise ValueError(f"a template needs {K} words")
        rows, short = [], []
        for i, words in enumerate(self.words):
            hashes = shingle_hashes(words)
            rows += [(int(hashes[at]), i, int(at)) for at in winnow(hashes)]
            if len(words) < K + WINDOW - 1:
                short.append(hashes[winnow(hashes)])
        rows.sort()
        self.short = np.concatenate(short) if short else np.empty(0, np.uint64)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.entries = [r[1:] for r in rows]
        self.shortest = min(map(len, self.words), default=0)

    def diagonals(self, hashes: np.ndarray) -> dict[int, list[int]]:
        """By template: each place in the text where it would begin."""
        places = np.union1d(winnow(hashes), np.flatnonzero(np.isin(hashes, self.short)))
        low, high = np.searchsorted(self.hashes, hashes[places]), np.searchsorted(self.hashes, hashes[places], side="right")
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(high > low):
            for number, at in self.entries[low[i] : high[i]]:
                found.setdefault(number, []).append(int(places[i]) - at)
        return {number: sorted(set(starts)) for number, starts in found.items()}


def align(template: list[bytes], text: list[bytes], start: int, low: int, high: int) -> tuple[int, int, int]:
    """Matched words and the first and last matched word of text[low:high], of the best alignment within BAND of a diagonal.

    Rows are template words, columns the band; a match scores 2, a skipped word of either side costs 1.
    """
    width = 2 * BAND + 1
    best = [(0, 0, -1, -1)] * width  # score, matched, first, last
    for i, word in enumerate(template):
        row: list[tuple[int, int, int, int]] = []
        for j in range(width):
            at = start + i + j - BAND
            options = [(best[j + 1][0] - 1, *best[j + 1][1:])] if j + 1 < width else [(-1 - i, 0, -1, -1)]
            if low <= at < high:
                if text[at] == word:
                    s, n, first, _ = best[j]
                    options.append((s + 2, n + 1, at if first < 0 else first, at))
                else:
                    options.append((best[j][0] - 1, *best[j][1:]))
            if j and row[j - 1][1]:
                options.append((row[j - 1][0] - 1, *row[j - 1][1:]))
            row.append(max(options, key=lambda o: (o[0], o[1], -o[2])))
        best = row
    _, matched, first, last = max(best, key=lambda o: (o[0], o[1], -o[2]))
    return matched, first, last


#: A state of an alignment in 64 bits: score, matched words, nearness of the first match, and place of the last, from the band's start.
_SCORE, _MATCHED, _FIRST, _PLACE = 48, 32, 16, (1 << 16) - 1


def align_all(template: np.ndarray, text: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """What ``align`` gives for each start, of words as numbers: one table row after the other, all starts at once."""
    width, one = 2 * BAND + 1, np.int64(1) << _SCORE
    nothing = (np.int64(1) << 14 << _SCORE) | (np.int64(_PLACE) << _FIRST)
    best = np.full((width + 1, len(starts)), nothing)
    for i, word in enumerate(template):
        best[width] = nothing - i * one
        at = starts + i - BAND + np.arange(width)[:, None]
        there = (low <= at) & (at < high)
        same = there & (text[np.minimum(np.maximum(at, 0), len(text) - 1)] == word)
        place = i + 1 + np.arange(width)[:, None]
        begun = np.where((best[:width] >> _FIRST) & _PLACE == _PLACE, best[:width] - (place << _FIRST), best[:width])
        hit = (begun & ~_PLACE) + 2 * one + (np.int64(1) << _MATCHED) + place
        beside = np.where(same, hit, np.where(there, best[:width] - one, 0))
        row = best[1:] - one
        row = np.where(beside >> _FIRST > row >> _FIRST, beside, row)
        for j in range(1, width):
            left = np.where((row[j - 1] >> _MATCHED) & _PLACE > 0, row[j - 1] - one, 0)
            row[j] = np.where(left >> _FIRST > row[j] >> _FIRST, left, row[j])
        best[:width] = row
    last = best[(best[:width] >> _FIRST).argmax(axis=0), np.arange(len(starts))]
    matched = (last >> _MATCHED) & _PLACE
    first, end = starts - BAND + _PLACE - ((last >> _FIRST) & _PLACE) - 1, starts - BAND + (last & _PLACE) - 1
    return [(m, f, e) if m else (0, -1, -1) for m, f, e in zip(matched.tolist(), first.tolist(), end.tolist(), strict=True)]


def shared_words(held: dict[int, int], text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window of the text, the words, with repeats, that a template of so many of each may match there."""
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    total = np.zeros(len(low), np.int64)
    for word, n in held.items():
        at = order[np.searchsorted(sorted_text, word) : np.searchsorted(sorted_text, word, side="right")]
        total += np.minimum(np.searchsorted(at, high) - np.searchsorted(at, low), n)
    return total


def free_parts(kept: list[tuple], low: int, high: int) -> list[tuple[int, int]]:
    """The parts of words low to high (exclusive) that no kept match, of (first, last, ...) by place, covers."""
    i = bisect_left(kept, (low,))
    i -= i > 0 and kept[i - 1][1] >= low
    parts = []
    while i < len(kept) and kept[i][0] < high:
        if low < kept[i][0]:
            parts.append((low, kept[i][0]))
        low = kept[i][1] + 1
        i += 1
    return [*parts, (low, high)] if low < high else parts


def matches(index: Index, text: str | None) -> list[tuple[str, int, int, int, float]]:
    """(name, start, end, matched words, coverage) by start; offsets in code points, end exclusive."""
    words = words_of(text)
    if len(words) < max(1, index.shortest // 2):
        return []
    # Best first: (-words, name, first, last, template, start, low, high). Before an
    # alignment (last -1) words and first are bounds, so nothing better comes later.
    queue: list[tuple] = []
    need, held, aligned = {}, {}, {}
    numbers: dict[bytes, int] = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for number, starts in index.diagonals(shingle_hashes(words)).items():
        template, starts = index.words[number], np.array(starts)
        need[number] = len(template) * (COVERAGE if len(template) > K else 1)
        held[number] = Counter(template)
        low, high = np.maximum(starts - BAND, 0), np.minimum(starts + len(template) + BAND, len(words))
        bound = shared_words({numbers.get(w, -1): n for w, n in held[number].items()}, coded, low, high)
        good = bound >= need[number]
        starts, low, high, bound = (x[good] for x in (starts, low, high, bound))
        for at in range(0, len(starts) if len(starts) >= TOGETHER else 0, AT_ONCE):
            part = slice(at, at + AT_ONCE)
            found = align_all(np.array([numbers.get(w, -1) for w in template]), coded, starts[part], low[part], high[part])
            aligned |= zip(((number, s) for s in starts[part].tolist()), found, strict=True)
        queue += [(-n, index.names[number], lo, -1, number, s, lo, hi) for n, s, lo, hi in zip(bound.tolist(), starts.tolist(), low.tolist(), high.tolist(), strict=True)]
    heapify(queue)
    kept: list[tuple] = []  # (first, last, name, matched, coverage), by place
    while queue:
        less, name, first, last, number, start, low, high = heappop(queue)
        template = index.words[number]
        if last < 0 and free_parts(kept, low, high) == [(low, high)]:
            whole = (low, high) == (max(0, start - BAND), min(len(words), start + len(template) + BAND))
            matched, first, last = aligned.get((number, start)) if whole and (number, start) in aligned else align(template, words, start, low, high)
            if matched >= need[number]:
                heappush(queue, (-matched, name, first, last, number, start, low, high))
            continue
        if last >= 0 and free_parts(kept, first, last + 1) == [(first, last + 1)]:
            insort(kept, (first, last, name, -less, -less / len(template)))
        for low, high in free_parts(kept, low, high):
            bound = sum((held[number] & Counter(words[low:high])).values()) if high - low >= need[number] else 0
            if bound >= need[number]:
                heappush(queue, (-bound, name, low, -1, number, start, low, high))
    if not kept:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return sorted(((name, spans[first][0], spans[last][1], matched, cover) for first, last, name, matched, cover in kept), key=lambda m: m[1:3])


def summary(index: Index, key: int | None, text: str | None) -> tuple:
    found = matches(index, text)
    listed = ",".join(f"{n}:{s}:{e}:{m}:{c:.4f}" for n, s, e, m, c in found)
    return key, len(found), ",".join(sorted({m[0] for m in found})), sum(m[3] for m in found), max((m[4] for m in found), default=0.0), listed, hashlib.sha256(listed.encode()).hexdigest()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_matches, licenses, matched_words, coverage (the best), spans ("name:start:end:words:coverage,..."), spans_sha256."""
    sent = send(docs.sparkSession, Index(TEMPLATES if templates is None else templates))
    ddl = "doc_id bigint, n_matches bigint, licenses string, matched_words bigint, coverage double, spans string, spans_sha256 string"
    return map_rows(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), lambda key, text: summary(sent(), key, text), ddl)


def find(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: id, license, start, end, matched, coverage."""
    sent = send(docs.sparkSession, Index(TEMPLATES if templates is None else templates))
    schema = pa.schema([("id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in rows_of(batches):
            if found := matches(sent(), text):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[key] * len(found), *zip(*found, strict=True)], schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(tidied(run), "id bigint, license string, start bigint, end bigint, matched bigint, coverage double")
