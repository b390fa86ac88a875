"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text's bigrams that occur in a template are its hits. Windows between hits are compared with the
template, wherever lines, sentences and paragraphs end, so wrapped and commented notices are found.
Size bounds that follow from the Dice threshold decide which windows and templates can match.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BASE, mix, raw, slices, strings, words

THRESHOLD = 0.75

#: Licence names and the notices that stand for them.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "MIT License",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without permission."],
}


def templates(notices: dict[str, list[str]] | None = None) -> list[tuple[str, int, int, np.ndarray]]:
    """(licence, notice number, bigrams in its text, sorted different bigrams) of every template of two words or more."""
    out = []
    for name, texts in (notices or TEMPLATES).items():
        for i, text in enumerate(texts):
            data, offsets = raw(strings(pa.array([text])))
            h = words(data, offsets)[0]
            if len(h) > 1:
                bigrams = mix(h[:-1] * np.uint64(BASE) + h[1:]) >> np.uint64(16)
                out.append((name, i, len(bigrams), np.unique(bigrams)))
    return out


class _Run:
    """Windows of a run of hits of one template: each starts and ends at a hit (moving an end to the next hit inwards only raises Dice).

    Every such window of up to twice the longest length that can reach the threshold is weighed: from
    a start on, a bigram is new if it last occurred before the start, so counts of different and of
    matching bigrams run along the hits.
    """

    def __init__(self, pairs: np.ndarray, hits: np.ndarray, size: int, template: np.ndarray, threshold: float):
        self.lo, self.reach, self.size = int(hits[0]), int(2 * size * (2 - threshold) / threshold), len(template)
        part = pairs[self.lo : int(hits[-1]) + 1]
        before = np.full(len(part) + self.reach, len(part), np.int64)  # where each bigram last occurred; behind the end nothing is new
        before[: len(part)] = -1
        order = np.argsort(part, kind="stable")
        again = part[order][1:] == part[order][:-1]
        before[order[1:][again]] = order[:-1][again]
        known = np.zeros(len(part) + self.reach, bool)
        self.starts = hits - self.lo
        known[self.starts] = True
        self.before, self.known = (np.lib.stride_tricks.sliding_window_view(x, self.reach) for x in (before, known))

    def best(self, at: np.ndarray, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best Dice and its last bigram for each start, of windows that end before ``stop``; the longest of equal ones."""
        new, mine = self.before[at] < at[:, None], self.known[at]
        dice = 2 * (new & mine).cumsum(axis=1) / (new.cumsum(axis=1) + self.size)
        dice[~mine] = 0
        if stop is not None:
            dice[at[:, None] + np.arange(self.reach) >= stop - self.lo] = 0
        end = self.reach - 1 - dice[:, ::-1].argmax(axis=1)
        return dice[np.arange(len(at)), end], at + end

    def windows(self, threshold: float) -> Iterator[tuple[float, int, int]]:
        """(Dice, first, last bigram) of the best window of every start that reaches the threshold."""
        block = max(1, (1 << 18) // self.reach)
        for k in range(0, len(self.starts), block):
            at = self.starts[k : k + block]
            dice, end = self.best(at)
            take = np.flatnonzero(dice >= threshold)
            yield from zip(dice[take].tolist(), (at[take] + self.lo).tolist(), (end[take] + self.lo).tolist(), strict=True)

    def again(self, first: int, stop: int) -> tuple[float, int]:
        dice, end = self.best(np.array([first - self.lo]), stop)
        return float(dice[0]), int(end[0]) + self.lo


def _apart(runs: list[tuple[int, _Run]], threshold: float) -> list[tuple[int, int, float, int]]:
    """(first, last bigram, Dice, template) of the windows that stay: of those that overlap the one with the largest Dice, then the longest, the first, the template's order.

    Each start gives its best window. Where that one meets a window that was chosen before, the start
    is looked at again up to there, so the choice is the same as among all windows of all templates.
    """
    heap = [(-dice, a - b, a, order, n, b) for n, (order, run) in enumerate(runs) for dice, a, b in run.windows(threshold)]
    heapify(heap)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        minus, _, a, order, n, b = heappop(heap)
        at = bisect_left(taken, (a, -1))
        if (at and taken[at - 1][1] >= a) or (at < len(taken) and taken[at][0] == a):
            continue  # starts inside a window that was chosen
        if at < len(taken) and taken[at][0] <= b:
            dice, end = runs[n][1].again(a, taken[at][0])
            if dice >= threshold:
                heappush(heap, (-dice, a - end, a, order, n, end))
            continue
        insort(taken, (a, b))
        out.append((a, b, -minus, order))
    return out


def find(texts: pa.LargeStringArray, library: list[tuple[str, int, int, np.ndarray]], threshold: float) -> list[tuple]:
    """(text number, first word, last word + 1, licence, notice, Dice) of the windows whose Dice with a template reaches the threshold.

    A window with Dice >= t has between t / (2 - t) and (2 - t) / t times as many bigrams as the
    template, so a run of hits is looked at only if it has enough of them, and its gaps are no longer
    than such a window's surplus. Both prunings are exact.
    """
    h, doc, *_ = words(*raw(texts))
    if len(h) < 2:
        return []
    pairs = mix(h[:-1] * np.uint64(BASE) + h[1:]) >> np.uint64(16)
    known = np.unique(np.concatenate([b for *_, b in library]))
    hit = np.flatnonzero((known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs) & (doc[:-1] == doc[1:]))
    held, owner = pairs[hit], doc[hit]
    share = threshold / (2 - threshold)
    found: dict[int, list[tuple[int, _Run]]] = {}
    for order, (_, _, size, template) in enumerate(library):
        own = np.flatnonzero(template[np.minimum(np.searchsorted(template, held), len(template) - 1)] == held)
        if len(own) < share * len(template):
            continue
        at, whose = hit[own], owner[own]
        cut = np.flatnonzero((np.diff(at) > size * (1 / share - 1) + 1) | (whose[1:] != whose[:-1])) + 1
        first, last = np.append(0, cut), np.append(cut, len(at))
        for i in np.flatnonzero(last - first >= share * len(template)):
            run = at[first[i] : last[i]]
            if len(np.unique(pairs[run])) >= share * len(template):
                found.setdefault(int(whose[first[i]]), []).append((order, _Run(pairs, run, size, template, threshold)))
    out = []
    for d, runs in sorted(found.items()):
        start = int(np.searchsorted(doc, d))
        out += [(d, a - start, b + 2 - start, *library[order][:2], dice) for a, b, dice, order in _apart(runs, threshold)]
    return out


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence notice found: doc_id, first_word, end_word, license, notice, dice.

    Whole texts are searched; positions count words from 0. Of overlapping findings the one with the
    largest Dice coefficient stays (then the longest, then the first); of equal templates the first in
    the library. Every window that starts and ends at a known bigram is weighed. Null and empty texts have no finding, and a notice of fewer
    than two words can't be found. Repeated rows and null identifiers give findings of their own.
    Nothing is shuffled; the broadcast library is as large as its notices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(templates(notices))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column(0)[at + d].as_py(), *rest) for at, piece in slices(strings(batch.column(1))) for d, *rest in find(piece, shared.value, threshold)]
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "first_word", "end_word", "license", "notice", "dice"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(scanned, "doc_id long, first_word long, end_word long, license string, notice long, dice double")
