"""License scans: winnowed fingerprints pick candidate templates, banded alignment measures them.

Templates and texts are sequences of words (lower case, without punctuation at their ends). A template's
three-word grams are hashed and winnowed, and an inverted index holds the kept hashes with their templates and
places. A text's grams that the index knows name a template and a diagonal; hits on near diagonals form one
candidate. Each candidate is aligned locally (match, mismatch, gap) within a band around its diagonals, which
gives the words matched, their share of the template, and the span in code points. Of matches that share over half of
the longer one's words, only those of the greatest coverage are reported.

Only words that some template holds are looked at: a gram with another word can't be in the index. Diagonals of one
candidate lie within a template's length of its first, so a band is bounded whatever a text repeats; a candidate is
aligned only where its stretch of the text shares enough words with the template, counted with repeats.

Defined cases: a null or empty text has no matches; a document without matches has no row; repeated rows give
repeated matches; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held, prepare, renamed

GRAM_WORDS = 3
#: Successive grams of which one at least is kept: five words in common suffice to be found.
WINDOW = 3
#: Share of a template's words that must match.
LEAST_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

#: License statements, as their public texts have them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "bsd-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details.""",
    "mit": "Released under the MIT License.",
    "mit-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def plain(word: str) -> str:
    return word.strip(_ENDS).lower()


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash for each run of three word numbers."""
    n = len(ids) - GRAM_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    h = sum((x[k : k + n] * _MULTIPLIERS[k] for k in range(GRAM_WORDS)), np.zeros(n, np.uint64))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def winnow(hashes: np.ndarray) -> list[int]:
    """Places kept: the least hash of each window of successive grams; all of it if it is shorter."""
    if not len(hashes):
        return []
    kept = set()
    for s in range(max(1, len(hashes) - WINDOW + 1)):
        part = hashes[s : s + WINDOW]
        kept.add(s + int(len(part) - 1 - part[::-1].argmin()))
    return sorted(kept)


class Index:
    """The templates' words, numbered from 1, and their kept hashes with (template, place)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, name in enumerate(self.names):
            words = [w for w in map(plain, templates[name].split()) if w]
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
            self.words.append(own)
            hashes = gram_hashes(own)
            for p in winnow(hashes):
                self.found[int(hashes[p])].append((k, p))
        #: How often each word number stands in each template; number 0, a word of no template, never does.
        self.counts = [np.bincount(own, minlength=len(self.vocabulary) + 1) for own in self.words]
        self.keys = np.array(sorted(self.found), np.uint64)
        self.of: dict[str, int] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        """Word numbers: 0 for a word of no template, -1 for one of punctuation alone."""
        of = self.of
        if len(of) > 300_000:
            of.clear()
        out = list(map(of.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    p = plain(words[i])
                    out[i] = of[words[i]] = self.vocabulary.get(p, 0) if p else -1
        return np.array(out, np.int64)


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with text place minus template place in ``low..high``: (matches, first, last).

    The band is one row of numpy arrays per template word. Of equal scores the diagonal step goes first, then the
    skipped template word, then the skipped text word. All but a cell's score hang on the cell its best path comes from.
    """
    width = high - low + 1
    places = np.arange(width)
    score, hits, first = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1)
    best = (0, 0, 0, 0)  # score, matches, first, last
    for t, want in enumerate(template):
        at = places + (t + low)
        inside = (at >= 0) & (at < len(words))
        hit = inside & (words[np.clip(at, 0, len(words) - 1)] == want)
        here = score + np.where(hit, MATCH, MISMATCH)
        count, start = hits + hit, np.where(first >= 0, first, at)
        down = score[1:] + GAP  # a template word left out
        skip = np.nonzero(down > here[:-1])[0]
        here[skip], count[skip], start[skip] = down[skip], hits[skip + 1], first[skip + 1]
        here[~inside | (here <= 0)] = 0
        # Text words left out, any number of them: the best earlier cell less a gap for each; a tie goes to the latest.
        least = np.maximum.accumulate((here - GAP * places) * width + places)
        source = least % width
        here = here[source] + GAP * (places - source)
        count, start = count[source], start[source]
        dead = ~inside | (here <= 0)
        here[dead], count[dead], start[dead] = 0, 0, -1
        ends = np.where(hit & (source == places), here, 0)
        top = int(ends.argmax())
        if ends[top] > best[0]:
            best = (int(ends[top]), int(count[top]), int(start[top]), int(at[top]))
        score, hits, first = here, count, start
    return best[1:]


def _stands_for(a: tuple, b: tuple) -> bool:
    """Whether ``a`` matches better than ``b`` in much the same place, as notices that differ in a few words do."""
    longer = max(a[4] - a[3], b[4] - b[3]) + 1
    return a[1] > b[1] and 2 * (min(a[4], b[4]) - max(a[3], b[3]) + 1) > longer


def _best_in_place(found: list[tuple]) -> list[tuple]:
    """Without the matches that a better one stands for; each is held against those that overlap it only."""
    found = sorted(found, key=lambda x: (x[3], x[4], x[0]))
    gone = set()
    for i, a in enumerate(found):
        for j in range(i + 1, len(found)):
            if found[j][3] > a[4]:
                break
            gone |= {j} if _stands_for(a, found[j]) else {i} if _stands_for(found[j], a) else set()
    return [x for i, x in enumerate(found) if i not in gone]


def matches(text: str | None, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """``(license, coverage, matched words, start, end)`` in order of start."""
    words = (text or "").split()
    numbers = index.numbers(words)
    solid = np.nonzero(numbers >= 0)[0]
    ids = numbers[solid]
    if len(ids) < GRAM_WORDS:
        return []
    known = ids > 0
    runs = np.nonzero(known[:-2] & known[1:-1] & known[2:])[0]
    if not len(runs):
        return []
    hashes = gram_hashes(ids)[runs]
    at = np.searchsorted(index.keys, hashes)
    runs = runs[(at < len(index.keys)) & (index.keys[np.minimum(at, len(index.keys) - 1)] == hashes)]
    if not len(runs):
        return []
    hits: dict[int, list[int]] = defaultdict(list)
    for p in runs:
        for k, place in index.found[int(gram_hashes(ids[p : p + GRAM_WORDS])[0])]:
            hits[k].append(int(p) - place)
    starts, cursor, spot = {}, 0, 0
    needed: list[tuple[str, float, int, int, int]] = []
    for k, diagonals in hits.items():
        template, own, left = index.words[k], index.counts[k], ids
        slack = 2 + len(template) // 8
        group: list[int] = []
        for d in [*sorted(set(diagonals)), None]:
            if group and (d is None or d - group[-1] > slack or d - group[0] > len(template)):
                low, high = group[0] - slack, group[-1] + slack
                from_, to = max(0, low), high + len(template)
                while np.minimum(np.bincount(left[from_:to], minlength=len(own)), own).sum() >= least * len(template):
                    m, first, last = align(template, left, low, high)
                    if not m or m / len(template) < least:
                        break
                    needed.append((index.names[k], m / len(template), m, int(solid[first]), int(solid[last])))
                    left = left.copy() if left is ids else left
                    left[first : last + 1] = 0  # the next match lies beside this one
                group = []
            if d is not None:
                group.append(d)
    needed = _best_in_place(needed)
    if not needed:
        return []
    ends = max(x[4] for x in needed) + 1
    for i in range(ends):
        cursor = text.index(words[i], spot)
        starts[i], spot = cursor, cursor + len(words[i])
    spans = {(n, c, m, starts[a], starts[b] + len(words[b])) for n, c, m, a, b in needed}
    return sorted(spans, key=lambda x: (x[3], x[4], x[0]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, matched_words, start, end``: a row per match; whole texts are read."""
    prepare(docs.sparkSession)
    own, name = dict(templates or TEMPLATES), uuid.uuid4().hex
    kept = renamed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(name, lambda: Index(own))
        for b in batches:
            rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in matches(text, index, least)]
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return kept.mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, start long, end long")
