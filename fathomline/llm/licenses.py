"""License scans by patience alignment.

Texts and templates are words (lower-cased letters and digits). Words that stand once in
a template tell where a notice would begin; places that agree make a window of about the
template's length, so that every notice in a long text, or repeated in it, is aligned on
its own. In a window, words that occur once in both are anchors; the longest increasing
subsequence of anchors keeps order; the gaps between anchors are aligned in the same way,
and a gap without anchors by extending equal words from both of its ends. Of the aligned
words the stretch counts that gains most, a word in between costing half an aligned one.
Coverage is the share of the template's words in it.

The best covered windows are taken first. Windows that reach into a notice taken are cut
at its borders and aligned again, until nothing more is found.

Templates are a list of (name, text) of fixed size; scanning is a map over whole texts
without a shuffle, a few MB of text at a time (one very long text whole). A template is
only aligned where its share of distinct words in the document could reach the threshold
(an upper bound, so nothing is lost).

Defined results: a null or wordless text has no licenses; all notices are returned, best
covered first; equal coverage goes to the longer span, then the name, then the place;
notices of different templates may overlap, those of one template do not; repeated rows
alike; an empty table gives an empty one; extra columns pass through, and a column named
licenses raises ValueError.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomline.llm.worker import bounded_batches, slices, worker_cache


@dataclass(frozen=True)
class LicenseParams:
    min_coverage: float = 0.75
    slack: float = 0.5


# Names and texts of public notices.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"),
)

_WORDS = re.compile(r"[^\W_]+")
LICENSES = T.ArrayType(
    T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, places, before = [], [], []
    for place, value in enumerate(values):
        at = bisect_left(tails, value)
        before.append(places[at - 1] if at else -1)
        tails[at : at + 1] = [value]
        places[at : at + 1] = [place]
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a and b, ascending in both. Gaps wait on a list instead of the call stack."""
    found, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b.get(w) == 1}
        pairs = [(once[w], j) for j, w in enumerate(b[b0:b1], b0) if w in once]
        kept = [pairs[i] for i in _increasing([i for i, _ in pairs])]
        if not kept:
            continue
        found += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(found)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.counts = Counter(self.words)
        #: Places in the template of words that stand in it once (of all words, if none does).
        self.places = {w: [i] for i, w in enumerate(self.words) if self.counts[w] == 1}
        if not self.places:
            for i, w in enumerate(self.words):
                self.places.setdefault(w, []).append(i)

    def bound(self, present: set[str]) -> float:
        return sum(n for w, n in self.counts.items() if w in present) / len(self.words)


def _densest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch of aligned pairs with the most pairs less half of the words between them."""
    best, best_at, run, begin = 0.0, (0, 0), 0.0, 0
    for k, (i, _) in enumerate(pairs):
        gap = (i - pairs[k - 1][0] - 1) / 2 if k else 0.0
        if run - gap > 0:
            run += 1 - gap
        else:
            run, begin = 1.0, k
        if run > best:
            best, best_at = run, (begin, k + 1)
    return pairs[best_at[0] : best_at[1]]


def _notices(words: list[str], where: dict[str, list[int]], t: Template, params: LicenseParams) -> list[dict]:
    """Spans of one template, not overlapping."""
    size = len(t.words)
    begins = sorted({i - place for w, places in t.places.items() for i in where.get(w, ()) for place in places})
    waiting: list[tuple[int, int]] = []
    for b in begins:
        # Places that agree but for a few words more or less.
        if waiting and b - waiting[-1][0] <= size // 8:
            waiting[-1] = (waiting[-1][0], b)
        else:
            waiting.append((b, b))
    taken: list[tuple[int, int]] = []
    out: list[dict] = []
    tried: dict[tuple[int, int], tuple] = {}

    def aligned(low: int, high: int) -> tuple:
        """(aligned words, start, end) of a window."""
        if (low, high) not in tried:
            pairs = ()
            if sum((Counter(words[low:high]) & t.counts).values()) >= params.min_coverage * size:
                pairs = _densest(align(words[low:high], t.words))
            tried[low, high] = (len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1) if pairs else (0, 0, 0)
        return tried[low, high]

    while waiting:
        found, rest = [], []
        for first, last in waiting:
            middle = (first + last + size) // 2
            at = bisect_left(taken, (middle + 1, 0))
            if at and taken[at - 1][1] > middle:
                continue  # inside a notice taken
            free = (taken[at - 1][1] if at else 0), (taken[at][0] if at < len(taken) else len(words))
            pads = sorted({0, *(int(size * params.slack * part) + 1 for part in (0.5, 1.0))})
            best = max((aligned(max(free[0], first - pad), min(free[1], last + size + pad)) for pad in pads), key=lambda x: (x[0], x[1] - x[2]))
            if best[0] >= params.min_coverage * size:
                found.append((-best[0], best[2] - best[1], best[1], best[2], (first, last)))
            else:
                rest.append((first, last))
        before = len(taken)
        for covered, _, start, end, place in sorted(found):
            at = bisect_left(taken, (start, 0))
            if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                rest.append(place)
                continue
            insort(taken, (start, end))
            out.append({"license": t.name, "coverage": -covered / size, "start": start, "end": end})
        if len(taken) == before:
            break
        waiting = sorted(rest)
    return out


def scan(text: str | None, templates: list[Template], params: LicenseParams) -> list[dict]:
    words = words_of(text)
    if not words:
        return []
    present, out, where = set(words), [], None
    for t in templates:
        if t.bound(present) < params.min_coverage:
            continue
        if where is None:
            where = {}
            for i, w in enumerate(words):
                where.setdefault(w, []).append(i)
        out += _notices(words, where, t, params)
    out.sort(key=lambda s: (-s["coverage"], -(s["end"] - s["start"]), s["license"], s["start"]))
    return out


def find(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """docs with licenses: (license, coverage, start, end) in words, best covered first."""
    if "licenses" in docs.columns:
        raise ValueError("column licenses would be overwritten")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("licenses", LICENSES)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("licenses")
        built = [Template(name, body) for name, body in templates]
        for batch in slices(batches, text):
            found = [scan(t, built, params) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.append_column("licenses", pa.array(found, kind))

    return docs.mapInArrow(run, schema)
