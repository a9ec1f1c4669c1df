"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates and texts are sets of five-word shingles of the plain text (Latin letters
lower-cased, other ASCII marks dropped). A template of up to c shingles, c a power of two, is looked for in windows
of 2c shingles, one every c, so a whole occurrence lies in a window, and its share of the
window is at least 1/4. With 0.8 of the template there, the two sets' Jaccard similarity
is at least 1/6; BANDS bands of one row meet with probability 1 - (5/6) ** 48 = 0.9998 or
more. A candidate counts if at least LEAST of the template's shingles are in the window.

Edge cases: null and empty texts match nothing; a template shorter than a shingle is one
shingle of all its words; several licenses in a text are one row each, with the best
place; an empty table gives no rows; repeated rows are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .decontam import plain

WIDTH, BANDS, LEAST = 5, 48, 0.8
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Public license notices, and whole texts of the short licenses, by identifier.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", _GRANT, _GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END],
    "0BSD": [_ISC + ". " + _ISC_END],
    "BSD-2-Clause": [_BSD, f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": [_BSD_3, f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_END}"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
_random = np.random.RandomState(4)
_TIMES = (_random.randint(0, 1 << 31, BANDS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_PLUS = _random.randint(0, 1 << 32, BANDS, dtype=np.int64).astype(np.uint32)


def shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row in order, and the row of each."""
    data, offsets = plain(*K.utf8(column))
    start, end, row = K.words(data, offsets)
    return K.shingles(K.Rolling(data).spans(start, end), row, len(offsets) - 1, WIDTH)


def _hash(values: np.ndarray, k: int) -> np.ndarray:
    return ((values >> K.U64(32)).astype(np.uint32) ^ _PLUS[k]) * _TIMES[k]


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        texts = [(name, t) for name, variants in sorted(templates.items()) for t in variants]
        values, row = shingled(pa.array([t for _, t in texts], pa.string()))
        self.names, self.sets = [n for n, _ in texts], [np.unique(values[row == i]) for i in range(len(texts))]
        self.sizes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.sizes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        # for each window size and band the templates by their least hash, to be looked up by it
        self.least: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c, ids in self.sizes.items():
            tables = []
            for k in range(BANDS):
                own = np.array([_hash(self.sets[i], k).min() for i in ids], np.uint32)
                order = np.argsort(own, kind="stable")
                tables.append((own[order], np.array(ids)[order]))
            self.least[c] = tables

    def candidates(self, values: np.ndarray, row: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(template, row, from, to) for each window that shares a band with a template."""
        out: set[tuple[int, int, int, int]] = set()
        n = len(values)
        edges = {}
        for c in self.sizes:
            # blocks of c shingles from the start of each row; a window is two neighbouring blocks of a row
            at = np.flatnonzero((np.arange(n) - first) % c == 0)
            last = np.append(row[at[1:]] != row[at[:-1]], True)
            edges[c] = at, last
        for k in range(BANDS):
            x = _hash(values, k)
            for c in self.sizes:
                at, last = edges[c]
                block = np.minimum.reduceat(x, at) if c > 1 else x
                window = block.copy()
                window[:-1] = np.where(last[:-1], block[:-1], np.minimum(block[:-1], block[1:]))
                least, ids = self.least[c][k]
                lo, hi = np.searchsorted(least, window), np.searchsorted(least, window, "right")
                for w in np.flatnonzero(lo < hi):
                    two = w + (0 if last[w] else 1)
                    end = at[two + 1] if two + 1 < len(at) else n
                    out.update((int(i), int(row[at[w]]), int(at[w]), int(end)) for i in ids[lo[w] : hi[w]])
        return out

    def find(self, column: pa.Array) -> list[tuple[int, str, float, int]]:
        """row, license, containment and place (in shingles of the row) of the best match of each license."""
        values, row = shingled(column)
        if not len(values):
            return []
        first = np.searchsorted(row, row)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for i, r, a, b in self.candidates(values, row, first):
            part = values[a:b]
            inside = np.isin(self.sets[i], part)
            share = float(inside.mean())
            if share >= LEAST:
                place = a + int(np.isin(part, self.sets[i]).argmax()) - int(first[a])
                key, found = (r, self.names[i]), (share, -place)
                best[key] = max(best.get(key, found), found)
        return [(r, name, share, -place) for (r, name), (share, place) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, containment, place: each license found in each document, from whole texts. Templates are a parameter and go with the task."""
    known = Templates(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = K.utf8(batch.column("text"))[1]
            for a, b in K.chunks(sizes, 1 << 19):
                found = known.find(batch.column("text")[a:b])
                if found:
                    r, name, share, place = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([a + x for x in r])), pa.array(name), pa.array(share), pa.array(place, pa.int64())], ["doc_id", "license", "containment", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.lean(run), "doc_id long, license string, containment double, place long")
