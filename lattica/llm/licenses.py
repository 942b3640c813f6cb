"""License scans: min-hash of overlapping text windows retrieves templates, exact containment of shingles verifies them.

Windows of a template are twice as long as it and start every template length, so that each occurrence lies whole inside one.
A window that holds four fifths of a template's shingles shares one given min-hash value with it with probability 0.36 or more,
and one of all with 1 - (1 - 0.36)^32 > 0.999999.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A

HASHES, SEED, WIDTH, PERCENT = 32, 61, 5, 80

# License notices as their stewards publish them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}


def compiled(templates: dict[str, str], width: int = WIDTH) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(name, words of a shingle, sorted shingles, min-hash values); templates of fewer words than `width` have one shingle."""
    out = []
    for name, text in sorted(templates.items()):
        raw, off = A.string_bytes(pa.array([text]))
        w = A.Words(raw, off)
        if not len(w.start):
            continue
        own = min(width, len(w.start))
        h, o = A.distinct_sets(*A.shingles(w.hashes(), w.row, w.count, own), 1)
        out.append((name, own, h, A.minhash(h, o, HASHES, SEED)[0]))
    return out


def stretches(at: np.ndarray, shingle: np.ndarray, size: int, percent: int) -> list[tuple[int, int, float]]:
    """(first place, last place, containment) of the copies of a template of `size` shingles, from the places of its shingles in a
    text, in one pass: a copy begins where the next two template lengths hold enough of them and most of all places near by, and ends
    with the last new one, or before one that it already has. The next copy begins behind it.
    """
    need, n = -(-percent * size // 100), len(at)
    seen, held, to, many = np.zeros(size, np.int64), 0, 0, np.zeros(n, np.int64)
    for k in range(n):  # how many distinct ones begin at each place
        while to < n and at[to] < at[k] + 2 * size:
            held += seen[shingle[to]] == 0
            seen[shingle[to]] += 1
            to += 1
        many[k] = held
        seen[shingle[k]] -= 1
        held -= seen[shingle[k]] == 0
    out, k = [], 0
    while k < n:
        if many[k] < need:
            k += 1
            continue
        near = int(np.searchsorted(at, at[k] + max(1, size // 4)))
        k += int(np.argmax(many[k:near]))
        mine, last = set(), k
        for j in range(k, n):
            if at[j] >= at[k] + 2 * size or len(mine) >= need and shingle[j] in mine:
                break
            if shingle[j] not in mine:
                mine.add(shingle[j])
                last = j
        if len(mine) >= need:
            out.append((int(at[k]), int(at[last]), len(mine) / size))
            k = last + 1
        else:
            k += 1
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, license, start, stop, containment) for each place of docs (doc_id, text) that holds `percent` of a template's shingles.

    start and stop are the bytes from the first to the last matching shingle. Copies one behind the other give a row each; a template
    that is part of another one is reported besides it. Texts that are null, empty or hold no template have no row; null ids stay null; rows repeated
    whole are scanned as often. Other columns are ignored.
    """
    known = compiled(TEMPLATES if templates is None else templates, width)

    def scan(w: A.Words, own: int, group: list) -> list[tuple]:
        hashes = w.hashes()
        n = len(hashes)
        if n < own:
            return []
        # the first word of a shingle is its place, so shingles of a row keep the order of its words
        h, row = A.shingles(hashes, w.row, np.where(w.count >= own, w.count, 0), own)
        if not len(h):
            return []
        place = np.flatnonzero(w.row[: n - own + 1] == w.row[own - 1 :])
        off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=w.rows))])
        factors = A.seeds(HASHES, SEED)
        lengths = sorted({len(t[2]) for t in group})
        windows = {}
        for m in lengths:
            blocks = -(-np.diff(off) // m)
            first = np.repeat(off[:-1], blocks) + m * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            windows[m] = (first, np.repeat(np.arange(w.rows), blocks))
        hit = [np.zeros(len(windows[len(t[2])][0]), bool) for t in group]
        for k in range(HASHES):
            v = h * factors[k]
            for m in lengths:
                first, of = windows[m]
                low = np.minimum.reduceat(v, first)
                low[:-1] = np.where(of[1:] == of[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                for t, x in zip(group, hit, strict=True):
                    if len(t[2]) == m:
                        x |= low == t[3][k]
        out = []
        for t, x in zip(group, hit, strict=True):
            first, of = windows[len(t[2])]
            k = np.flatnonzero(x)
            if not len(k):
                continue
            # windows that overlap are looked through as one stretch of a row
            cut = np.flatnonzero(np.concatenate([[True], (of[k[1:]] != of[k[:-1]]) | (k[1:] > k[:-1] + 2)]))
            for lo, last in zip(k[cut], k[np.append(cut[1:], len(k)) - 1], strict=True):
                end = min(first[last] + 2 * len(t[2]), off[of[lo] + 1])
                own_at = np.flatnonzero(np.isin(h[first[lo] : end], t[2])) + first[lo]
                for i, j, share in stretches(own_at, np.searchsorted(t[2], h[own_at]), len(t[2]), percent):
                    out.append((of[lo], t[0], int(w.start[place[i]]), int(w.end[place[j] + own - 1]), share))
        return out

    def run(batches):
        groups: dict[int, list] = {}
        for t in known:
            groups.setdefault(t[1], []).append(t)
        for batch in batches:
            raw, off = A.string_bytes(batch.column(1))
            found = []
            for a, b in A.slices(off):
                w = A.Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                for own, group in groups.items():
                    found += [(r + a, name, s - (off[r + a] - off[a]), e - (off[r + a] - off[a]), v) for r, name, s, e, v in scan(w, own, group)]
            found.sort(key=lambda x: (x[0], x[2], x[1]))
            cols = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], ["doc_id", "license", "start", "stop", "containment"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(A.tidy(run), "doc_id long, license string, start long, stop long, containment double")
