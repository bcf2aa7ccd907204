"""Licence scans: Dice coefficient over word bigrams against templates.

Texts and templates are lower-cased and reduced to runs of letters and digits.
A passage of about a template's length is a match if the Dice coefficient of
their sets of word bigrams reaches ``threshold``. Size bounds prune: two sets
of sizes a and b reach t only if 2 min(a, b) >= t (a + b), so a text needs at
least t m / (2 - t) of a template's m bigrams before any passage of it is
compared, and passages are sought only where that many stand within (2 - t) / t
times the template's length, which no passage may exceed.

The templates are a fixed list of a few kilobytes. One scan, no shuffle; memory
is bounded by a block of texts or the longest text.

The list holds notices and short licences, not the thousands of words of the
long ones; those are found by the notices that accompany them.

Defined results: null or empty texts match nothing; equal rows get equal
results; a very long text is searched whole; of matches that overlap, the one
with the higher coefficient stays, then the longer, then the one whose template
comes first; an empty table gives an empty result. Input columns may have any
name; those that carry the name of a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .text import inner_name, shielded

# Public licence texts and notices. (id, class, text)
TEMPLATES = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permissive", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("Zlib", "permissive", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not
be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "copyleft", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", "copyleft", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "copyleft", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", "copyleft", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("EPL-2.0", "copyleft", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("MPL-2.0", "copyleft", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "reserved", "All rights reserved."),
)

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
MATCH = "array<struct<licence:string,class:string,dice:double,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("licence", pa.string()), ("class", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _bigrams(data: np.ndarray, offsets: np.ndarray):
    starts, ends, fw = wh.words_in(_FOLD[data], offsets)
    h = wh.word_hashes(_FOLD[data], starts, ends)
    return starts, ends, fw, wh.window_hashes(h, 2)


@lru_cache
def templates() -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """Each template's bigrams and length; all bigrams, sorted, and whether each template has them."""
    sets, lengths = [], []
    for _, _, text in TEMPLATES:
        raw = np.frombuffer(text.encode(), np.uint8)
        two = _bigrams(raw, np.array([0, len(raw)]))[3]
        sets.append(np.unique(two))
        lengths.append(len(two))
    every = np.unique(np.concatenate(sets))
    has = np.stack([np.isin(every, s) for s in sets])
    return sets, lengths, every, has


def _passages(two: np.ndarray, hit: np.ndarray, wanted: np.ndarray, length: int, threshold: float) -> list[tuple[float, int, int]]:
    """(dice, first, end) in bigrams of passages that match one template."""
    m = len(wanted)
    least = max(1, int(np.ceil(threshold * m / (2 - threshold) - 1e-9)))
    hits = np.flatnonzero(hit)
    if len(hits) < least:
        return []
    most = int(length * (2 - threshold) / threshold + 1e-9)
    values, out, i = two.tolist(), [], 0
    at = hits.tolist()
    while i + least <= len(at):
        # runs of hits whose neighbours of ``least`` hits lie within the greatest length
        if at[i + least - 1] - at[i] + 1 > most:
            i += 1
            continue
        best = None
        shared: set[int] = set()
        every: set[int] = set()
        done = at[i]
        for j in range(i, len(at)):
            if at[j] - at[i] + 1 > most:
                break
            shared.add(values[at[j]])
            every.update(values[done : at[j] + 1])
            done = at[j] + 1
            dice = 2 * len(shared) / (m + len(every))
            if len(shared) >= least and dice >= threshold and (best is None or dice > best[0]):
                best = (dice, at[i], at[j] + 1, j)
        if best:
            out.append(best[:3])
            i = best[3] + 1
        else:
            i += 1
    return out


def match_text(two: np.ndarray, threshold: float) -> list[tuple[float, int, int, int]]:
    """Chosen matches (dice, first, end, template) of one text's bigrams, by place.

    Of the matches found, better ones go first. What lies between those chosen is
    searched again on its own, so no passage is lost to a match that it does not
    overlap.
    """
    sets, lengths, every, has = templates()
    at = np.searchsorted(every, two)
    at[at == len(every)] = 0
    known = every[at] == two
    chosen: list[tuple[float, int, int, int]] = []
    open_ = [(0, len(two))]
    while open_:
        lo, hi = open_.pop()
        found = []
        for which, (wanted, length) in enumerate(zip(sets, lengths, strict=True)):
            found += [(-d, a - b, which, a, b) for d, a, b in _passages(two[lo:hi], known[lo:hi] & has[which][at[lo:hi]], wanted, length, threshold)]
        taken: list[tuple[int, int]] = []
        for d, _, which, a, b in sorted(found):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b))
                chosen.append((-d, lo + a, lo + b, which))
        if taken:
            edges = [0, *[x for t in taken for x in t], hi - lo]
            open_ += [(lo + edges[i], lo + edges[i + 1]) for i in range(0, len(edges), 2) if edges[i] < edges[i + 1]]
    return sorted(chosen, key=lambda x: x[1:3])


def _scan(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, _, every, _ = templates()
        fewest = min(max(1, int(np.ceil(threshold * len(s) / (2 - threshold) - 1e-9))) for s in sets)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            out: list[list[dict]] = [[]] * batch.num_rows
            for first, _, data, offsets in wh.text_blocks(column):
                starts, ends, fw, two = _bigrams(data, offsets)
                if not len(two):
                    continue
                at = np.searchsorted(every, two)
                at[at == len(every)] = 0
                count = np.concatenate([[0], np.cumsum(every[at] == two), [0]])
                count[-1] = count[-2]
                last = np.maximum(fw[1:] - 1, fw[:-1])
                for i in np.flatnonzero(count[np.minimum(last, len(count) - 1)] - count[np.minimum(fw[:-1], len(count) - 1)] >= fewest):
                    raw = data[offsets[i] : offsets[i + 1]]
                    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    s, e = starts[fw[i] : fw[i + 1]] - offsets[i], ends[fw[i] : fw[i + 1]] - offsets[i]
                    out[first + int(i)] = [
                        {"licence": TEMPLATES[w][0], "class": TEMPLATES[w][1], "dice": d, "start": int(char[s[a]]), "end": int(char[e[b]])}
                        for d, a, b, w in match_text(two[fw[i] : fw[i + 1] - 1], threshold)
                    ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _TYPE)], [*batch.schema.names[:-1], "matches"])

    return run


def scan_licences(df: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """All input columns but the text, ``matches``, ``n_matches``, ``licence`` (of the best match) and ``spans``.

    Places are in code points of the text, end exclusive.
    """
    own_text = inner_name(df, text)
    df, back = shielded(df, ["matches", "n_matches", "licence", "spans", text])
    keep = [c for c in df.columns if c != own_text]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = df.select(*keep, own_text).mapInArrow(_scan(threshold), ", ".join([*[f"{c} {types[c]}" for c in keep], f"matches {MATCH}"]))
    best = F.array_max(F.transform("matches", lambda x: F.struct(x["dice"].alias("d"), (x["end"] - x["start"]).alias("n"), x["licence"].alias("licence"))))
    return out.select(
        *back,
        "matches",
        F.size("matches").cast("long").alias("n_matches"),
        best["licence"].alias("licence"),
        F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["licence"], x["start"], x["end"])), ",").alias("spans"),
    )
