"""Licence scans: spans of a text against licence templates, by the Dice coefficient of their word bigrams.

Spans are lines, paragraphs (between blank lines), the whole text, and windows of words: where a text has enough of a template's
bigrams, the windows from one shared bigram to another are compared at every place (up to twice as many words as the upper size
bound, as words may repeat), and of those that overlap the best counts, if it fits better than the lines, paragraphs and whole
texts that it overlaps. So a licence, altered or not, is found across paragraphs, between prose and within a line. A span of a
distinct bigrams and a template of b can reach the coefficient t only if a lies between b t / (2 - t) and b (2 - t) / t, and only if it has that
lower bound of the template's bigrams; spans that fail either for every template are never compared.
Words are lower-cased runs of letters and digits, told apart by 64-bit hashes, as are bigrams.

Defined results: null and empty texts, and texts without two words, have no licence (names empty, best null, dice 0). A tie for
the best goes to the name that sorts first. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.words import _IN_WORD, _LOWER, _SYMBOL, mixed, pieces, raw_text, run_hashes, runs

LEAST = 0.8

# Notices and short licence texts, by SPDX name; ``licence_texts`` holds long ones.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
        do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


TEMPLATES["BSD-2-Clause"] = [
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
]
TEMPLATES["BSD-3-Clause"] = [
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
        CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
]
TEMPLATES["LGPL-2.1"] = [
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Lesser General Public License for more details."""
]
TEMPLATES["LGPL-3.0"] = [
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Lesser General Public License for more details."""
]
TEMPLATES["AGPL-3.0"] = [
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU Affero General Public License for more details."""
]
TEMPLATES["Unlicense"] = [
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
        to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
]
TEMPLATES["EPL-2.0"] = [
    """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/"""
]
for _file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))


def _bigrams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of words, hash of each word with the next, and whether both are in one text."""
    low = _LOWER[raw]
    starts, ends = runs(_IN_WORD[low], bounds)
    words = run_hashes(_SYMBOL[low], starts, ends)
    text = np.searchsorted(bounds, starts, side="right")
    pair = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
    return starts, pair, text[:-1] == text[1:] if len(words) > 1 else np.zeros(0, bool)


def _distinct(text: str) -> np.ndarray:
    return np.unique(_bigrams(*raw_text(pa.array([text])))[1])


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of bigrams, each sorted."""
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) + len(b) else 0.0


def _spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of all lines, paragraphs and whole texts; equal spans once."""
    breaks = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([bounds, breaks + 1]))
    starts, ends = edges[:-1], edges[1:]
    visible = np.concatenate([[0], np.cumsum((raw != 32) & (raw != 9) & (raw != 13) & (raw != 10))])
    blank = visible[ends] == visible[starts]
    fresh = np.isin(starts, bounds)
    # A paragraph starts at a text's first line and after a blank line, and ends before the next start.
    opens = np.flatnonzero(~blank & (fresh | np.concatenate([[True], blank[:-1]])))
    text_end = bounds[np.searchsorted(bounds, starts[opens], side="right")] if len(opens) else opens
    blank_starts = np.append(starts[blank], len(raw))
    para_end = np.minimum(text_end, blank_starts[np.searchsorted(blank_starts, starts[opens])]) if len(opens) else opens
    full = np.flatnonzero(np.diff(bounds))
    pairs = np.stack([np.concatenate([starts, starts[opens], bounds[full]]), np.concatenate([ends, para_end, bounds[full + 1]])], axis=1)
    pairs = np.unique(pairs, axis=0)
    return pairs[:, 0], pairs[:, 1], np.searchsorted(bounds, pairs[:, 0], side="right") - 1


def _windows(pair: np.ndarray, hit: np.ndarray, size: int, least: float, taken: list[tuple[int, int, float]]) -> list[tuple[float, int, int]]:
    """Dice coefficient, start and end of the windows of a text's bigrams that fit a template of ``size`` of them, that do not
    lie in a span of ``taken`` (start, end, coefficient) and fit better than each of them that they overlap.

    ``hit`` marks the template's bigrams. Trimming others from its ends only betters a window, so it starts and ends at a hit.
    """
    order = np.argsort(pair, kind="stable")
    before = np.full(len(pair), -1)
    again = pair[order[1:]] == pair[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    longest = 2 * int(size * (2 - least) / least + 1e-9)
    low = int(np.ceil(size * least / (2 - least) - 1e-9))
    limit = np.minimum(np.arange(len(pair)) + longest, len(pair))
    # Where a window must end at least, to reach beyond every fitting span that it starts in.
    beyond = np.zeros(len(pair), np.int64)
    for s, e, _ in taken:
        beyond[s:e] = np.maximum(beyond[s:e], e + 1)
    total = np.concatenate([[0], np.cumsum(hit)])
    # Only starts with enough hits ahead.
    starts = np.flatnonzero(hit & (total[limit] - total[:-1] >= low) & (limit >= beyond))

    def best_from(i: int) -> tuple[float, int, int]:
        fresh = before[i : limit[i]] < i
        values = 2 * np.cumsum(fresh & hit[i : limit[i]]) / (np.cumsum(fresh) + size)
        skip = max(0, int(beyond[i]) - i - 1)
        k = skip + int(values[skip:].argmax())
        return float(values[k]), i, i + k + 1

    def better(w: tuple[float, int, int]) -> bool:
        return w[0] >= least and all(w[0] > v for s, e, v in taken if s < w[2] and w[1] < e)

    found, at = [], 0
    for k, i in enumerate(starts):
        if i < at:
            continue
        best = best_from(int(i))
        if better(best):
            # A later start within the window, or within a better one found so, may fit better.
            j = k + 1
            while j < len(starts) and starts[j] < best[2]:
                later = best_from(int(starts[j]))
                if later[0] > best[0] and better(later):
                    best = later
                j += 1
            found.append(best)
            at = best[2]
    return found


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, list[str]], least: float) -> Iterator[pa.RecordBatch]:
    known = [(name, _distinct(text)) for name in sorted(templates) for text in templates[name]]
    sizes = np.array([len(b) for _, b in known])
    low, high = np.ceil(sizes * least / (2 - least) - 1e-9), np.floor(sizes * (2 - least) / least + 1e-9)
    every = np.unique(np.concatenate([b for _, b in known]))
    member = np.stack([np.isin(every, b, assume_unique=True) for _, b in known])
    for batch in (p for b in batches for p in pieces(b, "text")):
        raw, bounds = raw_text(batch.column("text"))
        starts, pair, joined = _bigrams(raw, bounds)
        code = np.minimum(np.searchsorted(every, pair), len(every) - 1)
        met = joined & (every[code] == pair)
        hits = np.concatenate([[0], np.cumsum(met)])
        begin, end, text = _spans(raw, bounds) if len(raw) else (np.zeros(0, np.int64),) * 3
        # Bigrams of a span: from its first word to its last but one.
        first = np.searchsorted(starts, begin)
        last = np.maximum(np.searchsorted(starts, end) - 1, first)
        shared = hits[np.minimum(last, len(pair))] - hits[np.minimum(first, len(pair))]
        found: list[dict[str, float]] = [{} for _ in range(batch.num_rows)]
        spans = np.zeros(batch.num_rows, np.int64)
        covers: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
        fits: list[dict[str, list[tuple[int, int, float]]]] = [{} for _ in range(batch.num_rows)]
        for k in np.flatnonzero(shared >= low.min()):
            own = np.unique(pair[first[k] : last[k]])
            best = 0.0
            for t in np.flatnonzero((low <= len(own)) & (len(own) <= high) & (low <= shared[k])):
                name, template = known[t]
                value = dice(own, template)
                if value >= least:
                    found[text[k]][name] = max(value, found[text[k]].get(name, 0.0))
                    fits[text[k]].setdefault(name, []).append((first[k], last[k], value))
                    covers[text[k]].append((first[k], last[k], t))
                    best = max(best, value)
            spans[text[k]] += best > 0
        begins = np.searchsorted(starts, bounds)
        stops = np.maximum(begins[1:] - 1, begins[:-1])
        for r in np.flatnonzero(hits[np.minimum(stops, len(pair))] - hits[np.minimum(begins[:-1], len(pair))] >= low.min()):
            b, e = begins[r], stops[r]
            has = member[:, np.unique(code[b:e][met[b:e]])].sum(axis=1)
            places = []
            for t in np.flatnonzero(has >= low):
                name = known[t][0]
                hit = met[b:e] & member[t][code[b:e]]
                taken = [(s - b, z - b, v) for s, z, v in fits[r].get(name, [])]
                places += [(s + b, z + b, t, value) for value, s, z in _windows(pair[b:e], hit, int(sizes[t]), least, taken)]
            # Longest first; a window counts within a span of another licence only if most of what it shares is not that licence's own.
            reach, kept = -1, []
            for s, z, t, value in sorted(places, key=lambda w: (w[0] - w[1], w)):
                own = code[s:z][met[s:z]]
                own = own[member[t][own]]
                if any(x <= s and z <= y and z - s < y - x and known[u][0] != known[t][0] and 2 * member[u][own].sum() > len(own) for x, y, u in covers[r]):
                    continue
                covers[r].append((s, z, t))
                found[r][known[t][0]] = max(value, found[r].get(known[t][0], 0.0))
                kept.append((s, z))
            # Windows of several templates at one place count once.
            for s, z in sorted(kept):
                spans[r] += s >= reach
                reach = max(reach, z)
        names = [",".join(sorted(f)) for f in found]
        best_names = [min(f, key=lambda n: (-f[n], n)) if f else None for f in found]
        values = [max(f.values(), default=0.0) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(names, pa.string()), pa.array(best_names, pa.string()), pa.array(values, pa.float64()), pa.array(spans)],
            names=["id", "licences", "best", "dice", "n_spans"],
        )


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, licences`` (sorted names), ``best``, its ``dice``, and how many spans match (``n_spans``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("licences string, best string, dice double, n_spans long").fields])
    return rows.mapInArrow(lambda b: _scan(b, templates, least), schema).withColumnRenamed("id", id_col)
