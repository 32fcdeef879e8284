"""Operator 7: licences found by the Dice coefficient of word bigrams with licence templates.

Texts are normalised (lower case, punctuation to spaces, copyright lines left out). Every run of words, wherever it begins
and ends, whatever lines and paragraphs it spans, is a part that may match a template. Bounds by size prune: a template
allows parts of certain sizes only, and only where so many of its bigrams stand close together that the least coefficient
can be reached are parts compared; no bound loses a match. Of the matches of a text that overlap the best stays.

Null, empty and blank texts, and texts of one word, match nothing. Texts are scanned whole, whatever their length. Of equal
coefficients the larger part wins, then the first part, then the licence's name. Every row is scanned by itself, so repeated
rows get equal results; an empty table gives an empty result. Of columns with the operator's names the operator's stay.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import chained, row_chunks, small_batches, span_hash, span_sums, spans, string_bytes

#: Least Dice coefficient of a match.
LEAST = 0.8

# Names of licences as notices give them, forms of notices, and the texts of short licences.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache 2.0", "the Apache License 2.0"),
    "MIT": ("the MIT License", "MIT"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "the Modified BSD License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GPL version 2", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GPL version 3", "GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "EPL-2.0": ("the Eclipse Public License, version 2.0",),
    "ISC": ("the ISC License",),
    "Zlib": ("the zlib License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "Unlicense": ("the Unlicense",),
    "CC0-1.0": ("CC0 1.0", "the Creative Commons CC0 1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
FORMS = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "This work is licensed under {}", "This software is licensed under {}",
    "This project is licensed under {}", "This program is released under {}", "Released under the terms of {}", "Licensed under the terms of {}",
)
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version {} of the License, or (at your option) any later version. This library is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
General Public License for more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
General Public License for more details."""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed
or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/."""
TEXTS = {
    "MIT": (_MIT,), "Apache-2.0": (_APACHE,), "GPL-3.0": (_GPL.format(3),), "GPL-2.0": (_GPL.format(2),), "LGPL-2.1": (_LGPL.format("2.1"),), "LGPL-3.0": (_LGPL.format(3),), "AGPL-3.0": (_AGPL,),
    "BSD-2-Clause": (_BSD, f"{_BSD}\n{_AS_IS}"), "BSD-3-Clause": (f"{_BSD}\n{_BSD_3}", f"{_BSD}\n{_BSD_3}\n{_AS_IS}"), "ISC": (_ISC, f"{_ISC}\n{_ISC_AS_IS}"), "Zlib": (_ZLIB,), "BSL-1.0": (_BOOST,),
    "Unlicense": (_UNLICENSE,), "CC0-1.0": (_CC0,), "EPL-2.0": (_EPL,), "MPL-2.0": (_MPL,),
}


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every template, by licence."""
    every = [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS]
    return sorted(set(every + [(k, text) for k, texts in TEXTS.items() for text in texts]))


_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[10] = 10


class Bigrams:
    """Hashes of the word bigrams of rows, their rows and the lines on which they begin; they reach over ends of lines, not of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = _PLAIN[data]
        ends = np.flatnonzero(plain == 10) + 1
        bounds = np.union1d(ends, offsets)  # firsts of lines
        s, e, self.row = spans(plain, offsets)
        word = span_hash(span_sums(plain), s, e)
        line = np.searchsorted(bounds, s, "right") - 1
        mark = span_hash(span_sums(np.frombuffer(b"copyright", np.uint8)), np.array([0]), np.array([9]))[0]
        first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
        year = np.zeros(len(word), bool)  # whether a year, (c) or the sign follows on the line
        if len(word) > 1:
            head = plain[s[1:]]
            year[:-1] = ~first[1:] & ((head >= 48) & (head <= 57) | (head == 99) & (e[1:] - s[1:] == 1) | (head == 0xC2))
        notices = line[first & year & (word == mark)]
        if len(notices):
            kept = ~np.isin(line, notices)
            word, self.row, line = word[kept], self.row[kept], line[kept]
        self.pair = chained(word[:-1], word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)
        same = self.row[1:] == self.row[:-1]
        self.pair, self.row, line = self.pair[same], self.row[1:][same], line[:-1][same]
        self.line = line - np.searchsorted(bounds, offsets)[self.row] if len(line) else line


class Template:
    """A licence's bigrams with their counts, and the sizes of parts and the number of shared bigrams that a match needs."""

    def __init__(self, name: str, pairs: np.ndarray, least: float):
        self.name, self.size = name, len(pairs)
        self.pairs, self.counts = np.unique(pairs, return_counts=True)
        self.longest = int(self.size * (2 - least) / least + 1e-9)
        self.fewest = int(np.ceil(self.size * least / (2 - least) - 1e-9))

    def windows(self, at: np.ndarray, code: np.ndarray, least: float, pruned: bool = True) -> list[tuple[float, int, int]]:
        """Best part from every place that can begin a match: coefficient, first and last bigram. ``at`` are the places of shared bigrams."""
        near = np.searchsorted(at, at + self.longest)  # a best part begins and ends with a shared bigram
        seen = np.zeros(len(at), np.int64)
        for c in np.unique(code):
            on = np.flatnonzero(code == c)
            seen[on] = np.arange(1, len(on) + 1)
        base, out = np.zeros(len(self.pairs), np.int64), []
        for a in range(len(at)):
            b = near[a] if pruned else len(at)
            if b - a >= self.fewest or not pruned:
                c = code[a:b]
                dice = 2 * np.cumsum(seen[a:b] - base[c] <= self.counts[c]) / (self.size + at[a:b] - at[a] + 1)
                k = len(dice) - 1 - int(np.argmax(dice[::-1]))
                if dice[k] >= least:
                    out.append((float(dice[k]), int(at[a]), int(at[a + k])))
            base[code[a]] = seen[a]
        return out


class Scanner:
    def __init__(self, least: float, pruned: bool = True):
        self.least, self.pruned, self.known = least, pruned, []
        for name, text in templates():
            data = np.frombuffer(text.replace("\n", " ").encode(), np.uint8)
            pairs = Bigrams(data, np.array([0, len(data)])).pair
            if len(pairs):
                self.known.append(Template(name, pairs, least))
        every = np.concatenate([t.pairs for t in self.known])
        owner = np.repeat(np.arange(len(self.known)), [len(t.pairs) for t in self.known])
        code = np.concatenate([np.arange(len(t.pairs)) for t in self.known])
        order = np.argsort(every, kind="stable")
        self.owner, self.code = owner[order], code[order]
        self.vocabulary, self.start, self.owners = np.unique(every[order], return_index=True, return_counts=True)
        self.fewest = np.array([t.fewest for t in self.known])

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple]]:
        """Matches of every row that has any, the best first: coefficient, licence, first line, number of bigrams."""
        x = Bigrams(data, offsets)
        place = np.minimum(np.searchsorted(self.vocabulary, x.pair), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[place] == x.pair)
        n = self.owners[place[at]]
        slot = np.repeat(self.start[place[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        key = x.row[at] * len(self.known) + self.owner[slot]
        order = np.argsort(key, kind="stable")
        at, slot, key = at[order], slot[order], key[order]
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
        enough = count >= self.fewest[keys % len(self.known)] if self.pruned else count > 0
        found: dict[int, list[tuple]] = {}
        for k, a, m in zip(keys[enough].tolist(), first[enough].tolist(), count[enough].tolist(), strict=True):
            t = self.known[k % len(self.known)]
            for d, i, j in t.windows(at[a : a + m], self.code[slot[a : a + m]], self.least, self.pruned):
                found.setdefault(k // len(self.known), []).append((-d, i - j, i, t.name, j))
        return {row: self._best(parts, x.line) for row, parts in found.items()}

    @staticmethod
    def _best(parts: list[tuple], line: np.ndarray) -> list[tuple]:
        """Parts that don't overlap a better one."""
        kept: list[tuple] = []
        taken: list[tuple[int, int]] = []  # sorted
        for d, size, i, name, j in sorted(parts):
            k = bisect.bisect_left(taken, (i, -1))
            if (k == 0 or taken[k - 1][1] < i) and (k == len(taken) or taken[k][0] > j):
                taken.insert(k, (i, j))
                kept.append((-d, name, int(line[i]), 1 - size))
        return kept


_ADDED = "license string, dice double, line bigint, licenses array<struct<license:string,dice:double,line:bigint,bigrams:bigint>>"


def license_scans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Adds license, dice and first line (from 0) of the best match to every row, null where nothing matches, and all matches (licenses)."""
    added = T.StructType.fromDDL(_ADDED)
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in added.names]
    schema, docs = docs.schema, docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")
    kept: dict[float, Scanner] = {}
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64()), ("bigrams", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept.setdefault(least, Scanner(least))
        for batch in batches:
            rows: list[list[tuple]] = [[] for _ in range(len(batch))]
            for lo, _, data, offsets in row_chunks(*string_bytes(batch.column(at))):
                for k, found in scanner.scan(data, offsets).items():
                    rows[lo + k] = found
            best = [r[0] if r else (None, None, None) for r in rows]
            every = [[{"license": name, "dice": d, "line": line, "bigrams": n} for d, name, line, n in r] for r in rows]
            columns = [pa.array([b[1] for b in best], pa.string()), pa.array([b[0] for b in best], pa.float64()), pa.array([b[2] for b in best], pa.int64()), pa.array(every, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([schema[c] for c in names] + added.fields))
