"""Licence scans with a generalised suffix automaton of licence tokens.

Every template (a notice, a licence's opening words, a phrase) is a path of the automaton.  A text
is streamed through it once: after each word the state and length give the matching statistic, the
longest suffix read so far that some template holds.  Where a match can't go on it is closed;
matches of MIN_MATCH words or more are laid against the templates' own positions and chained where
both advance, and a chain that covers enough of a template is a span with its label.  The base
phrases are read off the same states: a phrase stands at a place exactly if its state is a suffix
of the state there and the match is as long as the phrase.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public licence notices and opening words, by label.
TEMPLATES = {
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
# Identifiers of the SPDX licence list, by label.
SPDX = {
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["Apache-2.0"], "mit": ["MIT", "MIT-0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"], "isc": ["ISC"], "zlib": ["Zlib"], "boost": ["BSL-1.0"],
    "mpl": ["MPL-2.0"], "epl": ["EPL-1.0", "EPL-2.0"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"], "cc0": ["CC0-1.0"],
    "cc-by": ["CC-BY-3.0", "CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"],
}
#: Lines that only count word for word, as one other word makes another licence of them.
TAGS = {label: [f"SPDX-License-Identifier: {x}" for x in ids] for label, ids in SPDX.items()}
MIN_MATCH = 3
#: Words between two matches of one chain, in the text or in the template.
MAX_GAP = 12
MIN_COVER = 0.7
MIN_WORDS = 4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of letters, digits and bytes outside ASCII, with A-Z lower-cased."""
    return text.translate(_WORDS).split()


class Scanner:
    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES, tags: Mapping[str, list[str]] = TAGS):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self.templates: list[tuple[str, int, bool]] = []  # label, words, whether it only counts word for word
        for kind, exact in ((templates, False), (tags, True)):
            for label, text in ((label, text) for label, texts in kind.items() for text in texts):
                words = [self.ids.setdefault(w, len(self.ids)) for w in tokens(text.encode())]
                self._add(words, len(self.templates), ends)
                self.templates.append((label, len(words), exact))
        self.phrases = [([self.ids.setdefault(w, len(self.ids)) for w in tokens(p.encode())], label) for p, label in phrases.items()]
        for words, _ in self.phrases:
            self._add(words, None, ends)
        order = sorted(range(1, len(self.len)), key=lambda v: -self.len[v])
        for v in order:
            if self.link[v] > 0:
                ends[self.link[v]] = sorted({*ends[self.link[v]], *ends[v]})
        self.ends = ends
        mark: list[list[tuple[int, str]]] = [[] for _ in self.len]
        for words, label in self.phrases:
            v = 0
            for w in words:
                v = self.next[v][w]
            mark[v].append((len(words), label))
        for v in reversed(order):  # shorter before longer: what a suffix says holds for the whole
            if self.link[v] > 0:
                mark[v] = mark[v] + mark[self.link[v]]
        self.marks = [tuple(m) for m in mark]

    def _add(self, words: list[int], template: int | None, ends: list) -> None:
        last = 0
        for at, w in enumerate(words):
            last = self._extend(last, w, ends)
            if template is not None:
                ends[last].append((template, at + 1))

    def _new(self, length: int, edges: dict[int, int], link: int, ends: list) -> int:
        self.len.append(length)
        self.next.append(edges)
        self.link.append(link)
        ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int, ends: list) -> int:
        copy = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q], ends)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, w, ends)
        new = self._new(self.len[last] + 1, {}, -1, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, w, ends)
        return new

    def statistics(self, words: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) after each word that some template holds."""
        v = n = 0
        nxt, link, length = self.next, self.link, self.len
        for i, w in enumerate(words):
            if w is None:
                v = n = 0
                continue
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
                yield i, n, v
            else:
                v = n = 0

    def scan(self, text: bytes) -> dict:
        words = tokens(text)
        places, matches = [], []
        before = (-2, 0, 0)
        marks = self.marks
        for now in self.statistics(list(map(self.ids.get, words))):
            i, n, v = now
            if marks[v]:
                places += [(i - size + 1, label) for size, label in marks[v] if n >= size]
            if before[1] >= MIN_MATCH and (i != before[0] + 1 or n != before[1] + 1):
                matches.append(before)
            before = now
        if before[1] >= MIN_MATCH:
            matches.append(before)
        spans = self._chain(matches) if matches else []
        base = sorted({label for _, label in places})
        starts = [a for a, _ in places]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
            "score": 1.0 if places else max((s["cover"] for s in spans), default=0.0), "spans": spans,
        }

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Per template the chains of matches that share no word, best first, by first word."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, n, v in matches:
            for t, end in self.ends[v]:
                by.setdefault(t, []).append((i - n + 1, end - n, n))
        spans = []
        for t, parts in by.items():
            label, size, exact = self.templates[t]
            if exact:
                parts = [p for p in parts if p[2] == size]
            parts.sort()
            taken: list[tuple[int, int]] = []  # first and last words, in order

            def free(first: int, last: int) -> bool:
                k = bisect_right(taken, (last, last))
                return (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last)

            while parts:  # a chain that loses words to a better one may still be long enough without them
                before = len(taken)
                for (a, _, n), (covered, first) in sorted(zip(parts, self._best(parts, size)), key=lambda z: (-z[1][0], z[0][0])):
                    if covered < max(MIN_WORDS, MIN_COVER * size):
                        break
                    if free(first, a + n - 1):
                        insort(taken, (first, a + n - 1))
                        spans.append({"label": label, "template": t, "first_word": first, "last_word": a + n - 1, "cover": min(1.0, covered / size)})
                if len(taken) == before:
                    break
                parts = [p for p in parts if free(p[0], p[0] + p[2] - 1)]
        return sorted(spans, key=lambda s: (s["first_word"], s["template"], s["last_word"]))

    @staticmethod
    def _best(parts: list[tuple[int, int, int]], size: int) -> list[tuple[int, int]]:
        """Covered words and first word of the best chain that ends with each part: text and template both advance."""
        best: list[tuple[int, int]] = []
        for k, (a, x, n) in enumerate(parts):
            top = (n, a)
            for j in range(k - 1, -1, -1):
                b, y, m = parts[j]
                if a - b > size + MAX_GAP * size:
                    break
                lap = max(0, b + m - a, y + m - x)
                if a > b and x > y and lap < n and a - (b + m) <= MAX_GAP and x - (y + m) <= MAX_GAP:
                    top = max(top, (best[j][0] + n - lap, best[j][1]), key=lambda z: (z[0], z[1]))
            best.append(top)
        return best


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, template: int, first_word: long, last_word: long, cover: double>>"


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES, tags: Mapping[str, list[str]] = TAGS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and SCHEMA for every row; of an SPDX expression the first licence is read.

    A null or empty text has no words, no labels and score 0; equal texts get equal results; rows
    with equal or null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates, tags))  # as large as the templates
    spans = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.value.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found], k) for c, k in kinds.items())], ["doc_id", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")
