"""License scans by patience alignment.

Every document is scanned for pairs of neighbouring words of the templates; where some lie close
together, the region around them is aligned with the template: words unique to both sides anchor the
alignment, the longest increasing sequence of anchors is kept, and the gaps between are aligned the same
way. The share of the template's words that align is its coverage. A short template can fit without a pair of
neighbours, so its regions are the spans that hold enough of its single words.

Words are lower-cased runs of letters and digits. Null or empty text and an empty table: no rows. Each notice in a text is a
row, repeated rows and ids each have theirs, a null id is told as null; where several templates fit one place, each is told.
Extra columns are ignored. Templates are a parameter, or a table that ``templates_from`` reads, of at most MAX_TEMPLATE_WORDS words in
all; they travel with the tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.kit import U64, Tokens, portions, utf8, windows, within

MAX_TEMPLATE_WORDS = 1_000_000

#: The notices as their licenses give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising in both: the patience alignment of a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        anchors = _rising(_unique_pairs(a, i0, i1, b, j0, j1))
        if not anchors:
            continue
        edge_i, edge_j = i0, j0
        for i, j in anchors:
            out.append((i, j))
            todo.append((edge_i, i, edge_j, j))
            edge_i, edge_j = i + 1, j + 1
        todo.append((edge_i, i1, edge_j, j1))
    return sorted(out)


def _unique_pairs(a: list, i0: int, i1: int, b: list, j0: int, j1: int) -> list[tuple[int, int]]:
    """(i, j) of the words that occur once in each, by i."""

    def once(x, lo, hi):
        at: dict = {}
        for k in range(lo, hi):
            at[x[k]] = -1 if x[k] in at else k
        return {w: k for w, k in at.items() if k >= 0}

    mine, other = once(a, i0, i1), once(b, j0, j1)
    return sorted((i, other[w]) for w, i in mine.items() if w in other)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs that rises in j, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
        back[k] = piles[p - 1] if p else -1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates as word hashes, with an index of their word pairs."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        words = [Tokens([t.encode()]).h for t in templates.values()]
        if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"more than {MAX_TEMPLATE_WORDS} words of templates")
        self.words = [w.tolist() for w in words]
        self.wanted = [Counter(w) for w in self.words]
        pairs = [np.unique(windows(w, min(2, len(w)))) if len(w) else w for w in words]
        self.pair = np.concatenate(pairs) if pairs else np.empty(0, U64)
        self.owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(self.pair, kind="stable")
        self.pair, self.owner = self.pair[order], self.owner[order]
        self.coverage = coverage
        # A fit of n words lies in a span of 5/4 n + 2. Each word that either side skips parts at most one pair of
        # neighbours, so the span holds at least so many different pairs of the template.
        self.span = [n + n // 4 + 2 for n in map(len, self.words)]
        self.need = [int(n * (3 * coverage - 2.25)) - 3 - (n - 1 - len(p)) for n, p in zip(map(len, self.words), pairs, strict=True)]
        # The least number of words of a fit; one of the first size - least + 1 words is among them.
        self.least = [next((k for k in range(n + 1) if k >= coverage * n), n + 1) for n in map(len, self.words)]
        self.head = [set(w[: max(1, len(w) // 4, len(w) - k + 1)]) for w, k in zip(self.words, self.least, strict=True)]
        self.short = [o for o, n in enumerate(self.need) if n < 1 and self.words[o]]
        long = ~np.isin(self.owner, self.short)
        self.pair, self.owner = self.pair[long], self.owner[long]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, U64), *(words[o] for o in self.short)]))
        self.member = {o: np.append(np.isin(self.vocabulary, words[o]), False) for o in self.short}
        self.first = {o: np.append(np.isin(self.vocabulary, np.array(sorted(self.head[o]), U64)), False) for o in self.short}

    def _dense(self, hits: list[tuple[int, int]], o: int) -> list[int]:
        """Of (position, pair) in order: the positions that lie in a span with enough different pairs."""
        need, span = self.need[o], self.span[o]
        if need <= 1:
            return [p for p, _ in hits]
        held: dict[int, int] = {}
        out: dict[int, None] = {}
        lo = 0
        for hi, (p, q) in enumerate(hits):
            held[q] = held.get(q, 0) + 1
            while p - hits[lo][0] > span:
                old = hits[lo][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                lo += 1
            if len(held) >= need:
                out.update((x, None) for x, _ in hits[max(lo, 0) : hi + 1])
        return list(out)

    def scan(self, texts: list[bytes]):
        """(text's index, template, coverage, first word, word behind the last) of each license found."""
        t = Tokens(texts)
        g, ok = windows(t.h, 2), within(t.doc, 2)
        lo, hi = np.searchsorted(self.pair, g, "left"), np.searchsorted(self.pair, g, "right")
        hit = np.flatnonzero(ok & (hi > lo))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p in hit.tolist():
            for q in range(lo[p], hi[p]):
                by.setdefault((int(t.doc[p]), int(self.owner[q])), []).append((p, q))
        seen = [(d, o, p) for (d, o), hits in sorted(by.items()) for p in self._dense(hits, o)]
        k = 0
        while k < len(seen):
            d, o, p = seen[k]
            size = len(self.words[o])
            end = k
            while end + 1 < len(seen) and seen[end + 1][:2] == (d, o) and seen[end + 1][2] - seen[end][2] <= size:
                end += 1
            first = max(int(t.first[d]), p - size)
            last = min(int(t.first[d + 1]), seen[end][2] + 2 + size)
            yield from self._in(t.h[first:last].tolist(), first - int(t.first[d]), d, o)
            k = end + 1
        if self.short and len(t.h):
            yield from self._scan_short(t)

    def _scan_short(self, t: Tokens):
        """scan() for the short templates: regions around the starts whose span holds enough of the template's words."""
        at = np.minimum(np.searchsorted(self.vocabulary, t.h), len(self.vocabulary) - 1)
        at[self.vocabulary[at] != t.h] = len(self.vocabulary)
        behind = t.first[t.doc + 1]
        for o in self.short:
            known = np.concatenate(([0], np.cumsum(self.member[o][at])))
            maybe = np.flatnonzero(self.first[o][at])
            end = np.minimum(maybe + self.span[o], behind[maybe])
            fits = known[end] - known[maybe] >= self.least[o]
            maybe, end = maybe[fits], end[fits]
            edge = np.flatnonzero((np.diff(t.doc[maybe]) != 0) | (np.diff(maybe) > self.span[o])) + 1
            for lo, hi in zip([0, *edge], [*edge, len(maybe)], strict=True):
                if hi > lo:
                    d, first = int(t.doc[maybe[lo]]), int(maybe[lo])
                    yield from self._in(t.h[first : int(end[hi - 1])].tolist(), first - int(t.first[d]), d, o)

    def _in(self, region: list, offset: int, d: int, o: int):
        """All the occurrences of template o in a region: the best run of aligned words, then what is left beside it."""
        size = len(self.words[o])
        for lo in self._starts(region, o):
            part = region[lo : lo + size + size // 4 + 2]
            pairs = patience(self.words[o], part)
            if len(pairs) >= self.coverage * size:
                yield d, self.names[o], len(pairs) / size, offset + lo + pairs[0][1], offset + lo + pairs[-1][1] + 1

    def _starts(self, region: list, o: int):
        """Where the template may begin: at a word of its first quarter or at one of those of which a fit holds one, no two starts within one template's length once it fits."""
        head, size = self.head[o], len(self.words[o])
        span, least = size + size // 4 + 2, self.coverage * size
        at, end, held, able = 0, 0, Counter(), 0
        wanted = self.wanted[o]
        mine = Counter(w for w in region if w in wanted)
        if sum(min(n, wanted[w]) for w, n in mine.items()) < least:
            return
        while at < len(region):
            # No more words can align than are the template's, each as often as there.
            while end < min(at + span, len(region)):
                w = region[end]
                held[w] += 1
                able += held[w] <= wanted[w]
                end += 1
            step = 1
            if able >= least and region[at] in head and len(patience(self.words[o], region[at : at + span])) >= least:
                yield at
                step = size
            for w in region[at : min(at + step, end)]:
                able -= held[w] <= wanted[w]
                held[w] -= 1
            at += step


def templates_from(table: DataFrame, name: str = "name", text: str = "text") -> dict[str, str]:
    """A table of templates as scan_licenses takes them. Rows without a name or a word don't count; two texts of one name, or more than MAX_TEMPLATE_WORDS words, raise ValueError."""
    rows = table.select(F.col(name).alias("name"), F.col(text).alias("text")).where(F.col(name).isNotNull() & F.col(text).isNotNull()).distinct().limit(MAX_TEMPLATE_WORDS + 1).collect()
    found = {r["name"]: r["text"] for r in sorted(rows) if len(Tokens([r["text"].encode()]).h)}
    if len({r["name"] for r in rows}) < len(rows):
        raise ValueError("two templates of one name")
    Scanner(found, 1.0)
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word) for each license found in each whole text."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def scan(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for at, part in portions(utf8(b.column(1))):
                out += [dict(zip(schema.names, (ids[at + d], *rest), strict=True)) for d, *rest in scanner.scan(part)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(scan, "doc_id long, license string, coverage double, first_word long, end_word long")
