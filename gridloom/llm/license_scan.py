"""License scanning by patience alignment of texts with license templates.

Words that are unique both in a stretch of text and in a stretch of the template are anchors; the longest increasing
subsequence of anchors keeps their order, and the gaps between kept anchors are aligned the
same way, down to gaps without anchors, whose common ends are matched word by word. Coverage is the share of the template's
words that are matched.

A text may hold a license more than once, and then its words are not unique in the whole
text. So alignment runs over stretches of the text: places where the template's rarest word
(in this text) occurs, each with the template's length on either side. Stretches that
overlap become one; where that holds several copies, the template is laid on each place. A template can reach the threshold only if enough of its words are in
the text at all, which is tested first; this test is exact.

Defined results for odd rows: null and empty texts have no license; repeated rows get the
same result; ties go to the earlier place; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Short license notices and the texts of common licenses, as published.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
}
THRESHOLD = 0.8

_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end in code points)."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORDS.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second members; pairs come by their first."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        before[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (i in a, j in b), increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[str, int] = {}
        for j in range(b0, b1):
            once[b[j]] = -1 if b[j] in once else j
        seen: dict[str, int] = {}
        for i in range(a0, a1):
            if a[i] in once:
                seen[a[i]] = -1 if a[i] in seen else i
        anchors = sorted((i, once[w]) for w, i in seen.items() if i >= 0 and once[w] >= 0)
        kept = _increasing(anchors)
        i0, j0 = a0, b0
        for i, j in kept:
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if kept:
            todo.append((i0, a1, j0, b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = {k: [w for w, _, _ in words_of(t)] for k, t in templates.items()}
        self.wanted = set().union(*self.templates.values())

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of every stretch over the threshold, by place."""
        low = text.lower()
        if not any(w in low for w in ("licens", "permi", "redistrib", "copy", "warrant")) and not self._plain(low):
            return []
        found = words_of(text)
        places: dict[str, list[int]] = {}
        for i, (w, _, _) in enumerate(found):
            if w in self.wanted:
                places.setdefault(w, []).append(i)
        out = []
        for name, words in self.templates.items():
            have = sum(min(words.count(w), len(places.get(w, ()))) for w in set(words))
            if have < self.threshold * len(words):
                continue
            # every match over the threshold holds one of the words that are too many to miss
            spare = int(len(words) * (1 - self.threshold) + 1e-9) + 1
            rare = sorted(set(words), key=lambda w: (len(places.get(w, ())), w))[:spare]
            at = sorted({i for w in rare for i in places.get(w, ())})
            n = len(words)
            stretches: list[list[int]] = []
            for i in at:
                lo, hi = max(0, i - n), min(len(found), i + n)
                if stretches and lo < stretches[-1][1] and hi - stretches[-1][0] <= 3 * n:
                    stretches[-1][1] = hi
                else:
                    stretches.append([lo, hi])
            low_words = [w for w, _, _ in found]
            got = [(n, i, i + n - 1) for i in self._exact(low_words, words, at)]
            walls = [(first, end + 1) for _, first, end in got] + [(len(found), len(found))]
            last, k = 0, 0
            for lo, hi in stretches:  # what lies between exact copies
                while lo < hi:
                    while walls[k][1] <= max(lo, last) and k < len(walls) - 1:
                        last = max(last, walls[k][1])
                        k += 1
                    a, b = max(lo, last), min(hi, walls[k][0])
                    for one in self._matches(low_words, words, at, a, b, spare):
                        got.append(one)
                        last = max(last, one[2] + 1)
                    lo = hi if walls[k][0] >= hi else walls[k][1]
            out += [(name, round(m / n, 6), found[first][1], found[end][2]) for m, first, end in got]
        return sorted(out, key=lambda x: (x[2], x[3], x[0]))

    @staticmethod
    def _exact(text: list[str], words: list[str], at: list[int]) -> list[int]:
        """Where the template stands word for word, without overlap. at: places of some of its words."""
        out: list[int] = []
        offsets: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            offsets.setdefault(w, []).append(p)
        for i in sorted({i - p for i in at for p in offsets[text[i]] if i >= p}):
            if (not out or i >= out[-1] + len(words)) and text[i] == words[0] and text[i : i + len(words)] == words:
                out.append(i)
        return out

    def _matches(self, text: list[str], words: list[str], at: list[int], lo: int, hi: int, spare: int) -> list[tuple[int, int, int]]:
        """(matched words, first, last place) of every match in text[lo:hi]: the whole stretch at once
        and then what lies on either side; where that gives none, or one wider than a template,
        the template laid on each rare word's place, so that repeated copies are found one by one."""
        n, need = len(words), self.threshold * len(words)
        out: list[tuple[int, int, int]] = []
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < need:
                continue
            match = align(text[lo:hi], words)
            whole = (len(match), lo + match[0][0], lo + match[-1][0]) if len(match) >= need else None
            if not whole or whole[2] - whole[1] >= n + 2 * spare:
                ones = self._laid(text, words, at, lo, hi, spare)
            else:
                ones = [whole]
            ones = ones or ([whole] if whole else [])
            if not ones:
                continue
            out += ones
            edges = [lo, *(x for _, first, end in ones for x in (first, end + 1)), hi]
            todo += list(zip(edges[::2], edges[1::2], strict=True))
        return sorted(out, key=lambda x: x[1])

    def _laid(self, text: list[str], words: list[str], at: list[int], lo: int, hi: int, spare: int) -> list[tuple[int, int, int]]:
        """Matches of the template laid on the places `at`, from left to right, without overlap."""
        n, need, out = len(words), self.threshold * len(words), []
        where: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            where.setdefault(w, []).append(p)
        for i in at[bisect_left(at, lo) : bisect_left(at, hi)]:
            if i < lo:
                continue
            best = None
            for slack in (0, spare):
                for p in where[text[i]]:
                    a, b = max(lo, i - p - slack), min(hi, i - p + n + slack)
                    match = align(text[a:b], words)
                    if len(match) >= need and (best is None or len(match) > best[0]):
                        best = (len(match), a + match[0][0], a + match[-1][0])
                if best:
                    break
            if best:
                out.append(best)
                lo = best[2] + 1
        return out

    def _plain(self, low: str) -> bool:
        """Whether any template could be covered, where none of the usual words is there."""
        have = {w for w in self.wanted if w in low}
        return any(sum(w in have for w in words) >= self.threshold * len(words) for words in self.templates.values())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (distinct, sorted), coverage (best, 0 if none), spans of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES, threshold)
        for batch in batches:
            got = [scanner(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(g) for g in got], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in g})) for g in got], pa.string()),
                    pa.array([max((x[1] for x in g), default=0.0) for g in got], pa.float64()),
                    pa.array([",".join(f"{n}:{s}:{e}" for n, _, s, e in g) for g in got], pa.string()),
                ],
                ["doc_id", "n_licenses", "licenses", "coverage", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_licenses long, licenses string, coverage double, spans string")


report = scan
