"""License scans by patience alignment of texts with license notices.

Method.  A find is a stretch of a text whose patience alignment with a notice covers enough of the
notice's words: words that occur once in both are anchors, the longest increasing subsequence of anchors
is kept, and the gaps between them are aligned in the same way; a gap without such words is aligned by all its
equal words.  Coverage, start and end are those of the alignment, and it alone decides.

The stretches to align come from an exact search: no alignment is longer than the longest common
subsequence, whose length is kept in the bits of one number.  A candidate is the stretch of at most ``SPAN`` notice lengths
that ends first, from its latest start, then the next one behind it, so that words before, inside or
behind a notice cut nothing and repeated notices are separate finds.  What lies between is searched
once more for notices spread wider, in the longest stretches where no telling word comes more often
than the notice has it nor a notice length after the one before.  A candidate takes in what else of its
notice stands up to a notice length to either side.  Where words change places so that anchors cross, the alignment
can fall short of the subsequence by the words moved; such a stretch is no find if that takes it below the threshold.

Most texts are told apart before any alignment by an exact bound: a notice can only reach the
threshold if enough of its word positions hold words that occur in the text at all.

Rows: null, empty and blank texts have no finds; a text gives a row per notice and find, equal
rows give equal finds; the whole text is read, whatever its length; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
SPAN = 3
WORD = re.compile(r"\w+(?:[.\-]\w+)*")

#: License notices (fixed values), by license and form.
NOTICES = [
    ("MIT", "line", "Released under the MIT License."),
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("MIT", "grant", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    )),
    ("Apache-2.0", "header", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    )),
    ("GPL-3.0", "header", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    )),
    ("BSD-2-Clause", "grant", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    )),
    ("ISC", "grant", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    )),
]
#: Words that tell nothing about a license.
PLAIN = frozenset("a an and any are as at be by can do for from in is it may not of on or that the this to under use with without you".split())


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and where each stands in the text."""
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: rising pairs of positions of equal words."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        times_a, times_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {w: i for i, w in enumerate(b[blo:bhi], blo) if times_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[alo:ahi], alo) if times_a[w] == 1 and w in place]
        chain = _rising(anchors)
        if not chain:
            # nothing occurs once in both: the gap's repeated words are aligned as they stand
            places: dict[str, list[int]] = {}
            for j in range(bhi - 1, blo - 1, -1):
                places.setdefault(b[j], []).append(j)
            out += _rising([(i, j) for i in range(alo, ahi) for j in places.get(a[i], ())])
            continue
        out += chain
        edges = [(alo - 1, blo - 1), *chain, (ahi, bhi)]
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members rise (first members already do)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        pile = bisect.bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(i)
        else:
            tops[pile], at[pile] = j, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


@dataclass(frozen=True)
class Notice:
    license: str
    form: str
    text: str

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)[0]

    @cached_property
    def telling(self) -> Counter:
        return Counter(w for w in self.words if w not in PLAIN)

    def possible(self, low: str, least: float) -> bool:
        """Whether enough of the notice's words occur in a lower-case text for the threshold."""
        lost, most = 0, len(self.words) - least * len(self.words)
        for word, times in self.telling.items():
            if word not in low:
                lost += times
                if lost > most:
                    return False
        return lost < len(self.words)

    @cached_property
    def times(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def last(self) -> dict[str, int]:
        return {w: j for j, w in enumerate(self.words)}

    @cached_property
    def masks(self) -> tuple[dict[str, int], dict[str, int]]:
        """The places of each word as bits, from the notice's start and from its end."""
        ahead: Counter = Counter()
        back: Counter = Counter()
        for j, w in enumerate(self.words):
            ahead[w] |= 1 << j
            back[w] |= 1 << (len(self.words) - 1 - j)
        return dict(ahead), dict(back)

    def common(self, words: list[str], places: range, most: int) -> tuple[int, int]:
        """Longest common subsequence with the words at these places, up to most, and the last place it needs."""
        masks = self.masks[0 if places.step > 0 else 1]
        full = (1 << len(self.words)) - 1
        free, got, at = full, 0, -1
        for i in places:
            mask = masks.get(words[i])
            if mask:
                hit = free & mask
                free = ((free + hit) | (free - hit)) & full
                now = len(self.words) - free.bit_count()
                if now > got:
                    got, at = now, i
                    if got >= most:
                        break
        return got, at

    def tight(self, words: list[str], lo: int, hi: int) -> tuple[int, int, int]:
        """(words in common, start, end) of the first shortest stretch with all that a range has in common."""
        got, last = self.common(words, range(lo, hi), len(self.words))
        return got, self.common(words, range(last, lo - 1, -1), got)[1], last + 1

    def cores(self, words: list[str], need: int) -> list[tuple[int, int]]:
        """Stretches that hold just the need, each the first to end behind the one before."""
        span = SPAN * len(self.words)
        out = []
        left, have = 0, 0
        seen: Counter = Counter()
        for i, w in enumerate(words):
            if w not in self.times:
                continue
            while i - left >= span:
                gone = words[left]
                if gone in self.times:
                    have -= seen[gone] <= self.times[gone]
                    seen[gone] -= 1
                left += 1
            seen[w] += 1
            have += seen[w] <= self.times[w]
            # the last of the words needed stands behind the others in the notice too
            if have >= need and self.last[w] >= need - 1:
                got, start = self.common(words, range(i, left - 1, -1), need)
                if got >= need:
                    out.append((start, i + 1))
                    left, have = i + 1, 0
                    seen = Counter()
        return out

    def spread(self, words: list[str], lo: int, hi: int, need: int) -> list[tuple[int, int, int]]:
        """Finds of any length in a range, by the longest stretches without a telling word too many."""
        size = len(self.words)
        at = [i for i in range(lo, hi) if words[i] in self.telling]
        groups: list[tuple[int, int]] = []
        first = 0
        used: Counter = Counter()
        for k, i in enumerate(at):
            w = words[i]
            if k > first and i - at[k - 1] > size:
                groups.append((first, k))
                first, used = k, Counter()
            elif used[w] >= self.telling[w]:
                groups.append((first, k))
                while used[w] >= self.telling[w]:
                    used[words[at[first]]] -= 1
                    first += 1
            used[w] += 1
        groups.append((first, len(at)))
        able = []
        for a, b in groups:
            if b - a >= max(1, need - size + self.telling.total()):
                before, after = at[a - 1] + 1 if a else lo, at[b] if b < len(at) else hi
                found = self.tight(words, max(before, at[a] - size), min(after, at[b - 1] + 1 + size))
                if found[0] >= need:
                    able.append(found)
        out: list[tuple[int, int, int]] = []
        for found in sorted(able, key=lambda f: (-f[0], f[2] - f[1], f[1])):
            if all(found[2] <= f[1] or f[2] <= found[1] for f in out):
                out.append(found)
        return out

    def finds(self, words: list[str], least: float) -> list[tuple[int, int, int]]:
        """(words in common, start, end) of every use of the notice, without overlaps, in order."""
        size = len(self.words)
        need = next(k for k in range(1, size + 2) if k >= least * size)
        cores = self.cores(words, need)
        out = []
        end = 0
        for k, (lo, hi) in enumerate(cores):
            after = cores[k + 1][0] if k + 1 < len(cores) else len(words)
            out.append(self.tight(words, max(end, lo - size), min(after, hi + size)))
            end = out[-1][2]
        edges = [0, *(x for f in out for x in f[1:]), len(words)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            if hi - lo >= need:
                out += self.spread(words, lo, hi, need)
        return sorted(out, key=lambda f: f[1])


def scan(text: str, notices: list[Notice], least: float = THRESHOLD) -> list[tuple[str, str, float, int, int]]:
    """(license, form, coverage, start, end) of every notice found, with character positions."""
    low = text.lower()
    able = [n for n in notices if n.possible(low, least)]
    if not able:
        return []
    words, spans = words_of(text)
    out = []
    for notice in able:
        for _, lo, hi in notice.finds(words, least):
            pairs = align(words[lo:hi], notice.words)
            if len(pairs) < least * len(notice.words):
                continue
            out.append((
                notice.license, notice.form, len(pairs) / len(notice.words), spans[lo + pairs[0][0]][0], spans[lo + pairs[-1][0]][1]
            ))
    return out


def license_finds(
    docs: DataFrame, notices: list[tuple[str, str, str]] = NOTICES, least: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per find: key, license, form, coverage, start, end."""
    known = [Notice(*n) for n in notices]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finds = [(i, *f) for i, t in enumerate(batch.column(1)) for f in scan(t.as_py() or "", known, least)]
            rows = pa.array([f[0] for f in finds], pa.int64())
            columns = [pa.array([f[k] for f in finds], kind) for k, kind in ((1, pa.string()), (2, pa.string()), (3, pa.float64()), (4, pa.int64()), (5, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], [key, "license", "form", "coverage", "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, license string, form string, coverage double, start long, end long")
