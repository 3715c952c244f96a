"""License scans by patience alignment of texts with license templates.

A text is scanned for the templates' three-word windows (hashed, all texts of a slice at once).  Each window found
says where its template would begin; about each such place the text is aligned with the template: words that
occur once in both are anchors, the longest increasing run of anchors stays, and the gaps between them are
aligned in the same way, equal words at a gap's ends first.  Coverage is the share of the template's words
that are aligned.  Where templates cover at places that overlap, the one with the most aligned words wins, then the first
listed, then the first place; all places that are left are the text's ``notices``, in their order, and the one that
wins among these is its license.

Words are runs of letters and digits, A-Z lower-cased.  Defined results: a null, empty or wordless text has no
license, coverage 0 and no span; repeated rows are scanned one by one; an empty table gives no rows; other columns
are not read; texts of any length are scanned whole; a license given twice is two notices; a template of fewer than
three words is a ValueError, as no window would find it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, FOLD, U64, Texts, Words, column, texts_of
from .workspace import prepared, small_batches

# The usual wording of license notices, and of the short licenses themselves.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Distributed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
WINDOW = 3
COVERAGE = 0.75
_NOTICES = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("n_matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(k)
        else:
            tops[p], piles[p] = v, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once, also = Counter(text[a:b]), Counter(template[c:d])
        at = {w: k for k, w in enumerate(template[c:d], c) if also[w] == 1}
        anchors = [(k, at[w]) for k, w in enumerate(text[a:b], a) if once[w] == 1 and w in at]
        if not anchors:
            continue
        anchors = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        out += anchors
        x, y = a, c
        for i, j in [*anchors, (b, d)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


class Scanner:
    """The templates' windows, and the alignment of texts that hold any of them."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE):
        self.names, self.coverage = [name for name, _ in templates], coverage
        words = Words(next(texts_of(pa.array([t for _, t in templates], pa.large_string()), 1 << 40)), ALNUM, FOLD)
        self.words = [words.hashes[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        if any(len(w) < WINDOW for w in self.words):
            raise ValueError(f"a license template needs {WINDOW} words")
        at, hashes = words.windows(WINDOW)
        self.at: dict[int, list[tuple[int, int]]] = {}
        for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
            t = int(words.text[i])
            self.at.setdefault(h, []).append((t, i - int(words.first[t])))
        self.hashes = np.array(sorted(self.at), U64)

    def scan(self, texts: Texts) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text: (template, aligned words, first byte, last byte) of every notice, the best first, if any covers."""
        words = Words(texts, ALNUM, FOLD)
        at, h = words.windows(WINDOW)
        place = np.searchsorted(self.hashes, h)
        place[place == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[place] == h)
        starts: dict[tuple[int, int], set[int]] = {}
        for i, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
            for t, offset in self.at[x]:
                starts.setdefault((int(words.text[i]), t), set()).add(i - offset)
        covers: dict[int, list[tuple[int, int, int, int]]] = {}
        for (i, t), places in sorted(starts.items()):
            template = self.words[t]
            slack, last = max(2, len(template) // 4), None
            for p in sorted(places):
                if last is not None and p - last <= slack // 2:
                    continue  # this place lies inside the stretch that was just aligned
                last = p
                lo = max(int(words.first[i]), p - slack)
                hi = min(int(words.first[i + 1]), p + len(template) + slack)
                pairs = align(words.hashes[lo:hi].tolist(), template)
                if len(pairs) >= self.coverage * len(template):
                    # If the template's own length does as well, no word of the next notice is taken for one of this.
                    near = max(p, int(words.first[i]))
                    own = align(words.hashes[near : min(hi, p + len(template))].tolist(), template)
                    if len(own) >= len(pairs):
                        lo, pairs = near, own
                    covers.setdefault(i, []).append((-len(pairs), t, lo + pairs[0][0], lo + pairs[-1][0]))
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, found in covers.items():
            base, taken = int(texts.offsets[i]), []
            for n, t, a, b in sorted(found):
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] < a) and (at == len(taken) or taken[at][0] > b):
                    taken.insert(at, (a, b))
                    out.setdefault(i, []).append((t, -n, int(words.starts[a]) - base, int(words.ends[b]) - base))
        return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, n_matched, coverage, start, end, notices) of every document; start and end are bytes.

    The first columns tell the best notice; ``notices`` lists all of them, the best one too, by their places.
    """
    small_batches(docs.sparkSession)
    docs = prepared(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            for texts in texts_of(column(batch, "text")):
                found = scanner.scan(texts)
                rows = [found[i][0] if i in found else None for i in range(texts.n)]
                tell = lambda t, n, a, b: {"license": scanner.names[t], "template": t, "n_matched": n, "coverage": n / len(scanner.words[t]), "start": a, "end": b}
                notices = pa.array([[tell(*r) for r in sorted(found.get(i, []), key=lambda r: r[2])] for i in range(texts.n)], _NOTICES)  # noqa: B023
                get = lambda k, kind: pa.array([r and r[k] for r in rows], kind)  # noqa: B023, E731
                name = pa.array([r and scanner.names[r[0]] for r in rows], pa.string())
                share = pa.array([r[1] / len(scanner.words[r[0]]) if r else 0.0 for r in rows], pa.float64())
                matched = pa.array([r[1] if r else 0 for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, texts.n), name, get(0, pa.int32()), matched, share, get(2, pa.int64()), get(3, pa.int64()), notices], names=["doc_id", "license", "template", "n_matched", "coverage", "start", "end", "notices"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, template int, n_matched long, coverage double, start long, end long, notices array<struct<license: string, template: int, n_matched: bigint, coverage: double, start: bigint, end: bigint>>")
