"""License scans: which license notices a text holds, and where.

Templates are public notices (one-line grants and full texts). A text's words
are cut into windows that overlap by two thirds, at one window size per class
of template length, so that any span as long as a template lies within some
window. Windows and templates have MinHash signatures over their five-word
shingles; a window meets a template through bands of the signature. Every
candidate is verified: the share of the template's shingles that the window
holds, exactly, must reach ``CONTAINMENT``.

Bands: a window that holds a share c of a template has a Jaccard index of at
least c / 2 / (3 / 2 + (1 - c) / 2) with it (a class spans a factor of two, a
window is 1.5 times the class). With one row per band and ``BANDS`` bands the
chance to meet is 1 - (1 - J)^BANDS; ``collision_probability`` gives it (over
0.999999 at the threshold). The signature is the minimum of a random linear
function of each shingle hash per band; minima of windows are merged from
blocks, so a text is hashed once for all window sizes.

Defined results: null, empty and short texts hold nothing and give no row. A
text gives one row per template found, with the best containment and the first
place it occurs at. Repeated rows give repeated results. An empty table gives no
rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 48
#: Shingles of the shortest template class; each class doubles it.
LEAST = 4
SEED = 20

# Wording of public license notices.
NOTICES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.""",
    "MIT-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

def words(text: str) -> list[bytes]:
    """Lower-case words at ASCII white space, punctuation at their ends aside."""
    out = []
    for w in text.lower().encode("utf-8", "replace").split():
        w = w.strip(b".,;:!?\"'()[]{}<>*#/-`_|")
        if w:
            out.append(w)
    return out


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles: word hashes joined by odd factors."""
    w = words(text)
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), w), np.uint64, len(w))
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out += h[j:j + n] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64) | 1)
    return out ^ (out >> np.uint64(29))


def collision_probability(containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    """Least chance that a window holding that share of a template meets it."""
    j = containment / 2 / (1.5 + (1 - containment) / 2)
    return 1 - (1 - j) ** bands


class Templates:
    """Shingle sets, classes and bands of the notices."""

    def __init__(self, notices: dict[str, str], bands: int = BANDS):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(1, 2**63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands, np.uint64)
        self.names = sorted(notices)
        self.sets = [np.unique(shingles(notices[n])) for n in self.names]
        self.size = [self.class_of(len(s)) for s in self.sets]
        self.classes: dict[int, tuple[np.ndarray, ...]] = {}  # sorted band values, their bands, templates
        for size in sorted(set(self.size)):
            members = [k for k, s in enumerate(self.size) if s == size and len(self.sets[k])]
            if not members:
                continue
            sig = np.stack([self.minima(self.sets[k])[:, 0] for k in members], axis=1)
            values, bands_, who = sig.ravel(), np.repeat(np.arange(bands), len(members)), np.tile(members, bands)
            order = np.argsort(values, kind="stable")
            some = np.zeros(2**16, bool)  # by the upper bits, to pass over most windows cheaply
            some[(values >> np.uint64(48)).astype(np.int64)] = True
            self.classes[size] = values[order], bands_[order], who[order], some

    @staticmethod
    def class_of(n: int) -> int:
        size = LEAST
        while size < n:
            size *= 2
        return size

    def minima(self, h: np.ndarray, block: int | None = None) -> np.ndarray:
        """(bands, blocks): least value of every band's function per block of shingles."""
        block = block or max(1, len(h))
        step = block * max(1, 32_768 // block)  # whole blocks, so that a long text is done in parts
        out = []
        for i in range(0, max(1, len(h)), step):
            part = h[i:i + step]
            value = self.a[:, None] * part + self.b[:, None]
            if block == 2 and len(part) > 1:  # neighbours: much cheaper than a general reduction
                pairs = np.minimum(value[:, :-1:2], value[:, 1::2])
                out.append(np.concatenate([pairs, value[:, -1:]], axis=1) if len(part) % 2 else pairs)
            else:
                out.append(np.minimum.reduceat(value, np.arange(0, len(part), block), axis=1))
        return np.concatenate(out, axis=1)


def scan(t: Templates, text: str, containment: float = CONTAINMENT) -> list[tuple[str, float, int, int]]:
    """(template, containment, first word, words) of every template in a text."""
    h = shingles(text)
    if not len(h):
        return []
    found: dict[int, tuple[float, int, int]] = {}
    half = LEAST // 2
    low, block = t.minima(h, half), half
    for size in sorted(t.classes):
        while block < size // 2:  # merge neighbouring blocks up to half the class
            if low.shape[1] % 2:
                low = np.concatenate([low, low[:, -1:]], axis=1)
            low, block = np.minimum(low[:, ::2], low[:, 1::2]), block * 2
        padded = np.concatenate([low, np.full((low.shape[0], 2), np.iinfo(np.uint64).max, np.uint64)], axis=1)
        sig = np.minimum(np.minimum(padded[:, :-2], padded[:, 1:-1]), padded[:, 2:])  # windows of three blocks, a block apart
        values, bands, members, some = t.classes[size]
        seen = set()
        band, window = np.nonzero(some[(sig >> np.uint64(48)).astype(np.int64)])
        value = sig[band, window]
        at = np.minimum(np.searchsorted(values, value), len(values) - 1)
        for i in np.nonzero(values[at] == value)[0].tolist():
            e = int(at[i])
            while e < len(values) and values[e] == value[i]:  # templates can share a value
                if bands[e] == band[i]:
                    seen.add((int(window[i]), int(members[e])))
                e += 1
        for w, k in sorted(seen):
            first = w * block
            window = h[first:first + 3 * block]
            inside = np.isin(window, t.sets[k])
            share = len(np.unique(window[inside])) / len(t.sets[k])
            if share >= containment and share > found.get(k, (0.0, 0, 0))[0]:
                places = np.nonzero(inside)[0]
                found[k] = (share, first + int(places[0]), int(places[-1] - places[0]) + SHINGLE)
    return [(t.names[k], *found[k]) for k in sorted(found)]


def _scan_batches(notices: dict[str, str], containment: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = Templates(notices)
    for b in C.sliced(batches):
        rows = [(doc, *hit) for doc, text in zip(b.column("doc_id").to_pylist(), C.texts(b, "text")) for hit in scan(t, text, containment)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))],
                                         ["doc_id", "license", "containment", "first_word", "n_words"])


def scan_documents(docs: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                   containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word, n_words per template found.
    The templates are a fixed parameter; texts are scanned in place, without a shuffle."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_scan_batches, notices or NOTICES, containment),
                        "doc_id long, license string, containment double, first_word long, n_words long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_documents(C.table(spark, sf_dir, "documents"))
