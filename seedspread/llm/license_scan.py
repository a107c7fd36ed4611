"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are compared in lower case and without ASCII punctuation; shingles are five words (a template of fewer words has one
of all). Templates of ``n`` shingles belong to the class of ``n0``, the largest power of two up to ``n``. For ``n0 >= 4``, windows
are 9 blocks of ``n0 / 4`` shingles and start at every block, so any stretch of ``n`` lies in a window whole. A window that
holds 0.8 of the template has a Jaccard similarity of at least 0.8 / (1 + 2.25 - 0.8) = 0.326 with it: of 40 bands of one
MinHash value they share one with probability above 1 - 2e-7. Below ``n = 4``, 0.8 means all of a template, windows are as
long as it, all bands agree, and one is enough. Candidates are verified by the exact share of the template's shingles in
the window, inside each text that it touches.

A task scans whole texts where they are read, many at once; templates are few and travel with the code. No shuffle.

Rows: null and empty texts match nothing. A document gives one row for each license that it holds, with the best window
(the first of equals). Repeated rows give repeated matches; other columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedspread.llm import shingles

WORDS, CONTAINMENT = 5, 0.8
BANDS, BLOCKS = 40, 9
_BITS = np.uint32((1 << 16) - 1)

#: Notices by which works state their licenses, and the grants of short licenses. A BSD-3-Clause text holds the
#: clauses of BSD-2-Clause too and gives both. Others are a parameter of ``scan``.
TEMPLATES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-2.0": [
        'This work is licensed under the GNU General Public License, version 2.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.',
    ],
    "GPL-3.0": [
        'This work is licensed under the GNU General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "LGPL-2.1": [
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    ],
    "LGPL-3.0": [
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
        'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "AGPL-3.0": [
        'This work is licensed under the GNU Affero General Public License, version 3.',
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    ],
    "MPL-2.0": [
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    ],
    "MIT": [
        'Released under the MIT License.',
        'Licensed under the MIT License.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    ],
    "BSD-3-Clause": [
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ],
    "BSL-1.0": [
        'Distributed under the Boost Software License, Version 1.0.',
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ],
    "Unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ],
    "EPL-2.0": [
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/',
    ],
    "CC0-1.0": [
        'This work is licensed under CC0 1.0.',
        'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
    ],
    "CC-BY-4.0": [
        'Licensed under CC BY 4.0.',
        'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    ],
    "CC-BY-SA-4.0": [
        'Licensed under CC BY-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    ],
    "CC-BY-NC-4.0": [
        'Licensed under CC BY-NC 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    ],
    "CC-BY-ND-4.0": [
        'Licensed under CC BY-ND 4.0.',
        'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    ],
    "CC-BY-NC-SA-4.0": [
        'Licensed under CC BY-NC-SA 4.0.',
        'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
    ],
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in string.punctuation]] = 0x20


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles.shingles(_FOLD[data], offsets, WORDS)


def sliding(blocks: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Minima of each ``n`` blocks in a row that have the first one's ``owner``."""
    out, covered = blocks, 1
    while covered < n:
        step = min(covered, n - covered)
        out, before = out.copy(), out
        if step < len(out):
            same = owner[:-step] == owner[step:]
            np.minimum(before[:-step], before[step:], out=out[:-step], where=same)
        covered += step
    return out


class Templates:
    """The shingles of each template, and for each class the templates by MinHash value."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names, self.sets = [], []
        for name, variants in texts.items():
            for _, data, offsets in shingles.chunks(pa.array(variants)):
                for found in shingles.distinct(*hashed(data, offsets)):
                    if len(found):
                        self.names.append(name)
                        self.sets.append(found)
        #: class -> for each band: a filter on the low bits, and value -> templates
        self.classes: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        for i, found in enumerate(self.sets):
            n = len(found) if len(found) < 4 else 1 << (len(found).bit_length() - 1)
            bands = self.classes.setdefault(n, [(np.zeros(1 << 16, bool), {}) for _ in range(BANDS if n >= 4 else 1)])
            for (low, owners), value in zip(bands, shingles.minhash(found, np.array([len(found)]), BANDS)[0].tolist(), strict=False):
                low[value & int(_BITS)] = True
                owners.setdefault(value, []).append(i)

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, first shingle, end, template) of windows that share a band with a template.

        Each text starts at a block of its own and its windows end with it, so they don't depend on the texts around it."""
        widest = max([n // 4 for n in self.classes if n >= 4], default=1)
        room = -(-counts // widest) * widest
        starts = np.cumsum(room) - room
        owner = np.repeat(np.arange(len(counts)), room)
        place = np.arange(len(hashes)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        found: set[tuple[int, int, int, int]] = set()
        for band, own in enumerate(shingles.minhash_values(hashes, BANDS)):
            values = np.full(len(owner), 0xFFFFFFFF, np.uint32)
            values[place] = own
            step, blocks = 1, values
            for n in sorted(self.classes):
                if band >= len(self.classes[n]):
                    continue
                while n >= 4 and step < n // 4:
                    blocks, step = np.minimum(blocks[::2], blocks[1::2]), step * 2
                minima = sliding(blocks, owner[::step], BLOCKS if n >= 4 else n)
                low, owners = self.classes[n][band]
                length = step * BLOCKS if n >= 4 else n
                for w in np.flatnonzero(low[minima & _BITS]).tolist():
                    if templates := owners.get(int(minima[w])):
                        text = int(owner[w * step])
                        first = w * step - int(starts[text])
                        found.update((text, first, min(first + length, int(counts[text])), i) for i in templates)
        return found

    def matches(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(text, license, containment, first shingle, end) of the best window of each license in each text, the first of equals."""
        begins = np.cumsum(counts) - counts
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        for text, first, end, i in sorted(self.candidates(hashes, counts)) if len(hashes) else ():
            if first < end:
                share = float(np.isin(self.sets[i], hashes[begins[text] + first : begins[text] + end]).mean())
                key = text, self.names[i]
                if share >= CONTAINMENT and share > best.get(key, (0.0, 0, 0))[0]:
                    best[key] = share, first, end
        return [(*key, *window) for key, window in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word, last_word (of the best window, from 0) of the templates in each text."""
    own = Templates(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for at, data, offsets in shingles.chunks(batch.column("text")):
                found = own.matches(*hashed(data, offsets))
                rows += [(ids[at + i], name, share, a, b + WORDS - 2) for i, name, share, a, b in found]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "containment", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_word long, last_word long")
