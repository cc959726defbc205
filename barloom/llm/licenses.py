"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides.

Words are runs of letters and digits in lower case; a template is the set of its distinct five-word
shingles. A document matches a template where some run of 2t + 1 consecutive shingles holds at least
75 % of that set; t is the smallest power of two for which such a run is as long as the template.

Retrieval cuts the shingles into tiles of t and takes as windows each three tiles in a row, so every
such run lies in a window. A window that holds the run has a similarity to the template of at least j
(a bound from the sizes alone). A band is one MinHash value; with b bands a match is retrieved with a
probability of 1 - (1 - j)^b, and b is the smallest number for which at most MISSED are missed. Tiles
of larger sizes take their values from the smaller ones. All candidates are then confirmed exactly.

Edge cases: null, empty and short texts have no match; a null doc_id is carried along; repeated rows
are reported each; of overlapping runs the one with the largest share is reported, the first in a
tie; different templates may overlap; an empty table gives no rows; other columns are ignored; texts
are scanned whole, long ones in blocks of words that overlap by the longest window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from barloom.llm.common import column, documents, mapped, small_batches, utf8
from barloom.llm.words import ALNUM, mixed, shingles, words_of

WIDTH = 5
SHARE = 0.75
MISSED = 1e-6
BLOCK = 1 << 18

# Notices of public licences.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "MIT line": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
}


class Template:
    def __init__(self, name: str, text: str):
        words = next(words_of([text.encode()], ALNUM))[1]
        self.name = name
        self.set = np.unique(shingles(words, WIDTH))
        n = self.n = len(self.set)
        self.need = -int(-SHARE * n // 1)
        self.tile = 1
        while 2 * self.tile + 1 < n:
            self.tile *= 2
        self.run = 2 * self.tile + 1
        least = self.need / (3 * self.tile + n - self.need)
        self.bands = 1 if least >= 1 else int(np.ceil(np.log(MISSED) / np.log(1 - least)))


class Index:
    """The templates by tile size, with their MinHash values."""

    def __init__(self, texts: dict[str, str]):
        self.templates = [Template(k, v) for k, v in texts.items()]
        short = [t.name for t in self.templates if not t.n]
        if short:
            raise ValueError(f"templates without words: {short}")
        self.bands = max(t.bands for t in self.templates)
        seeds = mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        self.by = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.least = [(_folded(t.set)[None, :] * self.by[:, None]).min(axis=1) for t in self.templates]
        self.tiles = sorted({t.tile for t in self.templates})
        self.longest = max(t.run for t in self.templates) + WIDTH

    def candidates(self, found: np.ndarray):
        """Yields (template number, first shingles of the windows that share one of its bands)."""
        folded = _folded(found)
        hits: dict[int, list[np.ndarray]] = {}
        for band in range(self.bands):
            low, tile = folded * self.by[band], 1
            for size in self.tiles:
                asked = [i for i, t in enumerate(self.templates) if t.tile == size and band < t.bands]
                while tile < size:
                    if len(low) % 2:
                        low = np.append(low, np.uint32(0xFFFFFFFF))
                    low = np.minimum(low[0::2], low[1::2])
                    tile *= 2
                if not asked:
                    continue
                window = low.copy()
                window[:-1] = np.minimum(window[:-1], low[1:])
                window[:-2] = np.minimum(window[:-2], low[2:])
                for i in asked:
                    got = np.flatnonzero(window == self.least[i][band])
                    if len(got):
                        hits.setdefault(i, []).append(got * size)
        for i, got in sorted(hits.items()):
            yield i, np.unique(np.concatenate(got))


def _folded(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)


@lru_cache(maxsize=4)
def index_of(texts: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(texts))


def matches(found: np.ndarray, template: Template) -> list[tuple[int, int, float]]:
    """(first word, word after the last, share) of each match in the shingles of one text."""
    at = np.flatnonzero(np.isin(found, template.set))
    spots, kinds = at.tolist(), np.searchsorted(template.set, found[at]).tolist()
    shares, ends = [], []
    seen: dict[int, int] = {}
    right = 0
    for left, spot in enumerate(spots):
        while right < len(spots) and spots[right] < spot + template.run:
            seen[kinds[right]] = seen.get(kinds[right], 0) + 1
            right += 1
        shares.append(len(seen))
        ends.append(right)
        seen[kinds[left]] -= 1
        if not seen[kinds[left]]:
            del seen[kinds[left]]
    out, left = [], 0
    while left < len(spots):
        if shares[left] < template.need:
            left += 1
            continue
        best = max(range(left, ends[left]), key=lambda i: (shares[i], -i))
        out.append((spots[best], spots[ends[best] - 1] + WIDTH, shares[best] / template.n))
        left = ends[best]
    return out


def _scan(texts: tuple):
    def run(batches):
        import pyarrow as pa

        index = index_of(texts)
        schema = pa.schema([("row", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())])
        for batch in small_batches(batches, "text"):
            out = []
            for first, words, bounds in words_of(utf8(batch, "text"), ALNUM):
                if len(words) < WIDTH:
                    continue
                # Shingles across two texts can only add candidates, which the next step rejects.
                found = shingles(words, WIDTH)
                asked: set[tuple[int, int]] = set()
                for at in range(0, len(found), BLOCK):
                    part = found[at : at + BLOCK + index.longest]
                    for i, windows in index.candidates(part):
                        size = 3 * index.templates[i].tile
                        a = np.searchsorted(bounds, at + windows, "right") - 1
                        b = np.searchsorted(bounds, at + windows + size, "left") - 1
                        asked.update((i, int(d)) for x, y in zip(a, b) for d in range(x, min(y, len(bounds) - 2) + 1))
                for i, d in sorted(asked):
                    own = found[bounds[d] : max(bounds[d], bounds[d + 1] - WIDTH + 1)]
                    for start, end, share in matches(own, index.templates[i]):
                        out.append((first + d, index.templates[i].name, start, end, share))
            rows, *rest = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:]))],
                ["doc_id", "license", "start_word", "end_word", "containment"],
            )

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start_word, end_word, containment), a row for each match."""
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = tuple((TEMPLATES if templates is None else templates).items())
    return mapped(rows, _scan(texts), f"doc_id {kind}, license string, start_word long, end_word long, containment double")


def op10_licenses(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
