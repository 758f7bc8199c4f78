"""Licence scan: word bigrams of licence templates by Dice coefficient.

Text and templates are normalised alike: ASCII without case and punctuation, spellings of licence made one. A template
with b bigrams is found in a run of a bigrams that share c of them (with multiplicity) where 2c / (a + b) reaches the
threshold t. Bounds prune: c is at most a, so a run has at least b * t / (2 - t) shared bigrams, and at most
b * (2 - t) / t bigrams; texts that hold too few of a template's bigrams anywhere are not looked at further.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import small_batches
from keyspan.llm.tokens import PUNCTUATION, mix, releasing, word_hashes

# Notices and short licence texts as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
)
_ONE_SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed"}


class Template(NamedTuple):
    licence: str
    bigrams: Counter
    size: int


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, normalised word hashes)."""
    table = _spellings()
    for first, _, bounds, words in word_hashes(texts, PUNCTUATION):
        for old, new in table:
            words[words == old] = new
        yield first, bounds, words


_SPELLINGS: list[tuple[np.uint64, np.uint64]] = []


def _spellings() -> list[tuple[np.uint64, np.uint64]]:
    if not _SPELLINGS:
        one = lambda w: next(word_hashes(pa.array([w]), PUNCTUATION))[3][0]
        _SPELLINGS.extend((one(a), one(b)) for a, b in _ONE_SPELLING.items())
    return _SPELLINGS


def _bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


def prepare(templates) -> list[Template]:
    out = []
    with np.errstate(over="ignore"):
        for licence, text in templates:
            grams = _bigrams(next(_words(pa.array([text])))[2]).tolist()
            if grams:
                out.append(Template(licence, Counter(grams), len(grams)))
    return out


def runs(template: Template, grams: list[int], places: list[int], least: float) -> Iterator[tuple[float, int, int]]:
    """(Dice coefficient, first bigram, number of bigrams) of each run that reaches least and starts and ends with a shared bigram.

    grams: the template's bigrams as they occur, at places in rising order. A best run is among these.
    """
    longest = int(template.size * (2 - least) / least + 1e-9)
    for i, start in enumerate(places):
        left, common = dict(template.bigrams), 0
        for j in range(i, len(places)):
            a = places[j] - start + 1
            if a > longest:
                break
            if left[grams[j]]:
                left[grams[j]] -= 1
                common += 1
                dice = 2 * common / (a + template.size)
                if dice >= least:
                    yield dice, start, a


def apart(found: dict[str, list[tuple[float, int, int]]]) -> dict[str, tuple[float, int, int]]:
    """Each licence's best run (dice, first word, words) among all runs that overlap no better one: licences' templates resemble each other."""
    if len(found) < 2:
        return {licence: min(own, key=lambda x: (-x[0], *x[1:])) for licence, own in found.items()}
    out: dict[str, tuple[float, int, int]] = {}
    starts, ends = [], []  # of the runs that stay, in order; they overlap none of each other
    for _, licence, start, n, dice in sorted((-dice, licence, start, n, dice) for licence, own in found.items() for dice, start, n in own):
        at = bisect_right(starts, start)
        if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or start + n <= starts[at]):
            starts.insert(at, start)
            ends.insert(at, start + n)
            out.setdefault(licence, (dice, start, n))
    return out


def _scan(templates: list[Template], least: float):
    known = np.unique(np.array([g for t in templates for g in t.bigrams], dtype=np.uint64))
    holders: dict[int, list[int]] = {}
    for k, t in enumerate(templates):
        for g in t.bigrams:
            holders.setdefault(g, []).append(k)
    need = [t.size * least / (2 - least) - 1e-9 for t in templates]
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[known >> np.uint64(48)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for first, bounds, words in _words(batch.column("text")):
                    if len(words) < 2:
                        continue
                    grams = _bigrams(words)
                    at = np.flatnonzero(maybe[grams >> np.uint64(48)])
                    at = at[np.isin(grams[at], known)]
                    row = np.searchsorted(bounds, at, side="right") - 1
                    ok = at + 1 < bounds[row + 1]  # both words are of one text
                    at, row = at[ok], row[ok]
                    if not len(row):
                        continue
                    cuts = np.flatnonzero(np.diff(row, prepend=-1))
                    for lo, hi in zip(cuts, np.append(cuts[1:], len(row)), strict=True):
                        r, places = int(row[lo]), at[lo:hi]
                        values = grams[places].tolist()
                        own: dict[int, list[tuple[int, int]]] = {}
                        for place, g in zip((places - bounds[r]).tolist(), values, strict=True):
                            for k in holders[g]:
                                own.setdefault(k, []).append((place, g))
                        found: dict[str, list[tuple[float, int, int]]] = {}
                        for k, hits in own.items():
                            if len(hits) < need[k]:
                                continue
                            some = [(dice, start, a + 1) for dice, start, a in runs(templates[k], [g for _, g in hits], [p for p, _ in hits], least)]
                            if some:
                                found.setdefault(templates[k].licence, []).extend(some)
                        rows += [(ids[first + r].as_py(), licence, *x) for licence, x in sorted(apart(found).items())]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "licence", "dice", "first_word", "n_words"])

    return releasing(run)


def scan_licences(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, licence, dice, first_word, n_words): for each row of docs (doc_id, text) and licence found in it, its best run.

    All runs that reach `least` are compared, best first; one that overlaps a better one that stayed is left out, and the
    licence's next ones count. Whole texts are scanned. Null and wordless texts hold nothing; of equally good runs the first counts. Repeated rows
    each give their rows. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(prepare(templates), least), "doc_id long, licence string, dice double, first_word long, n_words long")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
