"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template with m shingles (of five words) belongs to the scale s, the least power of two not below m. At each scale a
text is cut into blocks of s shingles, and two neighbouring blocks are a window, so every run of m shingles lies in one.
A window retrieves a template if they agree in one of BANDS bands of one row: with a containment of 0.8 or more their
Jaccard similarity is 0.16 at least, unless words repeat, so a template is missed with a chance below 1 in 10**9. A
match holds at least ``least`` of the template's distinct shingles in the window's own shingles, exactly.

With ``whole_words`` (as the query does) words are split at ASCII punctuation and at dashes and quotes too, so full
stops, quotation marks and comment signs make no difference, and a template has shingles of two words if it is too
short for longer ones: those of five are taken where one inserted word breaks a fifth of them at most. Else words are
split at ASCII white space alone, and all shingles have ``n`` words. A-Z are lower-cased. Templates and texts of fewer words than a
shingle are one shingle as a whole. Null and empty texts match nothing; very long ones are scanned whole. Of equally good windows of a document and template the first counts.
Repeated rows give repeated results; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, slices
from .near_dedup import Words, mix

SHINGLE = 5
BANDS = 128

#: License notices to look for.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_APART = re.compile(rb"\xe2\x80[\x90-\xaf]")  # dashes, quotes, bullets and special spaces in UTF-8
_BREAKS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes, whole_words: bool) -> list[bytes]:
    if not whole_words:
        return text.lower().split()
    return (_APART.sub(b" ", text) if b"\xe2\x80" in text else text).translate(_BREAKS).split()


def window_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in text order."""
    k = min(n, len(hashes))
    got = np.full(len(hashes) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        got = mix(got + hashes[i : len(hashes) - k + 1 + i])
    return got


def band(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Another 32-bit hash of the shingles' halves for each band."""
    x = low * np.uint32((2 * k * 0x9E3779B1 + 0x85EBCA6B) & 0xFFFFFFFF | 1)
    x += high
    x ^= x >> np.uint32(15)
    x *= np.uint32((4 * k * 0x27D4EB2F + 0xC2B2AE35) & 0xFFFFFFFF | 1)
    x ^= x >> np.uint32(13)
    return x


def halves(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)


class Templates:
    def __init__(self, notices: dict[str, str], n: int = SHINGLE, whole_words: bool = False):
        words = Words()
        self.names = list(notices)
        texts = [split_words(t.encode(), whole_words) for t in notices.values()]
        # an inserted word breaks n - 1 of a template's shingles
        self.lengths = [n if not whole_words or len(t) - n + 1 >= 5 * (n - 1) else min(2, n) for t in texts]
        self.sets = [np.unique(window_shingles(np.array([words[w] for w in t], np.uint64), k)) for t, k in zip(texts, self.lengths, strict=True)]
        # by shingle length, scales from small to large
        self.scales: dict[int, dict[int, list[int]]] = {}
        for i in sorted((i for i, s in enumerate(self.sets) if len(s)), key=lambda i: len(self.sets[i])):
            self.scales.setdefault(self.lengths[i], {}).setdefault(1 << (len(self.sets[i]) - 1).bit_length(), []).append(i)
        # by shingle length, scale and band: the templates' minima in order, whose they are, and a table of their first 16 bits
        self.index: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, scales in self.scales.items():
            for scale, which in scales.items():
                for k in range(BANDS):
                    minima = np.array([band(*halves(self.sets[i]), k).min() for i in which], np.uint32)
                    order = np.argsort(minima, kind="stable")
                    high = np.zeros(1 << 16, bool)
                    high[minima >> np.uint32(16)] = True
                    self.index[length, scale, k] = minima[order], np.array(which)[order], high

    def retrieved(self, key: tuple[int, int, int], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (their numbers) and templates that agree in a band; the work a window doesn't grow with the templates."""
        minima, whose, high = self.index[key]
        likely = np.flatnonzero(high[windows >> np.uint32(16)])
        a, b = np.searchsorted(minima, windows[likely], "left"), np.searchsorted(minima, windows[likely], "right")
        n = b - a
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(likely, n), whose[np.repeat(a, n) + nth]


def scan(docs: DataFrame, notices: dict[str, str] | None = None, least: float = 0.8, n: int = SHINGLE, whole_words: bool = False) -> DataFrame:
    """doc_id, license, containment, and the words (first, after the last) of the best window of each match."""
    templates = Templates(NOTICES if notices is None else notices, n, whole_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, "text"):
            hashes = [np.array(list(map(words.__getitem__, split_words(t or b"", whole_words))), np.uint64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            parts = {length: [window_shingles(h, length) for h in hashes] for length in templates.scales}
            candidates: set[tuple[int, int, int, int]] = set()  # document, template, window: from, to
            for length, scales in templates.scales.items():
                counts = np.array([len(p) for p in parts[length]])
                every = np.concatenate([np.zeros(0, np.uint64), *parts[length]])
                if not len(every):
                    continue
                blocks, parts32 = [], halves(every)
                first, before = np.cumsum(counts) - counts, 1
                for scale in scales:
                    per = -(-counts // scale)
                    doc = np.repeat(np.arange(len(counts)), per)
                    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                    alone = np.where(doc[1:] == doc[:-1], 0, 0xFFFFFFFF).astype(np.uint32)  # the last block of its document is a window of its own
                    blocks.append((scale, doc, nth, first[doc] + nth * (scale // before), alone))  # starts, in blocks of the scale before
                    first, before = np.cumsum(per) - per, scale
                for k in range(BANDS):
                    low = band(*parts32, k)
                    for scale, doc, nth, starts, alone in blocks:
                        if scale > 1:
                            low = np.minimum.reduceat(low, starts)
                        both = low.copy()
                        np.minimum(both[:-1], low[1:] | alone, out=both[:-1])
                        for w, i in zip(*(x.tolist() for x in templates.retrieved((length, scale, k), both)), strict=True):
                            d, a = int(doc[w]), int(nth[w]) * scale
                            candidates.add((d, i, a, min(a + 2 * scale, int(counts[d]))))
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for d, i, a, b in sorted(candidates):
                length, size = templates.lengths[i], len(hashes[d])
                share = len(np.intersect1d(parts[length][d][a:b], templates.sets[i])) / len(templates.sets[i])
                if share >= least and share > best.get((d, i), (0.0,))[0]:
                    best[d, i] = (share, a, min(b + min(length, size) - 1, size))
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], templates.names[i], *x) for (d, i), x in sorted(best.items())]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["doc_id", "license", "containment", "first_word", "end_word"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, first_word int, end_word int")
