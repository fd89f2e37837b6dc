"""License scan by conditional compression.

Blocks are cut where a text shares runs of words with a template: a block within the tolerance of a template keeps a known share
of the template's word triples, so one walk over the words finds every place that can hold one. Where the template's first and last
run stand there and what lies between agrees, that is the block; else all stretches of the place that can begin and end one are
aligned with the template, so that an edit at an end is found like any other. Each block is compressed with
Zstandard, once plainly and once per template with the template as raw dictionary. Templates are ranked by the share of bytes
that they save; the first that the exact differences of wording confirm is the block's license. Of blocks that overlap, the one
that saves most bytes is told."""

from __future__ import annotations

import difflib
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches

#: Share of a template's words that may be missing, and that may be added (each rounded down, so short notices must be word for
#: word). Words with a digit, such as versions, may never differ.
TOLERANCE = 0.1
#: Words in a row by which places are found; blocks whose answers a task keeps.
RUN, MOST_KEPT = 3, 4096

# Notices, openings and whole texts of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
FOUND = "doc_id long, block_start int, block_end int, license string, saved_bytes int, words_missing int, words_added int, wording string, saved_share double"


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Templates:
    """The templates with one compressor each, and where their word runs stand."""

    def __init__(self, templates: dict[str, str], tolerance: float = TOLERANCE):
        import zstandard as zstd

        self.words = {k: w for k, t in templates.items() if (w := words(t))}
        self.most = {k: int(tolerance * len(w)) for k, w in self.words.items()}
        self.kept: dict[bytes, tuple | None] = {}
        self.stretches = lru_cache(MOST_KEPT)(self._stretches)
        self.plain = zstd.ZstdCompressor(level=19)
        raw = lambda t: zstd.ZstdCompressionDict(t.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        self.given = {k: zstd.ZstdCompressor(level=19, dict_data=raw(templates[k])) for k in self.words}
        self.runs: dict[int, dict[tuple, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        self.least = {}
        for k, w in self.words.items():
            run = min(RUN, len(w))
            # A missing word breaks up to `run` runs, an added one up to run - 1; those that are left tell the place.
            self.least[k] = max(1, len(w) - run + 1 - (2 * run - 1) * self.most[k])
            for at in range(len(w) - run + 1):
                self.runs[run][tuple(w[at : at + run])].append((k, at))

    def places(self, said: list[str]) -> Iterator[tuple[str, list[tuple[int, int]], int, int]]:
        """(template, blocks by its first and last run, first word, end word) of all places in a text's words that can hold a template.

        One walk collects the template runs that stand in the text. Those of one block lie on few diagonals (place in the text
        less place in the template), as edits shift them by no more than may be missing or added; diagonals are put into
        bands of that width, and two neighbouring bands with enough runs are a place."""
        hits: dict[str, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for run, known in self.runs.items():
            for at, gram in enumerate(zip(*(said[k:] for k in range(run)))):
                for name, offset in known.get(gram, ()):
                    hits[name][(at - offset) // (2 * self.most[name] + 1)].append((at, offset))
        for name, bands in hits.items():
            n, most, least = len(self.words[name]), self.most[name], self.least[name]
            run, width = min(RUN, n), 2 * most + 1
            for band, own in bands.items():
                both = own + bands.get(band + 1, []) if most else own
                if len(both) >= least:
                    starts, ends = {p for p, o in both if o == 0}, {p + run for p, o in both if o == n - run}
                    sure = sorted(((abs(e - s - n), s, e) for s in starts for e in ends if abs(e - s - n) <= most))
                    low, high = band * width, (band + (2 if most else 1)) * width - 1
                    yield name, [x[1:] for x in sure], max(0, low - most), min(len(said), high + n + most)

    def _stretches(self, name: str, said: tuple[str, ...]) -> list[tuple[int, int]]:
        """All (first word, end word) within a place whose words keep enough of the template's in order, the closest first.

        A block begins with one of the template's first words and ends with one of its last: whatever is missing or added there
        is counted, and a stretch with added words at its ends is no block."""
        ours, most = self.words[name], self.most[name]
        n, first, last = len(ours), set(self.words[name][: most + 1]), set(self.words[name][-most - 1 :])
        there = {w: np.array([x == w for x in said]) for w in set(ours)}
        out = []
        for s in (k for k, w in enumerate(said) if w in first):
            longest = min(n + most, len(said) - s)
            if longest < n - most:
                break
            kept = np.zeros(longest + 1, np.int32)  # words in common with what begins here, by its length
            for k, w in enumerate(ours):
                kept[1:] = np.maximum(kept[1:], kept[:-1] + there[w][s : s + longest])
                np.maximum.accumulate(kept, out=kept)
                if kept[-1] < k + 1 - most:
                    break
            else:
                size = np.arange(longest + 1)
                for m in np.flatnonzero((n - kept <= most) & (size - kept <= most)).tolist():
                    if said[s + m - 1] in last:
                        out.append((n + m - 2 * int(kept[m]), s, s + m))
        return [x[1:] for x in sorted(out)]

    def ranked(self, block: bytes) -> list[tuple[float, int, str]]:
        """(share of the plainly compressed bytes that a template saves, bytes saved, template), most first, then by name."""
        plain = len(self.plain.compress(block))
        saved = [(plain - len(c.compress(block)), name) for name, c in self.given.items()]
        return sorted(((s / plain, s, name) for s, name in saved if s > 0), key=lambda x: (-x[0], x[2]))

    def differences(self, name: str, theirs: list[str]) -> tuple[list[str], list[str]]:
        """Words of the template that the block lacks, and words it has instead: as few as there can be if that is within the tolerance."""
        ours = self.words[name]
        if ours == theirs:
            return [], []
        missing, added = [], []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
            if kind != "equal":
                missing += ours[a:b]
                added += theirs[c:d]
        if self._within(name, missing, added):
            return missing, added
        # The matcher above looks for long runs; the fewest differences come from an alignment of all words.
        lacking, extra = (sum((Counter(x) - Counter(y)).values()) for x, y in ((ours, theirs), (theirs, ours)))
        numbers = [sorted(w for w in x if any(c.isdigit() for c in w)) for x in (ours, theirs)]
        return aligned(ours, theirs) if max(lacking, extra) <= self.most[name] and numbers[0] == numbers[1] else (missing, added)

    def _within(self, name: str, missing: list[str], added: list[str]) -> bool:
        return max(len(missing), len(added)) <= self.most[name] and not any(c.isdigit() for w in (*missing, *added) for c in w)

    def agrees(self, name: str, theirs: list[str]) -> bool:
        return abs(len(theirs) - len(self.words[name])) <= self.most[name] and self._within(name, *self.differences(name, theirs))

    def confirmed(self, block: bytes, said: list[str]) -> tuple | None:
        """(bytes saved, share, template, missing words, added words) of the best-ranked template whose wording agrees.

        Answers for blocks seen before are kept: notices are mostly the same bytes."""
        if block not in self.kept:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            self.kept[block] = self._confirmed(block, said)
        return self.kept[block]

    def _confirmed(self, block: bytes, said: list[str]) -> tuple | None:
        for share, saved, name in self.ranked(block):
            if self.agrees(name, said):
                return saved, share, name, *self.differences(name, said)
        return None

    def told(self, text: str) -> list[tuple]:
        """(start, end, license, saved, missing, added, wording, share) of a text's blocks, in order; none overlaps another."""
        starts, ends, said = array("q"), array("q"), []
        for m in _WORD.finditer(text):
            starts.append(m.start())
            ends.append(m.end())
            said.append(m.group().lower())
        found = {}
        for name, sure, low, high in self.places(said):
            near = (x for x in sure if self.agrees(name, said[x[0] : x[1]]))
            block = next(near, None)
            if block is None:
                wide = ((low + s, low + e) for s, e in self.stretches(name, tuple(said[low:high])))
                block = next((x for x in wide if self.agrees(name, said[x[0] : x[1]])), None)
            if block and block not in found:
                found[block] = self.confirmed(text[starts[block[0]] : ends[block[1] - 1]].encode("utf-8", "replace"), said[block[0] : block[1]])
        out = []
        for low, high, (saved, share, name, missing, added) in apart(sorted((*b, hit) for b, hit in found.items() if hit)):
            wording = " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in added])
            out.append((starts[low], ends[high - 1], name, saved, len(missing), len(added), wording, share))
        return out


def aligned(ours: list[str], theirs: list[str]) -> tuple[list[str], list[str]]:
    """The words of either side that the other has not, by an alignment that keeps most words, words with a digit before all."""
    rows = [np.zeros(len(theirs) + 1, np.int64)]
    there = {w: np.array([x == w for x in theirs]) for w in set(ours)}
    for w in ours:
        row = rows[-1].copy()
        row[1:] = np.maximum(row[1:], rows[-1][:-1] + there[w] * (len(ours) + 1 if any(c.isdigit() for c in w) else 1))
        rows.append(np.maximum.accumulate(row))
    a, b, missing, added = len(ours), len(theirs), [], []
    while a or b:
        if a and rows[a][b] == rows[a - 1][b]:
            a -= 1
            missing.append(ours[a])
        elif b and rows[a][b] == rows[a][b - 1]:
            b -= 1
            added.append(theirs[b])
        else:
            a, b = a - 1, b - 1
    return missing[::-1], added[::-1]


def apart(found: list[tuple]) -> list[tuple]:
    """Of blocks (first word, end word, (bytes saved, ...)) in order, those that overlap none that saves more bytes, in order."""
    out: list[tuple] = []
    chain: list[tuple] = []
    reach = 0
    for block in [*found, None]:
        if block is None or block[0] >= reach:  # a chain of overlapping blocks ends
            taken: list[tuple] = []
            for x in sorted(chain, key=lambda x: (-x[2][0], x[0], x[1])):
                if all(x[1] <= t[0] or t[1] <= x[0] for t in taken):
                    taken.append(x)
            out += sorted(taken, key=lambda x: x[:2])
            chain = []
        if block is not None:
            chain.append(block)
            reach = max(reach, block[1])
    return out


def telling_words(templates: dict[str, str], tolerance: float = TOLERANCE) -> list[str] | None:
    """Words of which a text must have one to hold any template: of each template one more than may be missing, the longest first.
    None if a template has too few words of plain letters."""
    out: set[str] = set()
    for t in templates.values():
        own = words(t)
        plain = sorted({w for w in own if re.fullmatch("[a-z]+", w)}, key=lambda w: (-len(w), w))
        need = int(tolerance * len(own)) + 1
        if own and len(plain) < need:
            return None
        out |= set(plain[:need] if own else [])
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed license block: doc_id, block_start, block_end (characters), license, saved_bytes, words_missing,
    words_added, wording (the differences), saved_share.

    Whole texts are scanned, in time that grows with their length. Null or empty texts give no rows; repeated rows give theirs
    again; of templates that save the same share, the first by name is tried first. Other columns are not read. No templates, no
    rows."""
    bound_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, tolerance)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in known.told(text)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    there = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    telling = telling_words(templates, tolerance)
    if telling is not None:  # exact: a text without any of these words is beyond the tolerance of every template
        said = F.split(F.lower("text"), "[^a-z0-9]+")
        there = there.where(F.arrays_overlap(said, F.array(*map(F.lit, telling)).cast("array<string>")))
    return there.mapInArrow(run, FOUND)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
