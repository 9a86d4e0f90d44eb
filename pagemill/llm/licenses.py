"""License scans: blocks compressed with each template as dictionary, winners confirmed word by word."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import column, pieces

# Names and wordings of public licenses, by SPDX identifier.
NAMES = {
    "MIT": "MIT License", "ISC": "ISC License", "Apache-2.0": "Apache License, Version 2.0", "MPL-2.0": "Mozilla Public License, version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
}
GNU = {
    "GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
IDENTIFIERS = ["MIT", "ISC", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0"]
LEADS = ["Released under the", "Licensed under the", "This work is licensed under the", "Distributed under the"]
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Words that tell licenses apart: one that differs, or any with a digit, isn't forgiven.
TELLING = frozenset("mit isc apache bsd gpl lgpl agpl gnu general lesser library affero mozilla mpl epl cc cc0 by nc nd sa attribution sharealike noncommercial noderivatives noderivs international unported generic style clause later either option only not no never non except neither nor".split())
DENIALS = frozenset("not no never isn aren wasn weren".split())
# End of the fixed values.


def templates_of() -> dict[tuple[str, str], str]:
    """Wordings by (license, kind of wording)."""
    found = {("LicenseRef-all-rights-reserved", "line"): "All rights reserved", ("LicenseRef-BSD-style", "line"): "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", ("LicenseRef-BSD", "opening"): BSD}
    found |= {("MIT", "grant"): GRANT, ("MIT", "text"): GRANT + AS_IS, ("ISC", "text"): ISC, ("Apache-2.0", "notice"): APACHE, ("MPL-2.0", "notice"): MPL}
    found |= {("BSD-2-Clause", "text"): BSD + BSD_TWO + BSD_END, ("BSD-3-Clause", "text"): BSD + BSD_TWO + BSD_THIRD + BSD_END}
    named = dict(NAMES)
    for name, (words, v) in GNU.items():
        named |= {name: f"{words}, version {v}", f"{name}-or-later": f"{words}, version {v} or later"}
        opening = f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} as published by the Free Software Foundation"
        found |= {(f"{name}-or-later", "notice"): f"{opening}, either version {v} of the License, or (at your option) any later version.", (f"{name}-only", "notice"): f"{opening}; version {v} of the License."}
    found |= {(name, f"line {i}"): f"{lead} {words}" for name, words in named.items() for i, lead in enumerate(LEADS)}
    for v, port in CC_VERSIONS.items():
        for terms, words in CC.items():
            found |= {(f"CC-{terms}-{v}", "line"): f"Licensed under CC {terms} {v}", (f"CC-{terms}-{v}", "sentence"): f"This work is licensed under a Creative Commons {words} {v} {port} License"}
    every = IDENTIFIERS + [f"{name}-{end}" for name in GNU for end in ("only", "or-later")] + [f"CC-{terms}-{v}" for terms in CC for v in CC_VERSIONS]
    return found | {(name, "identifier"): f"SPDX-License-Identifier: {name}" for name in every}


TEMPLATES = templates_of()
#: A block surrounds each of these; every template has one, and a wording without any isn't looked for.
HINTS = r"licen[sc]|copyright|spdx|rights\s+reserved|permission|redistribution"
_HINT = re.compile(HINTS, re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
TOLERANCE = 0.1


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def telling(word: str) -> bool:
    return any(c.isdigit() for c in word) or not TELLING.isdisjoint(re.split(r"[.\-]", word))


class Notice(NamedTuple):
    """start and end are characters, differences words; confirmed: nothing that tells licenses apart differs."""

    license: str
    wording: str
    start: int
    end: int
    differences: int
    confirmed: bool
    reduction: float


class Scanner:
    """Finds templates in texts. Around each hint that no notice covers yet, a block is compressed alone and with each
    template as raw dictionary of whose words it holds enough; these are aligned with the block in order of how much
    smaller it gets. Templates of SHORT words or fewer have a block of their own, since a short notice is lost in a long
    one. The time is in proportion to the hints of a text, and to the length of the longest template for each."""

    SHORT, BEFORE, AFTER = 20, 34, 24

    def __init__(self, templates: dict[tuple[str, str], str], tolerance: float = TOLERANCE) -> None:
        self.words = {name: [w for w, *_ in words_of(t)] for name, t in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = {name: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, w in self.words.items()}
        self.counts = {name: tuple(Counter(w).items()) for name, w in self.words.items()}
        #: Words that may differ: a share of the template's, and one at least where it has four.
        self.allowed = {name: max(int(len(w) >= 4), int(tolerance * len(w))) for name, w in self.words.items()}
        self.forgiven = {name: int(tolerance * len(w)) for name, w in self.words.items()}
        self.short = [name for name, w in self.words.items() if len(w) <= self.SHORT]
        self.long = [name for name, w in self.words.items() if len(w) > self.SHORT]
        self.reach = max(map(len, self.words.values())) + self.AFTER

    def possible(self, words: list[str], names: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The templates of whose words the block holds enough, in any order, that they could be found in it."""
        held = Counter(words)
        return [name for name in names if sum(n - min(n, held[w]) for w, n in self.counts[name]) <= self.allowed[name]]

    def reductions(self, words: list[str], names: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
        """How much smaller the block gets with each of these templates as dictionary, as a share of its size without."""
        if not names:
            return {}
        raw = " ".join(words).encode()
        size = len(self.plain.compress(raw))
        return {name: 1 - len(self.given[name].compress(raw)) / size for name in names}

    def differences(self, name: tuple[str, str], block: list[str]) -> tuple[int, int, int, bool] | None:
        """First and last word of the block's best alignment with a template, how many words of either differ there, and
        whether one of them tells licenses apart."""
        want = self.words[name]
        runs = [m for m in SequenceMatcher(None, block, want, autojunk=False).get_matching_blocks() if m.size]
        if not runs:
            return None
        # The longest run stands; runs before and after it count while they cost no more words than they match.
        at = max(range(len(runs)), key=lambda i: runs[i].size)
        low = high = at
        while high + 1 < len(runs) and runs[high + 1].a - runs[high].a - runs[high].size <= runs[high + 1].size + 1:
            high += 1
        while low and runs[low].a - runs[low - 1].a - runs[low - 1].size <= runs[low - 1].size + 1:
            low -= 1
        kept = runs[low : high + 1]
        start, end = kept[0].a, kept[-1].a + kept[-1].size
        odd, matched, own = [], set(), set()
        for m in kept:
            matched.update(range(m.b, m.b + m.size))
            own.update(range(m.a, m.a + m.size))
        odd = [w for i, w in enumerate(want) if i not in matched] + [block[i] for i in range(start, end) if i not in own]
        return start, end, max(len(want), end - start) - len(matched), any(map(telling, odd))

    def stretches(self, text: str) -> Iterator[tuple[int, str]]:
        """Where each stretch about hints begins, and the stretch: all of a text that notices can lie in."""
        spans: list[list[int]] = []
        for m in _HINT.finditer(text):
            low, high = max(0, m.start() - 20 * self.BEFORE), m.end() + 20 * self.reach
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        for low, high in spans:
            while low and not text[low - 1].isspace() and low % 512:
                low -= 1
            yield low, text[low:high]

    def scan(self, text: str | None) -> list[Notice]:
        """The notices of a text in order; they don't overlap."""
        found = []
        for base, part in self.stretches(text or ""):
            words, end = words_of(part), 0
            plain = [w for w, *_ in words]
            for h, w in enumerate(plain):
                if h < end or not (_HINT.search(w) or w == "reserved"):
                    continue
                if hit := self._about(plain, h, end):
                    name, a, b, off, sure, gain = hit
                    found.append(Notice(*name, base + words[a][1], base + words[b - 1][2], off, sure, gain))
                    end = b
        return found

    def _about(self, words: list[str], h: int, low: int) -> tuple[tuple[str, str], int, int, int, bool, float] | None:
        """The best notice that holds word number h and begins at `low` or later."""
        best = None
        for names, before, after in ((self.short, self.SHORT, self.SHORT + 1), (self.long, self.BEFORE, self.reach)):
            a = max(low, h - before)
            block = words[a : h + after]
            gains = self.reductions(block, self.possible(block, names))
            for name in sorted(gains, key=lambda n: (-gains[n], n)):
                if (aligned := self.differences(name, block)) is None:
                    continue
                start, end, off, apart = aligned
                if off > self.allowed[name] or not a + start <= h < a + end:
                    continue
                denied = not DENIALS.isdisjoint(words[max(low, a + start - 2) : a + start])
                sure = off <= self.forgiven[name] and not apart and not denied
                key = (sure, end - start - off, gains[name])
                if best is None or key > best[0]:
                    best = key, (name, a + start, a + end, off, sure, gains[name])
        return best[1] if best else None


@functools.lru_cache(maxsize=4)
def scanner_of(templates: tuple[tuple[tuple[str, str], str], ...], tolerance: float) -> Scanner:
    return Scanner(dict(templates), tolerance)


def scan(docs: DataFrame, templates: dict[tuple[str, str], str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, license, wording, start, end, differences, confirmed, reduction): a row for each notice in docs (doc_id, text;
    other columns are ignored), with its first character and the one after its last. Notices of a text don't overlap.

    Blocks about words such as "license" or "copyright" are compressed alone and with each template as raw dictionary that has
    enough words in them; all of these are aligned. A notice is confirmed if the words that differ, of either side, are at
    most `tolerance` of the template's, rounded down, none of them tells licenses apart (a version, "NonCommercial",
    "later", "not"), and none such as "not" stands before it. One that fails only in this, or by one word, is a near miss: it
    has its row with confirmed false, and its license is only the nearest. Of several templates a confirmed one comes first,
    then the one with most equal words, then with the largest reduction, then the first by name.

    Null and empty texts, and those without a notice, give no rows. Repeated rows give their rows each; a null doc_id is
    carried along. Very long texts are looked at about their hints only. An empty table gives no rows.
    """
    fixed = tuple((TEMPLATES if templates is None else templates).items())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(fixed, tolerance)
        for b in pieces(batches, 256):
            which, rows = [], []
            for i, text in enumerate(column(b, "text").to_pylist()):
                for row in scanner.scan(text):
                    which.append(i)
                    rows.append(row)
            by = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(pa.array(which, pa.int64())), *(pa.array(list(v), k) for v, k in zip(by, kinds, strict=True))], ["doc_id", *Notice._fields])

    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.float64())
    hinted = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(f"(?i){HINTS}"))
    return hinted.mapInArrow(find, "doc_id long, license string, wording string, start long, end long, differences int, confirmed boolean, reduction double")
