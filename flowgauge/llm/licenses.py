"""License scans by conditional compression.

A block that agrees with a template holds two thirds of its words or more, so that of any words that make up more than a
third of the template one must be in the block: the longest of them are its cues, and a text without a cue has no notice.
Candidate blocks begin at the sentence that holds a cue, at the word that would be the template's first if the cue is
where the template has it, and where a template's opening words occur; they are as long as the template they are compared
with, line ends and comment marks aside. Each block is compressed by itself and with each template that may agree (two
thirds of its words follow there) as Zstandard raw-content dictionary. The templates are ranked by how much smaller the
block gets, and confirmed in this order by their exact differences in wording: the first that agrees is the block's
license, and none after it is looked at. A template that takes less than LEAST_CUT off a block isn't confirmed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from flowgauge.llm.common import texts

#: The wording of common license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Least share of the wording that must agree (twice the words in common, by the words of both).
AGREE = 0.8
LEVEL = 3
#: Least part of a block's compressed size that the template must take off.
LEAST_CUT = 0.1
#: Words that are cues only where a template has no others.
COMMON = frozenset("a all also and any are as at be been but by can do for from had has have he if in is it its may more must no not of on one or other our out shall she that the their there these they this to under use used was we were which will with work would you".split())
#: What parts words, also across the lines of a comment.
GAP = r"[^\w.+-]+(?:[-.+]+[^\w.+-]+)*"
_END = re.compile(r"\n|[.!?](?=\s)")
_WRAP = re.compile(r"\s*\n[\s*#/;%!>|-]*")
_WORD = re.compile(r"[\w.+-]*\w")
def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _phrase(some: list[str]) -> re.Pattern:
    return re.compile(r"(?<!\w)" + GAP.join(map(re.escape, some)) + r"(?!\w)", re.IGNORECASE)


class Scanner:
    def __init__(self) -> None:
        named = [(name, text) for name, all_ in TEMPLATES.items() for text in all_]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = [(name, text, words(text), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, text in named]
        #: All cues, to tell in one pass whether a text has any.
        self.finder = ahocorasick.Automaton()
        #: Each template's opening and closing words, and the places that its cues have in it.
        self.opening, self.closing, self.places = {}, [], {}
        for at, (_, _, wanted, _) in enumerate(self.templates):
            self.opening.setdefault(_phrase(wanted[:2]), []).append(at)
            self.closing.append(_phrase(wanted[-2:]))
            for cue in self.cues(wanted):
                self.places.setdefault(cue, []).extend((k, at) for k, w in enumerate(wanted) if w == cue)
                self.finder.add_word(cue, cue)
        self.finder.make_automaton()

    @staticmethod
    def cues(wanted: list[str]) -> set[str]:
        """Words one of which is in every text that agrees: of the words wanted a block may lack a third at most, for of m in
        common and a block of b >= m words, 2 m / (len(wanted) + b) >= AGREE asks for m >= 2 / 3 len(wanted)."""
        found: set[str] = set()
        for w in sorted(set(wanted), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(x in found for x in wanted) > len(wanted) * (2 - 2 * AGREE) / (2 - AGREE) + 1e-9:
                break
            found.add(w)
        return found

    def begins(self, text: str) -> dict[int, set[int] | None]:
        """Where blocks begin, and the templates to compare there: all (None) where a sentence with a cue begins."""
        found: dict[int, set[int] | None] = {}
        spots = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
        starts = [spot for spot, _ in spots]
        ends = [0, *(m.end() for m in _END.finditer(text))]
        for n, (spot, word) in enumerate(spots):
            if (places := self.places.get(word)) is None:
                continue
            first = bisect.bisect_left(starts, ends[bisect.bisect_right(ends, spot) - 1])
            found[starts[first]] = None
            for k, at in places:
                if n >= k:
                    self._add(found, starts[n - k], [at])
        if found:
            for opening, which in self.opening.items():
                for m in opening.finditer(text):
                    self._add(found, m.start(), which)
        return found

    @staticmethod
    def _add(found: dict[int, set[int] | None], begin: int, which: list[int]) -> None:
        if found.get(begin, which) is not None:
            found.setdefault(begin, set()).update(which)

    def block(self, text: str, begin: int, at: int) -> str:
        """Text from begin on, through that end of a sentence, a line or the template's wording which lies nearest to its size."""
        size = len(self.templates[at][1])
        high = min(len(text), begin + size + size // 2 + 40)
        ends = {m.end() for m in _END.finditer(text, begin, high)}
        ends |= {m.end() for m in self.closing[at].finditer(text, begin, high) if text[m.end() : m.end() + 1] not in (".", "!", "?")}
        if high == len(text):
            ends.add(high)
        # a line's end counts as one character, with the marks of a comment
        wraps = [(m.end(), m.end() - m.start() - 1) for m in _WRAP.finditer(text, begin, high)]
        away = lambda e: abs(e - begin - size - sum(n for w, n in wraps if w <= e))
        end = min(ends, key=lambda e: (away(e), e)) if ends else begin + size
        return text[begin:end].rstrip()

    def judge(self, text: str, begin: int, only: set[int] | None, spots: tuple[list[int], list[str]]) -> tuple | None:
        """The confirmed license of the blocks at begin: end, name, size reduction, agreement, words missing, words added,
        differences. spots: where the text's words begin, and the words."""
        ranked, alone = [], {}
        first = bisect.bisect_left(spots[0], begin)
        for at in range(len(self.templates)) if only is None else sorted(only):
            wanted, size = self.templates[at][2], len(self.templates[at][1])
            near = set(spots[1][first : bisect.bisect_left(spots[0], begin + size + size // 2 + 40, first)])
            if 3 * sum(w in near for w in wanted) < 2 * len(wanted):
                continue
            if block := self.block(text, begin, at):
                data = block.encode("utf-8", "surrogatepass")
                whole = alone.get(block) or alone.setdefault(block, len(self.plain.compress(data)))
                ranked.append((1 - len(self.templates[at][3].compress(data)) / whole, -at, block))
        for cut, at, block in sorted(ranked, reverse=True):
            if cut < LEAST_CUT:
                break
            name, _, wanted, _ = self.templates[-at]
            have = words(block)
            matcher = SequenceMatcher(None, wanted, have, autojunk=False)
            if matcher.real_quick_ratio() < AGREE or matcher.quick_ratio() < AGREE or (agree := matcher.ratio()) < AGREE:
                continue
            changes = [(wanted[a:b], have[c:d]) for op, a, b, c, d in matcher.get_opcodes() if op != "equal"]
            return begin + len(block), name, cut, agree, sum(len(x) for x, _ in changes), sum(len(y) for _, y in changes), "; ".join(f"{' '.join(x)} -> {' '.join(y)}" for x, y in changes)
        return None

    def scan(self, text: str) -> Iterator[tuple]:
        if next(self.finder.iter(text.lower()), None) is None:
            return
        # of notices that overlap, the one with the most words in agreement, and then the closest
        found = []
        spots = [(m.start(), m.group().lower()) for m in _WORD.finditer(text)]
        both = [a for a, _ in spots], [w for _, w in spots]
        for begin, only in self.begins(text).items():
            if hit := self.judge(text, begin, only, both):
                have = len(words(text[begin : hit[0]]))
                found.append((-(have - hit[5]), -hit[3], begin, hit))
        kept: list[tuple] = []
        for _, _, begin, hit in sorted(found):
            k = bisect.bisect(kept, (begin,))
            if (not k or kept[k - 1][1] <= begin) and (k == len(kept) or kept[k][0] >= hit[0]):
                kept.insert(k, (begin, *hit))
        yield from kept


def scan(docs: DataFrame) -> DataFrame:
    """A row for each license notice in docs (doc_id, text): doc_id, start, end (code points, end exclusive), license,
    reduction (of the compressed size), agreement (of the wording, at least 0.8), words_missing, words_added, differences.

    A null or empty text has none; null ids and repeated rows are kept; no rows: no rows. Other columns are ignored.
    """
    names = ["doc_id", "start", "end", "license", "reduction", "agreement", "words_missing", "words_added", "differences"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                for begin, end, name, cut, agree, missing, added, changes in scanner.scan(text.as_py()):
                    out.append((doc_id.as_py(), begin, end, name, round(cut, 4), round(agree, 4), missing, added, changes))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return texts(docs).mapInArrow(run, "doc_id long, start long, end long, license string, reduction double, agreement double, words_missing long, words_added long, differences string")
