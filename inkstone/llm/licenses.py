"""Licence scans: the Dice coefficient of word bigrams between normalised text and licence templates.

A document is compared as a whole (a licence file), by paragraph and by line (a notice inside other text). A unit of n
distinct bigrams can reach the threshold t only with templates of m bigrams where ``2 * min(n, m) / (n + m) >= t``; these
size bounds prune the templates, sorted by size, before any bigram is compared.

A licence that is no such unit (several paragraphs above code, a comment block, part of a line) is found as a *passage*: of
all runs of consecutive words, the one with the highest score for a template, then the best that does not overlap it, and
so on; among equals the shortest, then the first. Only templates of which the whole text holds ``t / (2 - t)`` of the
bigrams can have one. A passage is left out if a match that overlaps it shares at least as many bigrams with its own
template, and that template holds at least half of those which the passage shares with its one: the text is then explained
already (a notice inside its licence, BSD-2 inside BSD-3).

Defined cases: null and empty texts, and units without words, match nothing; a unit of one word has no bigram and matches
nothing; equal scores go to the template first in the list; repeated rows each get their own result; other columns pass
through, and output columns replace those of the same name.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches

THRESHOLD = 0.8
FOUND = "array<struct<license:string,template:string,score:double,unit:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("license", pa.string()), ("template", pa.string()), ("score", pa.float64()), ("unit", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# Names and texts of public licences and of the notices in common use.
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit-notice": ("MIT", "Released under the MIT License."),
    "mit-notice-2": ("MIT", "This project is licensed under the terms of the MIT license."),
    "mit": ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "apache-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-header": ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    "gpl3-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl3-header": ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-notice": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "rights-notice": ("All-rights-reserved", "All rights reserved."),
    "isc": ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    "bsd-2": ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    "bsd-2-full": ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "bsd-3-full": ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "unlicense": ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    "unlicense-full": ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"""),
    "mpl-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

# Public licences whose whole texts are files beside this one.
WHOLE_TEXTS = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@lru_cache(maxsize=1)
def standard_templates() -> dict[str, tuple[str, str]]:
    """Notices and short licences, and the whole texts. Read on the driver; tasks get them with the function that they run."""
    whole = {f"{name.lower()}-whole": (spdx, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name, spdx in WHOLE_TEXTS.items()}
    return TEMPLATES | whole


_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    license: str
    grams: frozenset


class Templates:
    """Sorted by number of bigrams, so that a size bound is a slice."""

    def __init__(self, texts: dict[str, tuple[str, str]], threshold: float):
        made = [Template(name, spdx, frozenset(bigrams(normalised(text)))) for name, (spdx, text) in texts.items()]
        self.order = {t.name: i for i, t in enumerate(made)}
        self.sorted = sorted((t for t in made if t.grams), key=lambda t: len(t.grams))
        self.sizes = [len(t.grams) for t in self.sorted]
        self.threshold = threshold
        self.holding: dict[tuple[str, str], list[Template]] = {}
        for t in self.sorted:
            for gram in t.grams:
                self.holding.setdefault(gram, []).append(t)
        self.bounds = (self.sizes[0] * threshold / (2 - threshold), self.sizes[-1] * (2 - threshold) / threshold) if made else (1, 0)

    def candidates(self, n: int) -> list[Template]:
        t = self.threshold
        return self.sorted[bisect_left(self.sizes, n * t / (2 - t) - 1e-9) : bisect_right(self.sizes, n * (2 - t) / t + 1e-9)]

    def best(self, words: list[str]) -> tuple[Template, float] | None:
        if len(words) - 1 < self.bounds[0] - 1e-9:
            return None
        grams = bigrams(words)
        scored = [(dice(grams, t.grams), -self.order[t.name], t) for t in self.candidates(len(grams))]
        score, _, template = max(scored, key=lambda s: s[:2], default=(0.0, 0, None))
        return (template, score) if template and score >= self.threshold else None

    def scan(self, text: str) -> list[dict]:
        """Matches of the whole text, its paragraphs and its lines, then passages; a unit that equals the one around it isn't compared again."""
        found: list[dict] = []
        matched: list[tuple[Template, int, int]] = []

        def add(template: Template, score: float, unit: str, start: int, end: int) -> None:
            found.append({"license": template.license, "template": template.name, "score": score, "unit": unit, "start": start, "end": end})
            matched.append((template, start, end))

        def compare(unit: str, start: int, end: int) -> None:
            if hit := self.best(normalised(text[start:end])):
                add(*hit, unit, start, end)

        all_words = normalised(text)
        if hit := self.best(all_words):
            add(*hit, "text", 0, len(text))
        at = 0
        edges = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)] + [(len(text), len(text))]
        for stop, after in edges:
            if (at, stop) != (0, len(text)):
                compare("paragraph", at, stop)
            low = at
            while low < stop:
                high = text.find("\n", low, stop)
                high = stop if high < 0 else high
                if (low, high) != (at, stop):
                    compare("line", low, high)
                low = high + 1
            at = after
        for template, score, start, end in self.passages(text, all_words, matched):
            add(template, score, "passage", start, end)
        return found

    def passages(self, text: str, words: list[str], matched: list[tuple[Template, int, int]]) -> list[tuple[Template, float, int, int]]:
        """(template, score, start, end) of passages that ``matched`` (template, start, end) do not explain, by place."""
        shared = Counter(t.name for g in self.holding.keys() & set(zip(words, words[1:], strict=False)) for t in self.holding[g])
        least = self.threshold / (2 - self.threshold)
        able = [t for t in self.sorted if shared[t.name] and shared[t.name] >= least * len(t.grams) - 1e-9]
        if not able:
            return []
        places = [m.span() for m in _WORD.finditer(text.lower())]
        if len(text.lower()) != len(text):
            origin = [i for i, c in enumerate(text) for _ in c.lower()]
            places = [(origin[a], origin[b - 1] + 1) for a, b in places]
        grams = list(zip(words, words[1:], strict=False))
        common = lambda t, a, b: t.grams.intersection(grams[a:b])
        starts, ends = [a for a, _ in places], [b for _, b in places]
        # whole words inside the units that match
        taken = [(t, a, b, len(common(t, bisect_left(starts, a), max(bisect_right(ends, b) - 1, 0)))) for t, a, b in matched]
        made = []
        for t in able:
            made += [(len(common(t, a, b)), score, t, a, b) for score, a, b in windows(grams, t.grams, self.threshold)]
        out = []
        for n, score, t, a, b in sorted(made, key=lambda x: (-x[0], -x[1], self.order[x[2].name], x[3])):
            start, end, own = places[a][0], places[b][1], common(t, a, b)
            if not any(m >= n and start < e and s < end and 2 * len(own & o.grams) >= n for o, s, e, m in taken):
                taken.append((t, start, end, n))
                out.append((t, score, start, end))
        return sorted(out, key=lambda x: (x[2], x[3], self.order[x[0].name]))


def windows(grams: list[tuple[str, str]], wanted: frozenset, threshold: float) -> list[tuple[float, int, int]]:
    """(score, from, to) of the best run of bigrams, then the best that shares no word with it, and so on down to the threshold.

    A best run starts with a wanted bigram that does not come again in it. Runs from one start are scored together: a
    bigram is new in a run if its previous place is before the start.
    """
    last: dict[tuple[str, str], int] = {}
    previous = np.full(len(grams), -1, np.int64)
    following = np.full(len(grams), len(grams), np.int64)
    for i, g in enumerate(grams):
        if (p := last.get(g)) is not None:
            previous[i], following[p] = p, i
        last[g] = i
    hit = np.fromiter((g in wanted for g in grams), bool, len(grams))
    m = len(wanted)
    most = m * (2 - threshold) / threshold + 1e-9

    def best(i: int, stop: int) -> tuple[float, int, int] | None:
        stop, found, n, c, k = min(stop, int(following[i])), None, 0, 0, i
        while k < stop and n <= most:
            high = min(stop, k + max(256, 2 * m))
            new = previous[k:high] < i
            size, common = n + np.cumsum(new), c + np.cumsum(new & hit[k:high])
            score = 2 * common / (size + m)
            j = int(score.argmax())
            if found is None or score[j] > found[0]:
                found = (float(score[j]), i, k + j + 1)
            n, c, k = int(size[-1]), int(common[-1]), high
        return found if found and found[0] >= threshold else None

    queue = [(-f[0], f[2] - f[1], f[1]) for i in np.flatnonzero(hit).tolist() if (f := best(i, len(grams)))]
    heapify(queue)
    out: list[tuple[float, int, int]] = []
    froms: list[int] = []
    tos: list[int] = []
    while queue:
        score, length, i = heappop(queue)
        k = bisect_right(froms, i)
        if k and tos[k - 1] >= i:
            continue
        # runs share no word: there is one bigram at least between them
        if k < len(froms) and froms[k] <= i + length:
            if f := best(i, froms[k] - 1):
                heappush(queue, (-f[0], f[2] - f[1], i))
            continue
        froms.insert(k, i)
        tos.insert(k, i + length)
        out.append((-score, i, i + length))
    return out


def find_licenses(text: Column, templates: dict[str, tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> Column:
    """Array of matches, in code points."""
    texts = standard_templates() if templates is None else templates

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        prepared = Templates(texts, threshold)
        for batch in batches:
            yield pa.array([prepared.scan(t) if t else [] for t in batch.to_pylist()], _FOUND)

    return run(text)


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all matches, the number of them, the distinct licences and the best score."""
    modest_batches(docs.sparkSession)
    docs = docs.withColumn("matches", find_licenses(F.col(text_col), templates, threshold))
    return docs.withColumns({"n_matches": F.size("matches").cast("long"), "licenses": F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), "best_score": F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))})
