"""License scan by patience alignment of texts with license templates.

Words unique to both a stretch of text and a template are anchors; the longest increasing run
of their places is kept, and the gaps between kept anchors are aligned the same way.  Coverage
is the share of a template's words aligned.  An alignment must lie within twice the template's
length of text, so each text is searched in windows of three template lengths, a template
length apart, which hold every such stretch.  A window whose words could not reach the least
coverage, counted with repeats, is passed over: that bound is exact.  Words around a license can
repeat its anchors, so a window is aligned whole and again between the starts and ends that runs
of words shared with the template suggest, and each time within what was aligned, until it stands still.

Templates are whole texts (also those in ``license_texts``), headers and short notices.  A notice
is found only where all its words stand together, since one word (a version, NC) makes another
license of it.  The license with most words found comes first; another one most of whose aligned words
stand in its place (BSD-2-Clause in a BSD-3-Clause text) is not reported, unless it stands elsewhere too.

Edge cases: null and empty texts match nothing; ties go to the higher coverage, then to the
first window; repeated rows are scanned alike; texts of any length are scanned whole; extra
columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from quarrymill.llm.common import mapped

WORD = re.compile(r"[^\W_]+")
#: Least share of a template's words to report it.
COVERAGE = 0.8

#: What licenses of one family share.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. {} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
        IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
        ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
        ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the
        GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at
        your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        {1} Public License for more details."""
#: Texts and headers of well-known licenses.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(
        """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""
    ),
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": _GNU.format("program", "General", "2"),
    "GPL-3.0-or-later": _GNU.format("program", "General", "3"),
    "AGPL-3.0-or-later": _GNU.format("program", "Affero General", "3"),
    "LGPL-2.1-or-later": _GNU.format("library", "Lesser General", "2.1"),
    "LGPL-3.0-or-later": _GNU.format("library", "Lesser General", "3"),
} | {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Notices, each in all its wordings.
NOTICES = {
    "MIT-notice": ("Released under the MIT License.", "under the MIT License", "SPDX-License-Identifier: MIT"),
    "ISC-notice": ("under the ISC License", "SPDX-License-Identifier: ISC"),
    "BSD-2-Clause-notice": ("BSD 2-Clause", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause-notice": ("BSD 3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "Apache-2.0-notice": ("Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "MPL-2.0-notice": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense-notice": ("under the Unlicense", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0-notice": ("CC0 1.0",),
}
for _name, _words, _short in (("GPL", "General", "GPL"), ("LGPL", "Lesser General", "LGPL"), ("AGPL", "Affero General", "AGPL")):
    for _version in {"GPL": ("2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",)}[_name]:
        _bare, _long = _version.removesuffix(".0"), f"GNU {_words} Public License"
        NOTICES[f"{_name}-{_version}-notice"] = (
            f"This work is licensed under the {_long}, version {_bare}.", f"{_long}, version {_bare}", f"{_long} version {_version}", f"{_long} v{_bare}",
            f"version {_bare} of the {_long}", f"under the {_short} version {_bare}", f"SPDX-License-Identifier: {_short}-{_version}",
        )
for _kind, _long in (("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        NOTICES[f"CC-BY{_kind}-{_version}-notice"] = (
            f"Licensed under CC BY{_kind} {_version}.", f"CC BY{_kind} {_version}", f"Creative Commons Attribution{_long} {_version}",
            f"creativecommons.org/licenses/by{_kind.lower()}/{_version}",
        )
#: What follows a license's name in the names of its templates.
FORM = re.compile(r"(-or-later|-text|-notice)+$")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles as in patience sorting."""
    tops, at, before = [], [], []
    for k, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [k]
        before.append(at[pile - 1] if pile else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience_alignment(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned places in two word lists, increasing in both."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(k, place[a[k]]) for k in range(a0, a1) if in_a[a[k]] == 1 and a[k] in place]
        kept = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        if kept:
            pairs += kept
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            gaps += [(x0 + 1, x1, y0 + 1, y1) for (x0, y0), (x1, y1) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def densest_run(pairs: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Most aligned pairs whose first members lie within ``reach``, the first such run."""
    best, low = (0, 0), 0
    for high, (x, _) in enumerate(pairs):
        while x - pairs[low][0] >= reach:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return pairs[slice(*best)]


def densest(pairs: list[tuple[int, int]], reach: int) -> tuple[int, int, int]:
    """The same run as (count, first, last)."""
    run = densest_run(pairs, reach)
    return (len(run), run[0][0], run[-1][0]) if run else (0, 0, 0)


def phrase_at(words: list[str], phrase: list[str]) -> int:
    """The first place where the words of ``phrase`` stand together, or -1."""
    at, n = -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                return at
    except ValueError:
        return -1


def _seed_size(n: int) -> int:
    return 3 if n >= 24 else 1


def _seeds(words: list[str], size: int) -> dict[tuple[str, ...], list[int]]:
    """Places of the runs of ``size`` words."""
    out = {}
    for k in range(len(words) - size + 1):
        out.setdefault(tuple(words[k : k + size]), []).append(k)
    return out


class Scanner:
    """Templates as word lists, with the counts that bound their coverage, and notices."""

    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.templates = {k: words_of(v) for k, v in (templates or TEMPLATES).items()}
        self.notices = {k: sorted(map(words_of, v), key=len, reverse=True) for k, v in ({} if templates else NOTICES).items()}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.vocabulary = frozenset(w for v in self.templates.values() for w in v)
        self.coverage = coverage
        self.seeds = {k: _seeds(v, _seed_size(len(v))) for k, v in self.templates.items()}

    def _bound(self, name: str, found: Counter) -> float:
        return sum(min(n, found[w]) for w, n in self.counts[name].items() if w in found) / len(self.templates[name])

    def _noticed(self, words: list[str]) -> list[tuple[int, str, float, int, int]]:
        out, there = [], set(words)
        for name, phrases in self.notices.items():
            for phrase in phrases:
                if there.issuperset(phrase) and (at := phrase_at(words, phrase)) >= 0:
                    out.append((len(phrase), name, 1.0, at, at + len(phrase) - 1))
                    break
        return out

    def _bounds(self, name: str, window: list[str]) -> list[tuple[int, int]]:
        """Stretches between likely starts and ends: where runs near an end of the template say that it is, and where most runs do.

        For templates too short for runs of several words these are all stretches.
        """
        n, size = len(self.templates[name]), _seed_size(len(self.templates[name]))
        if size == 1:
            return [(a, b) for a in range(len(window)) for b in range(a + 1, min(len(window), a + 2 * n) + 1) if b - a >= self.coverage * n]
        votes, most = {"start": Counter(), "end": Counter(), "all": Counter()}, max(6, 400 // n)
        for k in range(len(window) - size + 1):
            for j in self.seeds[name].get(tuple(window[k : k + size]), ()):
                for part, near in (("start", 4 * j <= n), ("end", 4 * (j + size) >= 3 * n), ("all", True)):
                    if near:
                        votes[part][k - j] += 1
        often = [d for d, _ in votes["all"].most_common(3)]
        starts, ends = (dict.fromkeys([d for d, _ in votes[part].most_common(most)] + often) for part in ("start", "end"))
        found = {(max(0, a), min(len(window), b + n)) for a in starts for b in ends}
        return sorted((a, b) for a, b in found if self.coverage * n <= b - a <= 2 * n)

    def _best(self, name: str, window: list[str]) -> list[tuple[int, int]]:
        """The best alignment found in a window, of equal ones that over fewest words."""
        template = self.templates[name]
        n = len(template)

        def better(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
            rank = lambda p: (len(p), p[0][0] - p[-1][0] if p else 0)
            return y if rank(y) > rank(x) else x

        def aligned(a: int, b: int) -> list[tuple[int, int]]:
            best = []
            while a < b:
                pairs = densest_run([(x + a, y) for x, y in patience_alignment(window[a:b], template)], 2 * n)
                if better(best, pairs) is best:
                    break
                best, a, b = pairs, pairs[0][0], pairs[-1][0] + 1
            return best

        best = aligned(0, len(window))
        if len(best) == n == best[-1][0] - best[0][0] + 1:
            return best
        for a, b in self._bounds(name, window):
            best = better(best, aligned(a, b))
        return best

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of the templates found, most words first."""
        words = words_of(text)
        known = Counter(filter(self.vocabulary.__contains__, words))
        some, out = known.total(), [(n, name, share, range(first, last + 1)) for n, name, share, first, last in self._noticed(words)]
        for name, template in self.templates.items():
            if some < self.coverage * len(template) or self._bound(name, known) < self.coverage:
                continue
            n = len(template)
            for start in range(0, max(1, len(words) - n), n):
                window = words[start : start + 3 * n]
                if self._bound(name, Counter(filter(self.vocabulary.__contains__, window))) >= self.coverage:
                    pairs = self._best(name, window)
                    if len(pairs) >= self.coverage * n:
                        out.append((len(pairs), name, len(pairs) / n, [start + x for x, _ in pairs]))
        kept = []
        for _, name, share, at in sorted(out, key=lambda x: (-x[0], -x[2], x[3][0])):
            license = FORM.sub("", name)
            inside = lambda first, last: 2 * (bisect.bisect_right(at, last) - bisect.bisect_left(at, first)) > len(at)  # noqa: B023, E731
            if all(other != name and (FORM.sub("", other) == license or not inside(first, last)) for other, _, first, last in kept):
                kept.append((name, share, at[0], at[-1]))
        return kept


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document: its best license with coverage and place, and all licenses."""
    scanner = Scanner(templates, coverage)

    def made(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(part.doc_id, part.text, strict=True):
            found = scanner.scan(text)
            name, share, first, last = found[0] if found else (None, 0.0, None, None)
            rows.append((doc_id, name, share, first, last, ",".join(x[0] for x in found)))
        out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "first_word", "last_word", "licenses"])
        return out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    schema = "doc_id long, license string, coverage double, first_word long, last_word long, licenses string"
    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), made, schema)
