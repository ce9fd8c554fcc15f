"""License scans by conditional compression.

What stands around words that licenses use, as far as the longest notice can reach, is a candidate block; every template holds such a word, so no notice whose trigger is there
lies outside. SPDX expressions are cut into one short notice for each identifier. Around each trigger of a block, as far as templates of a scale reach, the words are
compressed by zstandard alone and with each template of the scale as a raw dictionary. What a template saves, as a share of its own compressed size, tells how much of it can be there: templates under LEAST_SAVING are out, and the others are
ranked by bytes saved times this share, so that of templates that are there as a whole the longest comes first. In this order they are confirmed by
their words, aligned wherever in the block they stand: enough of them must be there, few others between them, and no word that differs may be a number or one that tells
licenses apart. Such words are a list and, beyond it, whatever makes two templates of different licenses differ in one place. Of notices that overlap the one of the higher
rank is taken; "not" and the like in or right before a notice refuse it. What stands between the notices of a block is searched again until nothing is
confirmed; spans are those of the aligned words.

Defined results: null and empty texts have no blocks; blocks that no template confirms are counted but name no
license; of templates of equal rank the earlier in TEMPLATES wins; repeated rows repeat; a null doc_id
stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from docnav.llm.common import load

#: Names of licenses and the wording of their notices.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, version {}."
_WORK = "This work is licensed under the GNU {} Public License, version {}."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"
_APACHE_HEAD = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
_GNU_HEAD = "GNU {} Public License Version {}, {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_HEADS = (("GPL-3.0", "General", "3", "29 June 2007", "2007"), ("GPL-2.0", "General", "2", "June 1991", "1989, 1991"), ("LGPL-3.0", "Lesser General", "3", "29 June 2007", "2007"), ("LGPL-2.1", "Lesser General", "2.1", "February 1999", "1991, 1999"), ("AGPL-3.0", "Affero General", "3", "19 November 2007", "2007"))
_CC = (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"))
_GNU = (("GPL-3.0", "General", "3"), ("GPL-2.0", "General", "2"), ("LGPL-3.0", "Lesser General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("AGPL-3.0", "Affero General", "3"))
_NAMED = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache", "the Apache License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("ISC", "the ISC License"),
    ("MPL-2.0", "the Mozilla Public License 2.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC0-1.0", "CC0 1.0"),
    ("Apache-2.0", "the Apache 2.0 License"), ("Zlib", "the zlib License"), ("BSL-1.0", "the Boost Software License, Version 1.0"), ("EPL-2.0", "the Eclipse Public License 2.0"), ("EPL-1.0", "the Eclipse Public License 1.0"),
)
_SPDX = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC0-1.0", "Unlicense", "CC-BY-NC-ND-4.0", "Zlib", "BSL-1.0", "EPL-2.0", "EPL-1.0")
_LABELLED = ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "Zlib", "BSL-1.0", "EPL-2.0", "Unlicense")
TEMPLATES = (
    *((name, f"{lead} {of}.") for name, of in _NAMED for lead in ("Released under", "Licensed under", "Available under")), ("Apache", "or the Apache License"), ("MIT", "or the MIT License"),
    ("MIT", f"{_MIT} {_MIT_NOTICE} {_WARRANTY}"), ("MIT", f"{_MIT} {_MIT_NOTICE}"), ("MIT", _MIT), ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"),
    *((name, _WORK.format(kind, v)) for name, kind, v in _GNU), *((name, _FREE.format(kind, v)) for name, kind, v in _GNU),
    ("MPL-2.0", _MPL.split(" If ")[0]), ("MPL-2.0", _MPL), ("BSD-3-Clause", f"{_REDISTRIBUTE} {_NEITHER}"), ("BSD-2-Clause", _REDISTRIBUTE), ("ISC", _ISC),
    *((name, f"This work is licensed under a Creative Commons {kind} 4.0 International License.") for name, kind in _CC), *((name, f"Creative Commons {kind} 4.0 International") for name, kind in _CC), ("Unlicense", _UNLICENSE.split(" Anyone")[0]), ("Unlicense", _UNLICENSE),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX), *((name, f"License: {name}") for name in _LABELLED), *((name, f"licensed under the terms of {of}.") for name, of in _NAMED), ("Apache-2.0", _APACHE_HEAD),
    *((name, _GNU_HEAD.format(kind, v, day, year)) for name, kind, v, day, year in _GNU_HEADS), *((name, f"GNU {kind} Public License version {v} as published") for name, kind, v in _GNU),
    ("Zlib", _ZLIB), ("BSL-1.0", _BOOST), ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
#: Words that tell licenses apart.
NAMES = frozenset("mit isc apache gnu lesser affero mozilla bsd 3-clause 2-clause cc cc0 by by-sa by-nc by-nd by-nc-sa creative commons unencumbered granted neither".split())
#: Words that refuse a notice.
REFUSALS = frozenset("not never no nor cannot isn't aren't neither".split())
TRIGGER = re.compile(r"licen[cs]|eclipse public|creative commons|copyright|warrant|redistribut|permission|public domain|\bGNU\b|\bCC[ -]?BY|\bCC0|released under|SPDX", re.I)
_MARKS = ".,;:!?\"'()[]*#/ "
#: The mark of a list item: it begins a line, after a line that ended.
_ITEM = re.compile(r"(?:(?<=[.:;,]\n)|(?<=\n\n)|\A)[ \t]*\(?(?:[0-9]{1,2}|[a-z])[.)](?=[ \t])")
#: An SPDX expression, and the identifiers in it.
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)", re.I)
_OPERAND = re.compile(r"(?:(WITH)[ \t]+)?(?!(?:AND|OR|WITH)\b)([A-Za-z0-9.+-]+)", re.I)
#: Shares of a template's words: least that must be there, most others that may stand between them.
LEAST_SHARE, MOST_OTHER = 0.8, 0.25
#: Least share of a template's own compressed size that it must save, and words before a notice in which a refusal counts.
LEAST_SAVING, BEFORE = 0.2, 3
#: Characters of templates of one scale at most; each scale has windows of its own, as what a short notice saves is lost in a long window.
SCALES = (100, 400, 1 << 30)
#: Characters of a notice at most: the longest template, with other words between its own and marks and white space around them.
REACH = int(2 * (1 + MOST_OTHER) * max(len(t) for _, t in TEMPLATES))
#: Cost of a word that tells licenses apart, and costs of a missing word: few differences, or few missing words.
_NEVER, _MISSING = 10**7, (1, 3)


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) without the marks around it, and without the numbers of list items."""
    out = []
    for m in re.finditer(r"\S+", _ITEM.sub(lambda m: " " * len(m[0]), text)):
        left = m.group().lstrip(_MARKS)
        if bare := left.rstrip(_MARKS):
            start = m.end() - len(left)
            out.append((bare.lower(), start, start + len(bare)))
    return out


def words(text: str) -> list[str]:
    return [w for w, _, _ in placed_words(text)]


@cache
def distinguishing() -> frozenset[str]:
    """NAMES, and the words that make two templates of different licenses differ in one place; "version" tells nothing without its number."""
    found, each = set(NAMES), [(name, Counter(words(t))) for name, t in TEMPLATES]
    for i, (a, x) in enumerate(each):
        for b, y in each[:i]:
            if a != b and (more := x - y).total() <= 1 and (less := y - x).total() <= 1:
                found |= set(more) | set(less)
    return frozenset(found - {"version"})


def telling(word: str) -> bool:
    return word in distinguishing() or any(c.isdigit() for c in word)


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans within REACH of a trigger, those that meet as one."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


class Matcher:
    """Compressors for each template, made once in a process."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        options = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.plain = zstandard.ZstdCompressor(compression_params=options)
        self.each, self.size = [], []
        for name, text in templates:
            raw = zstandard.ZstdCompressionDict(self._data(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=options)
            self.each.append((name, words(text), zstandard.ZstdCompressor(compression_params=options, dict_data=raw)))
            self.size.append(len(self.plain.compress(self._data(text))))
        lengths = [len(t) for _, t in templates]
        self.scale = [[i for i, n in enumerate(lengths) if low < n <= high] for low, high in zip((0, *SCALES), SCALES, strict=False)]
        self.reach = [int(2 * (1 + MOST_OTHER) * max((lengths[i] for i in own), default=0)) for own in self.scale]

    @staticmethod
    def _data(text: str) -> bytes:
        """Words alone, so that line ends and list marks do not part what belongs together."""
        return " ".join(words(text)).encode("utf-8", "surrogatepass")

    def savings(self, text: str, scale: int) -> dict[int, int]:
        """Bytes that each template of the scale saves of a window."""
        data = self._data(text)
        alone = len(self.plain.compress(data))
        return {i: alone - len(self.each[i][2].compress(data)) for i in self.scale[scale]}

    def ranked(self, text: str) -> dict[int, float]:
        """Templates that may be in the text, with bytes saved times the share of the template that these are; of several windows the best counts."""
        best: dict[int, float] = {}
        for m in TRIGGER.finditer(text):
            for k, reach in enumerate(self.reach):
                for i, x in self.savings(text[max(0, m.start() - reach) : m.end() + reach], k).items():
                    if x >= LEAST_SAVING * self.size[i]:
                        best[i] = max(best.get(i, 0.0), x * x / self.size[i])
        return best

    def compare(self, own: list[str], i: int) -> list[tuple[int, int, list[str]]]:
        """(first word, word after the last, words that differ) of each place where the wording confirms the template."""
        wanted = self.each[i][1]
        have = Counter(own)
        # what an alignment can find at most
        if any(w not in have for w in wanted if telling(w)) or (Counter(wanted) & have).total() < LEAST_SHARE * len(wanted):
            return []
        out: list[tuple[int, int, list[str]]] = []
        seen = np.zeros(len(own), bool)
        for _, end, start in sorted({x for cost in _MISSING for x in ends(own, wanted, cost)}):
            if seen[start:end].any():
                continue
            seen[start:end] = True
            missing, other, before, after = differences(own[start:end], wanted)
            # names right before or after the aligned words belong to the notice as well, and so does what stands for missing words
            edge = [w for w in [*own[max(0, start - 1) : start], *own[end : end + 1]] if w in NAMES - REFUSALS]
            edge += own[end + 1 : end + 2] if own[end : end + 1] in (["version"], ["v"]) else []
            edge += [*own[max(0, start - before - 1) : start]] * (before > 0) + own[end : end + after + 1] * (after > 0)
            refused = not REFUSALS.isdisjoint([*other, *own[max(0, start - BEFORE) : start]])
            if not refused and not any(telling(w) for w in [*missing, *other, *edge]):
                out.append((start, end, [*(f"-{w}" for w in missing), *(f"+{w}" for w in other)]))
        return out

    def identify(self, block: str) -> list[tuple[int, int, str, list[str]]]:
        """(start, end, license, words that differ) of each notice in a block: templates by their rank, less what the words that differ take from it, each where its wording confirms
        it and no earlier one stands; what stands between notices is searched again until nothing is confirmed."""
        placed = placed_words(block)
        out, todo = [], [(0, len(placed))]
        while todo:
            low, high = todo.pop()
            own = [w for w, _, _ in placed[low:high]]
            if not own:
                continue
            taken = np.zeros(high - low, bool)
            rank = self.ranked(block[placed[low][1] : placed[high - 1][2]])
            found = [(-rank[i] * max(0.0, 1 - len(diff) / len(self.each[i][1])) ** 4, i, s, e, diff) for i in sorted(rank) for s, e, diff in self.compare(own, i)]
            for _, i, s, e, diff in sorted(found):
                if not taken[s:e].any():
                    taken[s:e] = True
                    out.append((placed[low + s][1], placed[low + e - 1][2], self.each[i][0], diff))
            if taken.any():
                edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8))) + low
                todo += [(int(s), int(e)) for s, e in edges.reshape(-1, 2)]
        return sorted(out, key=lambda x: x[:2])


def ends(own: list[str], wanted: list[str], cost: int) -> list[tuple[int, int, int]]:
    """(words that differ, word after the last, first word) of the best alignment up to each word, if enough words are there.
    A column holds, for each number of template words, 1000 * cost + missing words, and below 32 bits where it starts."""
    n = len(wanted)
    gap = np.cumsum([0, *(_NEVER if telling(w) else 1000 * cost + 1 for w in wanted)], dtype=np.int64) << 32
    at: dict[str, np.ndarray] = {w: np.array([x == w for x in wanted]) for w in set(wanted)}
    column, out = gap.copy(), []
    never = np.int64(_NEVER << 32)
    for j, w in enumerate(own):
        new = column + ((_NEVER if telling(w) else 1000) << 32)
        if w in at:
            new[1:] = np.where(at[w], np.minimum(new[1:], column[:-1]), new[1:])
        new[0] = j + 1
        column = np.minimum(np.minimum.accumulate(new - gap) + gap, never)
        if w not in at or column[n] >= never:
            continue
        total, start = int(column[n]) >> 32, int(column[n]) & 0xFFFFFFFF
        missing = total % 1000
        other = total // 1000 - cost * missing
        if n - missing >= LEAST_SHARE * n and other <= MOST_OTHER * n:
            out.append((missing + other, j + 1, start))
    return out


def differences(own: list[str], wanted: list[str]) -> tuple[list[str], list[str], int, int]:
    """(missing words, other words, missing ones before the first found and after the last) of the alignment with the fewest."""
    n, m = len(own), len(wanted)
    left = [[0] * (m + 1) for _ in range(n + 1)]  # most words found from here on
    for a in range(n - 1, -1, -1):
        for b in range(m - 1, -1, -1):
            left[a][b] = left[a + 1][b + 1] + 1 if own[a] == wanted[b] else max(left[a + 1][b], left[a][b + 1])
    missing, other, found, a, b = [], [], [], 0, 0
    while a < n or b < m:
        if a < n and b < m and own[a] == wanted[b]:
            found.append(b)
            a, b = a + 1, b + 1
        elif b < m and (a == n or left[a][b + 1] >= left[a + 1][b]):
            missing.append(wanted[b])
            b += 1
        else:
            other.append(own[a])
            a += 1
    return missing, other, found[0], m - 1 - found[-1]


_MATCHER: list[Matcher] = []
SCHEMA = "doc_id long, n_blocks int, licenses string, spans string, differences string"


def expressions(text: str, matcher: Matcher) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, license, words that differ) of each identifier in SPDX expressions; "-only", "-or-later" and "+" are left off."""
    out = []
    for m in _EXPRESSION.finditer(text):
        for o in _OPERAND.finditer(m[1]):
            name = re.sub(r"(?i)(-only|-or-later|\+)$", "", o[2])
            if not o[1]:
                at = m.start(1) + o.start(2)
                out += [(at, at + len(o[2]), license, diff) for _, _, license, diff in matcher.identify(f"SPDX-License-Identifier: {name}")]
    return out


def scan_text(text: str | None, matcher: Matcher) -> tuple[int, str, str, str]:
    text = text or ""
    found = blocks(text)
    named = expressions(text, matcher) if found else []
    # an expression is read once, by its identifiers
    plain = _EXPRESSION.sub(lambda m: " " * len(m[0]), text) if named else text
    named += [(s + a, s + b, name, diff) for s, e in found for a, b, name, diff in matcher.identify(plain[s:e])]
    named.sort(key=lambda x: x[:2])
    return len(found), ",".join(sorted({n for _, _, n, _ in named})), ",".join(f"{n}:{a}:{b}" for a, b, n, _ in named), " ".join(d for *_, diff in named for d in diff)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _MATCHER:
        _MATCHER.append(Matcher())
    for batch in batches:
        out = list(zip(*(scan_text(t.as_py(), _MATCHER[0]) for t in batch.column("text")), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int32()), *(pa.array(c, pa.string()) for c in out[1:])], ["doc_id", "n_blocks", "licenses", "spans", "differences"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, licenses, spans, differences) of each document."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan, SCHEMA)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
