"""License scans by patience alignment: anchors on words unique to both sides, their longest increasing subsequence,
and the same again in the gaps between; the share of a template's words that are aligned is its coverage.

Licenses differ from each other in few words: their names, versions and conditions (TELLING). All of a template's must be
aligned, and no other may stand in the stretch of text that a short template spans, however well the rest is covered.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text

#: The notices and short texts that are looked for (public license texts: fixed values).
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Further short notices, by the rule (name, text); versions and conditions are filled in.
_NAMED = {
    "MIT": ("MIT License", "MIT"), "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"), "Apache-2.0": ("Apache License 2.0", "Apache 2.0"), "BSD": ("BSD License",), "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL v2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL v3"), "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPL v2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL v3"), "MPL-1.1": ("Mozilla Public License, version 1.1", "MPL 1.1"), "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"), "EPL-1.0": ("Eclipse Public License, version 1.0",), "EPL-2.0": ("Eclipse Public License, version 2.0",), "ISC": ("ISC License",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License, Version 1.0",), "CC0-1.0": ("CC0 1.0",),
}
_CONDITIONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def short_notices() -> dict[str, str]:
    """Templates by rule: of each name above "Licensed under the ...", and of each Creative Commons license and version its short
    and its long name."""
    out = {f"{name}-short-{k}": f"Licensed under the {text}." for name, texts in _NAMED.items() for k, text in enumerate(texts)}
    for kinds in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-{'-'.join(kinds)}-{version}"
            out[f"{name}-short"] = f"Licensed under CC {'-'.join(kinds)} {version}."
            out[f"{name}-long"] = f"Licensed under a Creative Commons {'-'.join(_CONDITIONS[k] for k in kinds)} {version} License."
    return out


#: Words that tell licenses apart, beside numbers: fixed values of their names.
TELLING = frozenset("mit apache gpl lgpl agpl gnu lesser library affero general bsd clause simplified new isc mozilla mpl eclipse zlib boost cc cc0 by nc sa nd creative commons attribution sharealike noncommercial noderivatives".split())
#: Templates of fewer words may have no telling word but their own in the stretch that they span.
SHORT = 60
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)", re.I)
FOUND = "license string, coverage double, aligned long, first_word long, last_word long"
RESULT = f"doc_id long, n_words long, {FOUND}, licenses array<struct<{', '.join(x.replace(' ', ':') for x in FOUND.split(', '))}>>"
#: Words of the longest n-grams that are tried where no single word is unique to both sides.
GRAMS = 5
#: Least share of aligned words in the stretch of text from the first to the last: words of a template that lie scattered
#: over a text are no notice.
DENSITY = 0.6
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def telling(word: str) -> str:
    """What a word says of a license: a name, or a number without v and .0; '' for any other word."""
    if word in TELLING:
        return word
    number = word.removeprefix("v")
    return number.removesuffix(".0") if number[:1].isdigit() and (len(number) < 4 or "." in number) else ""


def tells(text: list[str], template: list[str], part: list[tuple[int, int]]) -> bool:
    """Whether an alignment holds all telling words of the template and, where that is short, no other in its stretch of text."""
    own = {j for j, w in enumerate(template) if telling(w)}
    if not own <= {j for _, j in part}:
        return False
    there = {i for i, _ in part}
    return len(template) >= SHORT or not any(telling(text[i]) for i in range(part[0][0], part[-1][0] + 1) if i not in there)


def _anchors(text: list[str], a: int, b: int, template: list[str], c: int, d: int, n: int = 1) -> list[tuple[int, int]]:
    """Places (in text, in template) of words (n-grams) that stand once in text[a:b] and once in template[c:d], thinned to
    the longest sequence that increases in both."""
    if n > 1:
        text, template = ([tuple(x[k : k + n]) for k in range(z)] for x, z in ((text, b), (template, d)))
        b, d = b - n + 1, d - n + 1
    wanted: dict = {}
    for j in range(c, d):
        wanted[template[j]] = -1 if template[j] in wanted else j
    places: dict = {}
    for i in range(a, b):
        if wanted.get(text[i], -1) >= 0:
            places[text[i]] = -1 if text[i] in places else i
    pairs = sorted((i, wanted[w]) for w, i in places.items() if i >= 0)
    tops: list[int] = []  # patience: the least end of an increasing sequence of each length
    heads: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = heads[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            heads.append(k)
        else:
            tops[pile], heads[pile] = j, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str], grams: int = 1) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both; equal words at a gap's ends are aligned as well. A gap
    without a unique word is anchored on unique n-grams of up to `grams` words."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template), False)]
    while gaps:
        a, b, c, d, bound = gaps.pop()
        if bound:  # beside an anchor: equal words run on
            while a < b and c < d and text[a] == template[c]:
                found.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                b, d = b - 1, d - 1
                found.append((b, d))
        if a == b or c == d:
            continue
        marks = next((m for n in range(1, grams + 1) if (m := _anchors(text, a, b, template, c, d, n))), [])
        found += marks
        if marks:
            for (i, j), (m, n) in zip([(a - 1, c - 1), *marks], [*marks, (b, d)], strict=True):
                gaps.append((i + 1, m, j + 1, n, True))
    return sorted(found)


def dense(part: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The alignment without words at its ends that lie too far off: while fewer than DENSITY of the words from the first to
    the last are aligned, the end with the wider gap goes."""
    a, b = 0, len(part)
    while b - a > 1 and b - a < DENSITY * (part[b - 1][0] - part[a][0] + 1):
        if part[a + 1][0] - part[a][0] > part[b - 1][0] - part[b - 2][0]:
            a += 1
        else:
            b -= 1
    return part[a:b]


def occurrences(text: list[str], template: list[str], least: float) -> list[list[tuple[int, int]]]:
    """Alignments of each place of the text that covers `least` of the template, in order.

    Where enough template words lie on close diagonals, that stretch of text is aligned by itself, so that a notice is
    found however often it or its words recur elsewhere; what lies between such places is then aligned whole.
    """
    n, need = len(template), least * len(template)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        at.setdefault(w, []).append(j)
    hits = sorted((i - j, i, j) for i, w in enumerate(text) for j in at.get(w, ()))
    width, end, k, found = max(2, n // 4), 0, 0, []
    seen: dict[int, int] = {}
    for first in range(len(hits)):
        low = hits[first][0]
        while k < len(hits) and hits[k][0] <= low + width:
            seen[hits[k][2]] = seen.get(hits[k][2], 0) + 1
            k += 1
        if len(seen) >= need and low + width + n > end:
            start = max(low, end)
            part = [(i + start, j) for i, j in dense(align(text[start : low + width + n], template, GRAMS))]
            if len(part) >= need and tells(text, template, part):
                found.append(part)
                end = found[-1][-1][0] + 1
        j = hits[first][2]
        seen[j] -= 1
        if not seen[j]:
            del seen[j]
    cuts = [(0, 0), *((x[0][0], x[-1][0] + 1) for x in found), (len(text), 0)]
    for (_, a), (b, _) in zip(cuts, cuts[1:]):
        part = [(i + a, j) for i, j in dense(align(text[a:b], template, GRAMS))] if b - a >= need else []
        if len(part) >= need and tells(text, template, part):
            found.append(part)
    return sorted(found)


def same_numbers(words: list[str]) -> list[str]:
    """Words with the numbers of versions in one form: v2 and 2.0 are 2."""
    return [telling(w) or w if w[0] in "v0123456789" else w for w in words]


def identifiers(text: str) -> list[tuple[str, float, int, int, int]]:
    """(license, 1.0, words, first word, last word) of each license named in an SPDX-License-Identifier line."""
    out: list[tuple[str, float, int, int, int]] = []
    lowered = text.lower()
    lines = list(_SPDX.finditer(text if len(text) == len(lowered) else lowered))
    if lines:
        starts = [m.start() for m in _WORD.finditer(lowered)]
    for line in lines:
        for m in re.finditer(r"[A-Za-z0-9.+-]+", line[1]):
            if m[0].upper() not in ("AND", "OR", "WITH") and (words := len(words_of(m[0]))):
                first = bisect_left(starts, line.start(1) + m.start())
                out.append((m[0], 1.0, words, first, first + words - 1))
    return out


def find_licenses(text: str, templates: dict[str, list[str]], least: float) -> tuple:
    """(n_words, license, coverage, aligned, first_word, last_word, licenses): every place that covers a template to
    `least` and is told to be it, and every license of an SPDX line, by place; before them the one with the most coverage, then
    the most words, then the later name, then the earlier place; nulls without any."""
    return _found(text, {k: same_numbers(v) for k, v in templates.items()}, least)


def _found(text: str, templates: dict[str, list[str]], least: float) -> tuple:
    words = same_numbers(words_of(text))
    there = set(words)
    found = identifiers(text) if "spdx" in there else []
    for name, template in templates.items():
        if sum(w in there for w in template) < least * len(template):  # no alignment could reach it
            continue
        found += [(name, len(x) / len(template), len(x), x[0][0], x[-1][0]) for x in occurrences(words, template, least)]
    names = [x.split()[0] for x in FOUND.split(", ")]
    best = max(found, key=lambda x: (x[1], x[2], x[0], -x[3]), default=(None,) * 5)
    return len(words), *best, [dict(zip(names, x, strict=True)) for x in sorted(found, key=lambda x: (x[3], x[4], x[0]))]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): n_words, and license, coverage, aligned words and their first and
    last place in the text for the template covered best, nulls where none is covered to `least`; licenses has the same of
    every place of every template that is, so repeated notices and further licenses too.

    Without `templates`, those of TEMPLATES and `short_notices`. Aligned words must be at least DENSITY of the stretch that they
    span. Words are runs of a-z and 0-9 after lower-casing. Null and empty texts have no license; repeated rows and null ids
    are kept; other columns are ignored; an empty table gives an empty result. Whole texts are aligned.
    """
    wanted = {k: same_numbers(words_of(v)) for k, v in (templates or {**TEMPLATES, **short_notices()}).items()}

    def each(batches):
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("aligned", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])))
        for b in slices(batches):
            columns = list(zip(*[_found(x.as_py(), wanted, least) for x in b.column(1)], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", *(x.split()[0] for x in FOUND.split(", ")), "licenses"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(each, RESULT)
