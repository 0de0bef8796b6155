"""License notices, by conditional compression against templates.

A notice may have a share of ``MOST_DIFFERENT`` of its template's words missing
or added. A template is cut into one piece more than that makes words, so that
one piece at least stands unchanged in every such notice: the places of pieces
are all the places to look at, whatever lines, line lengths and marks between
words. Places of a template that belong to one notice make one block, as long as
the template and what may be added.

Each block is compressed on its own and with each template as a raw zstandard
dictionary; the more a template explains of the block, the smaller the second.
The templates are ranked by this reduction, and from the best one down their
wording is confirmed: a template's words are aligned with the block's, few may
be missing or added and none of those that tell licenses apart (versions,
names, "no"). The first that is confirmed is the block's license; of templates
that reduce it by as much (within ``TIE``) that with the fewest differences. So
texts that share sentences are told apart by what they do not share, and a
notice within the words of a larger one is not reported. Where a text has no
more than a sentence that licenses share, their names are given with ``OR``.

Short notices, ``SPDX-License-Identifier`` lines and headings are templates too;
a heading counts where it has its lines for itself.

Returns a row per document and license found: doc_id, license, first_line,
last_line (of the notice's first and last word), reduction, missing and added
words, exact. Rules: null and empty texts have none; a null doc_id stays null;
repeated rows each give their rows; of several notices of a license that with
the fewest words missing or added counts, then the first, then the longest.
Whole texts of any length are read; other columns are not. An
empty table gives an empty result. Blocks are
compressed as lower-case words, cut to ``WORD_CHARS`` characters, so that a
reduction does not depend on what stands around or between them.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_rows, slices

# Parts of license texts.
_MIT_OPENS = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT_RIGHTS = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_ENDS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ENDS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_OPENS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_ENDS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _listed(opens: str, clauses: tuple[str, ...], ends: str) -> tuple[str, str]:
    """A text with its clauses numbered, and with other marks before them."""
    return tuple(f"{opens}: {' '.join(mark(k) + c for k, c in enumerate(clauses, 1))} {ends}" for mark in (lambda k: f"{k}. ", lambda k: "* "))


#: Notices in their own words, by SPDX name.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        _MIT_OPENS,
        f"{_MIT_OPENS}{_MIT_RIGHTS}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_ENDS}",
    ),
    "MIT-0": (f"{_MIT_OPENS}{_MIT_RIGHTS}. {_MIT_ENDS}",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", *_listed(_BSD_OPENS, _BSD_CLAUSES, _BSD_ENDS)),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", *_listed(_BSD_OPENS, (*_BSD_CLAUSES, _BSD_THIRD), _BSD_ENDS)),
    "BSD-2-Clause OR BSD-3-Clause": (_BSD_OPENS,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": (f"{_ISC_OPENS}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_ENDS}",),
    "0BSD": (f"{_ISC_OPENS}. {_ISC_ENDS}",),
    "0BSD OR ISC": (_ISC_OPENS,),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
}
#: Headings, which count only where nothing else is on their lines.
HEADINGS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0",), "MIT": ("MIT License", "The MIT License"), "GPL-3.0": ("GNU General Public License Version 3",), "GPL-2.0": ("GNU General Public License Version 2",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3",), "AGPL-3.0": ("GNU Affero General Public License Version 3",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",),
}


def identifiers(names: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """The lines by which a file names its license."""
    return {name: (f"SPDX-License-Identifier: {name}",) for name in names if " OR " not in name}


#: Words that must not differ.
TELLING = frozenset("2 3 4 0 1 v apache mit gnu lesser affero general bsd clause mozilla cc cc0 by nc sa nd sharealike noncommercial attribution no not without commercial".split())
LEAST_REDUCTION, TIE, MOST_DIFFERENT, WORD_CHARS = 0.2, 0.05, 0.15, 16

_WORD = re.compile(r"[A-Za-z]+[0-9]*|[0-9]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def most_edits(template: list[str]) -> int:
    """Words that may be missing or added."""
    return int(MOST_DIFFERENT * len(template) + 1e-9)


def wording(template: list[str], block: list[str]) -> tuple[int, int, int, int] | None:
    """(missing, added, first, last word) of the template in the block; None if a telling word differs."""
    match = difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks()
    # The longest common run anchors the notice; what lies far outside is other text.
    anchor = max(match, key=lambda m: m.size)
    if not anchor.size:
        return None
    around = max(3, most_edits(template))
    lo, hi = max(0, anchor.a - anchor.b - around), min(len(block), anchor.a - anchor.b + len(template) + around)
    ops = difflib.SequenceMatcher(None, block[lo:hi], template, autojunk=False).get_opcodes()
    equal, best = [k for k, o in enumerate(ops) if o[0] == "equal"], None
    # The notice may begin and end at any of its common runs; template words outside are missing, block words outside are other text.
    for i in equal:
        for j in equal[equal.index(i) :]:
            between = [o for o in ops[i:j] if o[0] != "equal"]
            outside = template[: ops[i][3]] + template[ops[j][4] :]
            differ = [*outside, *(w for _, a, b, c, d in between for w in (*block[lo + a : lo + b], *template[c:d]))]
            if TELLING.isdisjoint(differ):
                missing, added = len(outside) + sum(d - c for *_, c, d in between), sum(b - a for _, a, b, _, _ in between)
                found = (missing + added, missing, added, lo + ops[i][1], lo + ops[j][2])
                best = found if best is None else min(best, found)
    return best and best[1:]


class Scanner:
    """The templates, ready for compression and comparison."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, headings: dict[str, tuple[str, ...]] = HEADINGS):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        #: Name, words, compressor and whether it is a heading, of each template.
        self.each: list[tuple] = []
        #: By the longest word of each piece: (template, place in the template, the word's place in the piece, words).
        self.pieces: dict[str, list[tuple[int, int, int, list[str]]]] = {}
        marked = [(name, text, False) for held in (templates, identifiers(templates)) for name in sorted(held) for text in held[name]]
        for name, text, heading in marked + [(name, text, True) for name in sorted(headings) for text in headings[name] if name in templates]:
            words = words_of(text)
            held = zstandard.ZstdCompressionDict(self.normal(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parts = most_edits(words) + 1
            for k in range(parts if words else 0):
                at, end = k * len(words) // parts, (k + 1) * len(words) // parts
                cue = max(range(end - at), key=lambda i: len(words[at + i]))
                self.pieces.setdefault(words[at + cue], []).append((len(self.each), at, cue, words[at:end]))
            self.each.append((name, words, zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False), heading))

    @staticmethod
    def normal(words: list[str]) -> bytes:
        return " ".join(w[:WORD_CHARS] for w in words).encode()

    def reductions(self, block: bytes) -> list[float]:
        """By how much each template makes the block smaller."""
        alone = len(self.plain.compress(block))
        return [1 - len(with_template.compress(block)) / alone for _, _, with_template, _ in self.each]

    def blocks(self, words: list[str]) -> list[tuple[int, int]]:
        """(from, to) of the words to look at: around the places where pieces of a template put its first word."""
        pieces = self.pieces
        found = set()
        for i in [i for i, w in enumerate(words) if w in pieces]:
            for template, at, cue, piece in pieces[words[i]]:
                if i >= cue and words[i - cue : i - cue + len(piece)] == piece:
                    found.add((template, i - cue - at))
        out, last = set(), None
        # Pieces of one notice are moved against each other by no more words than may be missing or added.
        for template, at in sorted(found):
            if last and last[0] == template and at - last[2] <= most_edits(self.each[template][1]):
                last[2] = at
                continue
            out |= {self.window(*last, len(words))} if last else set()
            last = [template, at, at]
        return sorted(out | ({self.window(*last, len(words))} if last else set()))

    def window(self, template: int, first: int, last: int, n: int) -> tuple[int, int]:
        wanted = self.each[template][1]
        return max(0, first - most_edits(wanted)), min(n, last + len(wanted) + most_edits(wanted))

    def judge(self, words: list[str], lo: int, hi: int, lines: list[int]) -> tuple | None:
        """(words confirmed, edits, first, last word, name, reduction, missing, added) of a block's license: templates by rank, until one is confirmed."""
        held, best = words[lo:hi], None
        reductions = self.reductions(self.normal(held)) if held else []
        for k in sorted(range(len(reductions)), key=lambda k: (-reductions[k], -len(self.each[k][1]), self.each[k][0])):
            if reductions[k] < (LEAST_REDUCTION if best is None else best[5] - TIE):
                break
            name, wanted, _, heading = self.each[k]
            if len(wanted) > len(held) + most_edits(wanted):  # too many would be missing
                continue
            same = wording(wanted, held)
            if not same or same[0] + same[1] > most_edits(wanted):
                continue
            a, b = lo + same[2], lo + same[3]
            if heading and (a and lines[a - 1] == lines[a] or b < len(words) and lines[b] == lines[b - 1]):
                continue
            row = (len(wanted) - same[0], same[0] + same[1], a, b - 1, name, reductions[k], same[0], same[1])
            if best is None or (row[1], -row[0]) < (best[1], -best[0]):
                best = (*row[:5], max(row[5], best[5]) if best else row[5], *row[6:])
        return best

    @staticmethod
    def settle(rows: Iterable[tuple]) -> list[tuple]:
        """Of what was confirmed, each license once; without what stands within the words of a larger notice."""
        found: dict[str, tuple] = {}
        kept: list[tuple] = []
        for row in sorted(set(rows), key=lambda r: (-r[0], r[1], r[2:5])):
            if not any(k[2] <= row[2] and row[3] <= k[3] and k[0] > row[0] for k in kept):
                kept.append(row)
        for row in sorted(kept, key=lambda r: (r[1], r[2], -r[0])):
            found.setdefault(row[4], row)
        return sorted(found.values(), key=lambda r: (r[2], r[4]))

    def scan(self, text: str | None) -> list[tuple]:
        """(license, first_line, last_line, reduction, missing, added, exact), each license once, in order of lines."""
        words = words_of(text) if isinstance(text, str) else []
        blocks = self.blocks(words)
        if not blocks:
            return []
        lines, line, at = [], 0, 0
        for m in _WORD.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            lines.append(line)
        rows = self.settle(row for lo, hi in blocks if (row := self.judge(words, lo, hi, lines)))
        return sorted(((r[4], lines[r[2]], lines[r[3]], round(r[5], 4), r[6], r[7], not r[1]) for r in rows), key=lambda r: (r[1], r[0]))


def _scan(batches: Iterator[pd.DataFrame], templates: dict[str, tuple[str, ...]]) -> Iterator[pd.DataFrame]:
    scanner = Scanner(templates)
    for pdf in slices(batches):
        rows = [(doc_id, *row) for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True) for row in scanner.scan(text)]
        yield pd.DataFrame(rows, columns=["doc_id", "license", "first_line", "last_line", "reduction", "missing", "added", "exact"])


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """A row per document and license found."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, license string, first_line long, last_line long, reduction double, missing long, added long, exact boolean"
    return map_rows(rows, partial(_scan, templates=templates), schema, "doc_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
