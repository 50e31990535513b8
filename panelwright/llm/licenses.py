"""License scans: normalised passages against templates by the Dice coefficient over word bigrams.

Every line of a text and the whole text are passages. Two sets of a and b bigrams reach a coefficient of t only if b lies
between a * t / (2 - t) and a * (2 - t) / t, so sorted template sizes leave a passage with few candidates, and an index of the
templates' bigrams counts the common ones of all candidates at once.

``scan_notices`` looks at every window of words instead, across lines and within them: of the windows that reach the least
coefficient the best are kept, and what overlaps them is merged into them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: Wording of public licences and notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-note": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0-note": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-note": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: A word is a run of anything but ASCII blanks, punctuation and control characters.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD_CLASS)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HITS = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())])
_NOTICES = pa.schema([("doc_id", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("license", pa.string()), ("dice", pa.float64())])


def bigrams(words: list[str]) -> set:
    return set(zip(words, words[1:]))


class Templates:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        own = sorted((len(b), name, b) for name, text in templates.items() if (b := bigrams(_WORDS.findall(text.translate(_LOWER)))))
        self.sizes, self.names = [n for n, _, _ in own], [name for _, name, _ in own]
        self.holders = defaultdict(list)
        for i, (_, _, b) in enumerate(own):
            for pair in b:
                self.holders[pair].append(i)
        self.firsts = {pair[0] for pair in self.holders}

    def best(self, words: list[str]):
        """(license, dice) of the closest template, or None; ties go to the first name."""
        most = len(words) - 1
        if most < 1 or most * (2 - self.least) / self.least < self.sizes[0]:
            return None
        # Common bigrams begin with a word of a template: most passages end here.
        own = {(a, b) for a, b in zip(words, words[1:]) if a in self.firsts and (a, b) in self.holders}
        if not own:
            return None
        size = len(bigrams(words))
        low = bisect_left(self.sizes, size * self.least / (2 - self.least) - 1e-9)
        high = bisect_right(self.sizes, size * (2 - self.least) / self.least + 1e-9)
        common = Counter(i for pair in own for i in self.holders[pair] if low <= i < high)
        scored = [(-2 * n / (size + self.sizes[i]), self.names[i]) for i, n in common.items() if 2 * n >= self.least * (size + self.sizes[i])]
        return (min(scored)[1], -min(scored)[0]) if scored else None

    def windows(self, words: list[str]) -> list:
        """(dice, license, first word, behind the last word) of the best windows, in order; none overlap.

        A window of a template of a bigrams has up to a * (2 - t) / t of them, repeated ones counted. Of the overlapping windows of a
        template the closest stays, then the shorter, the earlier; of those of several templates the one with the most common bigrams (a note is
        part of a header), then the closest, the first name. A window that begins or ends with a bigram the template lacks is never closer than
        without it, so windows run from one of the template's bigrams to another.
        """
        places = defaultdict(list)
        for at, pair in enumerate(zip(words, words[1:])):
            if pair[0] in self.firsts and pair in self.holders:
                for i in self.holders[pair]:
                    places[i].append(at)
        best = []
        for i, at in places.items():
            found, a = [], self.sizes[i]
            longest, fewest = int(a * (2 - self.least) / self.least + 1e-9), a * self.least / (2 - self.least) - 1e-9
            for k, first in enumerate(at):
                behind = bisect_left(at, first + longest, k)
                if behind - k < fewest:
                    continue
                seen, common, known = set(), set(), first
                for last in at[k:behind]:
                    seen.update(zip(words[known:last + 1], words[known + 1:last + 2]))
                    known = last + 1
                    common.add((words[last], words[last + 1]))
                    if 2 * len(common) >= self.least * (a + len(seen)):
                        found.append((-2 * len(common) / (a + len(seen)), last + 2 - first, first, len(common)))
            best += [(-common, dice, self.names[i], first, n) for dice, n, first, common in apart(sorted(found), lambda w: (w[2], w[2] + w[1]))]
        kept = apart(sorted(best), lambda w: (w[3], w[3] + w[4]))
        return sorted(((-dice, name, first, first + n) for _, dice, name, first, n in kept), key=lambda w: w[2])


def apart(rows: list, span) -> list:
    """The rows whose span (first, behind) overlaps that of no row kept before."""
    taken, out = [], []
    for row in rows:
        first, behind = span(row)
        k = bisect_left(taken, (first, first))
        if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= behind):
            insort(taken, (first, behind))
            out.append(row)
    return out


def _scan_windows(batches, templates: dict[str, str], least: float):
    known = Templates(templates, least)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text.translate(_LOWER)
            hits = known.windows(_WORDS.findall(text))
            if hits:
                ends, total = [], 0
                for line in text.split("\n"):
                    total += len(_WORDS.findall(line))
                    ends.append(total)
                rows += [(doc_id, bisect_right(ends, a) + 1, bisect_right(ends, z - 1) + 1, a, z - a, name, dice) for dice, name, a, z in hits]
        columns = list(zip(*rows)) if rows else [()] * len(_NOTICES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NOTICES)], schema=_NOTICES)


def _scan(batches, templates: dict[str, str], least: float):
    known = Templates(templates, least)
    # Bigrams of a whole text that is longer than this are too many for any template.
    longest = known.sizes[-1] * (2 - least) / least if known.sizes else 0
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole: list[str] = []
            lines = text.translate(_LOWER).split("\n") if known.sizes else []
            for number, line in enumerate(lines, 1):
                words = _WORDS.findall(line)
                whole += words if len(lines) > 1 else []
                if hit := known.best(words):
                    rows.append((doc_id, number, *hit))
            if len(lines) > 1 and (len(whole) <= longest + 1 or len(bigrams(whole)) <= longest) and (hit := known.best(whole)):
                rows.append((doc_id, 0, *hit))
        columns = list(zip(*rows)) if rows else [()] * len(_HITS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS)], schema=_HITS)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 1; 0 is the whole of a text of several lines), license, dice: the closest template of every passage that reaches ``least``.

    * A null, empty or blank text and passages of one word have no bigrams and no hit. A null doc_id is returned as it is.
    * Rows that repeat are scanned one by one; ties between templates go to the first name.
    * An empty table, or no template, gives an empty result. Other columns are ignored.
    """
    known = TEMPLATES if templates is None else templates
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: _scan(b, known, least), "doc_id long, line int, license string, dice double")


def scan_notices(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_line, last_line (from 1), first_word (from 0), n_words, license, dice: every notice, wherever it stands in a text.

    * A notice may go over several lines or share its lines with other text. Notices of a document do not overlap.
    * Null, empty and blank texts have no notice. A null doc_id is returned as it is; rows that repeat are scanned one by one.
    * An empty table, or no template, gives an empty result. Other columns are ignored.
    """
    known = TEMPLATES if templates is None else templates
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: _scan_windows(b, known, least),
                                                          "doc_id long, first_line int, last_line int, first_word long, n_words int, license string, dice double")
