"""License scans by conditional compression.

Blocks: a confirmed notice holds most of a template's words, so at least one of its longest words; one pass with a
multi-pattern automaton finds these, and the text within reach of them, over line ends, is the candidate block. Each block is compressed alone
and with every template as a raw dictionary of zstandard; the bytes saved rank the templates. Every template is
compared by aligning its words with the block's, whatever its rank: a notice needs ``cover`` of the template's words in order, and what
is missing, changed or added is told word by word. The fewest differences win, then the most bytes saved; what lies
before and after a notice in its block is looked at again.

Rules: a null or empty text has no notice; repeated rows are scanned each; of equal templates the first by name wins;
columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from barloom.llm.common import documents, slices

# Public notices, as their owners word them.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-short": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-short": "Dedicated to the public domain under CC0 1.0.",
}
WORD = re.compile(r"\w+")
FOUND = "doc_id long, start long, stop long, license string, saved int, covered double, n_missing int, n_added int, differences array<string>"


class Scanner:
    def __init__(self, templates: dict[str, str], cover: float, level: int) -> None:
        self.cover = cover
        self.words = {name: WORD.findall(text.lower()) for name, text in sorted(templates.items())}
        if not self.words or not all(self.words.values()):
            raise ValueError("templates need words")
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.reach = max(map(len, templates.values())) * 2
        self.markers = ahocorasick.Automaton()
        for own in self.words.values():
            spare = int(len(own) * (1 - cover) + 1e-9)
            for word in sorted(own, key=lambda w: (-len(w), w))[: spare + 1]:
                self.markers.add_word(word, len(word))
        self.markers.make_automaton()
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = {name: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in sorted(templates.items())}

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """What lies within reach of a marker on both sides, whole words, over line ends; what overlaps is joined."""
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out: list[tuple[int, int]] = []
        for end, _ in self.markers.iter(low):
            a, b = max(0, end - self.reach), min(len(text), end + self.reach)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return [(self.edge(text, a, -1), self.edge(text, b, 1)) for a, b in out]

    @staticmethod
    def edge(text: str, at: int, step: int) -> int:
        """``at``, moved out of a word that it would cut."""
        while 0 < at < len(text) and WORD.match(text, at) and WORD.match(text, at - 1):
            at += step
        return at

    def ranked(self, block: str) -> list[tuple[int, str]]:
        """Bytes that each template saves, most first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(c.compress(data)), name) for name, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def windows(self, theirs: list[str], own: list[str]) -> list[tuple[int, int]]:
        """Ranges of the block's words that may hold a notice, fewest missing and added words first; the whole block last.

        A notice's words are aligned near each other, so that words of the text around it are not taken for its own.
        """
        codes = {w: i for i, w in enumerate(dict.fromkeys(own))}
        words, n = np.array([codes.get(w, -1) for w in theirs]), len(theirs)
        one, at = n + 1, np.arange(n + 1)
        best = n - at  # differences * one + words right of the start
        for w in own:
            here = best + one
            here[1:] = np.where(words == codes[w], np.minimum(here[1:], best[:-1]), here[1:])
            best = np.minimum.accumulate(here - at * one) + at * one
        ends = np.flatnonzero(best // one <= 2 * (1 - self.cover) * len(own) + 1 + 1e-9)
        ends = ends[np.argsort(best[ends], kind="stable")]
        return [*((n - int(best[e]) % one, int(e)) for e in ends), (0, n)]

    def confirm(self, at: list[re.Match], theirs: list[str], have: Counter, name: str):
        """(differences, start, stop, share of words covered, missing, added) where a block's words hold the template closely enough."""
        own = self.words[name]
        if sum(min(n, have[w]) for w, n in self.counts[name].items()) < self.cover * len(own) - 1e-9:
            return None
        return next((x for low, high in self.windows(theirs, own) if (x := self.aligned(at, theirs, own, low, high))), None)

    def aligned(self, at: list[re.Match], theirs: list[str], own: list[str], low: int, high: int):
        """``confirm`` for the words from low to high; reworded ends count with the words that stand beside them."""
        matcher = SequenceMatcher(None, own, theirs[low:high], autojunk=False)
        parts = [p for p in matcher.get_matching_blocks() if p.size]
        if not parts or sum(p.size for p in parts) < self.cover * len(own) - 1e-9:
            return None
        begun, ended = low + parts[0].b, low + parts[-1].b + parts[-1].size
        first, last = max(0, begun - parts[0].a), min(len(theirs), ended + len(own) - parts[-1].a - parts[-1].size)
        told, missing, added = [], 0, 0
        for op, a, b, c, d in [("", 0, parts[0].a, first - low, begun - low), *matcher.get_opcodes(), ("", parts[-1].a + parts[-1].size, len(own), ended - low, last - low)]:
            if op == "equal" or op and (low + d <= begun or low + c >= ended) or a == b and c >= d:
                continue
            missing, added = missing + b - a, added + d - c
            told.append(f"-{' '.join(own[a:b])} +{' '.join(theirs[low + c : low + d])}".replace("- ", "").strip())
        if added > (1 - self.cover) * len(own) + 1:
            return None
        return told, at[first].start(), at[last - 1].end(), 1 - missing / len(own), missing, added

    def notices(self, text: str, start: int, stop: int) -> list[tuple]:
        """Notices between two places: the one with the fewest differences first, then those in what is left on both sides."""
        out, todo = [], [(start, stop)]
        while todo:
            start, stop = todo.pop()
            block = text[start:stop]
            at = list(WORD.finditer(block))
            theirs = [m.group().lower() for m in at]
            have = Counter(theirs)
            found = [(c, name) for name in self.words if (c := self.confirm(at, theirs, have, name))]
            if not found:
                continue
            saved = dict((name, n) for n, name in self.ranked(block))
            (told, a, b, covered, missing, added), name = min(found, key=lambda x: (x[0][4] + x[0][5], -saved[x[1]], x[1]))
            out.append((start + a, start + b, name, saved[name], covered, missing, added, told))
            todo += [(x, y) for x, y in ((start, start + a), (start + b, stop)) if y - x > 8]
        return out

    def scan(self, text: str) -> list[tuple]:
        """Blocks are read in overlapping stretches of twice the reach, so the time is in proportion to the text.

        No notice is longer than the reach, so one that starts in the first half of a stretch lies in it as a whole; what
        starts later is left to the next stretch.
        """
        out = []
        for start, stop in self.blocks(text):
            while start < stop:
                end = self.edge(text, min(stop, start + 2 * self.reach), 1)
                half = stop if end >= stop else self.edge(text, start + self.reach, -1)
                half = half if half > start else end  # one word longer than the reach
                kept = [x for x in self.notices(text, start, end) if x[0] < half]
                out += kept
                start = max([half, *(x[1] for x in kept)])
        return sorted(out)


@functools.lru_cache(maxsize=2)
def _scanner(templates: tuple, cover: float, level: int) -> Scanner:
    return Scanner(dict(templates), cover, level)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, cover: float = 0.8, level: int = 3) -> DataFrame:
    """A row per notice found: its place, its template, the bytes the template saves, and the exact differences."""
    given = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches):
        scanner = _scanner(given, cover, level)
        for batch in slices(batches):
            rows = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for x in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "stop", "license", "saved", "covered", "n_missing", "n_added", "differences"])

    return documents(docs).mapInArrow(run, FOUND)
