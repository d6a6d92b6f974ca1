"""License scans by conditional compression.

A statement counts as found where at least 0.8 of its words stand in order, with at most as many other words between them
as it has. It then holds one at least of any of its words that are one more than it may lack: its longest ones are its cues. The
words around each cue in a text, as many on both sides as a statement with its added words can take, become a candidate
block, whatever their lines, so no statement is outside all blocks; blocks that touch are one, long ones are divided with that overlap. In a block, every
statement of every template that has enough of its words there is looked for by its words in order. Each match is compressed alone and with the license's
template as a raw zstandard dictionary; the share by which that makes it smaller must be positive and is the order of equals.
Of matches that overlap, the one with the most words matched less words missing and added wins.

Defined cases: null and empty texts have no blocks; equal matches rank by reduction, then license id; every
statement found gives a finding with its own span; repeated rows each get a row; a long
text is searched whole, block by block; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame

from quillfern.llm.common import id_and_text, text_slices

#: License ids and the public wording of their notices and opening statements.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("Released under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
}
FOUND = "doc_id long, n_blocks long, findings array<struct<license:string,start:int,stop:int,reduction:double,missing:int,added:int>>"
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def word_blocks(words: list[str], cues: frozenset[str], reach: int, most: int = 4000) -> list[tuple[int, int]]:
    """Ranges of words, in order, that are candidate blocks; those of over `most` words are divided with an overlap of `reach`."""
    out: list[list[int]] = []
    for at, w in enumerate(words):
        if w in cues:
            a, b = max(0, at - reach), min(len(words), at + reach + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    step = max(1, most - reach)
    return [(k, min(b, k + most)) for a, b in out for k in range(a, max(a + 1, b - reach), step)]


class Scanner:
    """Templates as raw dictionaries and coded statements."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, level: int = 3, share: float = 0.8):
        import zstandard as z

        raw = lambda d=None: z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.alone = raw()
        self.with_template = {k: raw(z.ZstdCompressionDict("\n".join(v).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for k, v in sorted(templates.items())}
        said = [(k, w) for k, v in sorted(templates.items()) for s in v if (w := words_of(s))]
        self.code = {w: i for i, w in enumerate(sorted({w for _, s in said for w in s}))}
        self.statements = [(k, np.array([self.code[w] for w in s])) for k, s in said]
        self.need = np.array([np.bincount(s, minlength=len(self.code)) for _, s in self.statements])
        self.may_miss = [int(len(s) * (1 - share) + 1e-9) for _, s in self.statements]
        self.reach = 2 * max(len(s) for _, s in self.statements)
        # The longest words of each statement, one more than it may lack.
        self.cues = frozenset(w for (_, s), k in zip(said, self.may_miss, strict=True) for w in sorted(s, key=lambda w: (-len(w), w))[: k + 1])
        self.memo: dict[tuple[str, str], float] = {}

    def reduction(self, k: str, span: str) -> float:
        if (k, span) not in self.memo:
            if len(self.memo) >= 100_000:
                self.memo.clear()
            data = span.encode()
            self.memo[k, span] = 1 - len(self.with_template[k].compress(data)) / len(self.alone.compress(data))
        return self.memo[k, span]

    def matches(self, block: np.ndarray, statement: np.ndarray, may_miss: int) -> list[tuple[int, int, int, int]]:
        """(start, stop, missing, added) of the best match that ends at each word of the block, where there is one."""
        m, n, unit = len(block), len(statement), 1 << 32
        none = np.int64(1) << 60
        # least[j, k]: added words times unit, less the start, of the best stretch that ends before word j with k words missing.
        least = np.full((m + 1, may_miss + 1), none)
        least[:, 0] = -np.arange(m + 1)
        ramp = (np.arange(m + 1) * unit)[:, None]
        for i, w in enumerate(statement):
            after = np.full_like(least, none)
            after[:, 1:] = least[:, :-1]  # the word is missing
            hit = np.flatnonzero(block == w)
            after[hit + 1] = np.minimum(after[hit + 1], least[hit])
            least = after if i == n - 1 else np.minimum(np.minimum.accumulate(after - ramp, axis=0) + ramp, none)
        added = -(-least // unit)
        out = []
        for j in np.flatnonzero((added <= n).any(1)).tolist():
            good = [(n - k - k - int(added[j, k]), -k, k) for k in range(may_miss + 1) if added[j, k] <= n]
            k = max(good)[2]
            a = int(added[j, k])
            out.append((int(a * unit - least[j, k]), j, k, a))
        return out

    def look(self, text: str) -> tuple[int, list[dict]]:
        """The number of blocks and the findings, in order of their start."""
        n, found = self.found(text)
        return n, self.chosen(found, text) if found else []

    def found(self, text: str) -> tuple[int, list[tuple]]:
        """The number of blocks and all matches: (net words, license, first word, stop, span in characters, missing, added)."""
        low = text.lower()
        if not any(c in low for c in self.cues):
            return 0, []
        words = list(_WORD.finditer(text))
        named = [w.group().lower() for w in words]
        spans = word_blocks(named, self.cues, self.reach)
        if not spans:
            return 0, []
        codes = np.array([self.code.get(w, -1) for w in named], np.int64)
        out = []
        for a, b in spans:
            have = np.bincount(codes[a:b][codes[a:b] >= 0], minlength=len(self.code))
            enough = np.minimum(self.need, have).sum(1)
            for (k, s), may_miss, same in zip(self.statements, self.may_miss, enough, strict=True):
                if same < len(s) - may_miss:
                    continue
                for start, stop, missing, added in self.matches(codes[a:b], s, may_miss):
                    begin, end = words[a + start].start(), words[a + stop - 1].end()
                    out.append((len(s) - 2 * missing - added, k, a + start, a + stop, begin, end, missing, added))
        return len(spans), out

    def chosen(self, found: list[tuple], text: str) -> list[dict]:
        """Of matches that overlap the best; what is left, in order."""
        rated = [(-net, -self.reduction(k, text[begin:end]), k, a, b, begin, end, missing, added) for net, k, a, b, begin, end, missing, added in set(found)]
        taken: list[tuple[int, int]] = []
        out = []
        for _, less, k, a, b, begin, end, missing, added in sorted(rated):
            at = bisect_right(taken, (a, b))
            if less < 0 and (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                insort(taken, (a, b))
                out.append({"license": k, "start": begin, "stop": end, "reduction": -less, "missing": missing, "added": added})
        return sorted(out, key=lambda x: x["start"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row per document: its number of candidate blocks and the confirmed licenses with their spans (code points)."""

    def each(batches):
        import pyarrow as pa

        scanner = Scanner(templates)
        kind = pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("findings", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("reduction", pa.float64()), ("missing", pa.int32()), ("added", pa.int32())])))])
        for ids, texts in text_slices(batches):
            looked = [scanner.look(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_blocks": [n for n, _ in looked], "findings": [f for _, f in looked]}, schema=kind)

    return id_and_text(docs, doc_id, text).mapInArrow(each, FOUND)
