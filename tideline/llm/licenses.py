"""License scans by conditional compression: a block that holds a template's wording compresses far better when the template is the dictionary."""

from __future__ import annotations

import re

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The wording of public licenses' notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

PLAIN = re.compile(r"[^\s\W_]+(?:[.-][^\s\W_]+)*", re.UNICODE)
#: Letters of a word that a compressor sees: more than any template's word has, so that a text without breaks makes no huge block.
SEEN = 64


def plain_words(text: str) -> list[str]:
    """Words in lower case without punctuation around them; dots and hyphens inside stay."""
    return [w.lower() for w in PLAIN.findall(text)]


def closest_wording(block: np.ndarray, template: np.ndarray) -> tuple[int, int, int, int]:
    """(missing, extra, first, last) of the stretch block[first:last] that differs least from template: words of the
    template that it lacks, and words that the template lacks.

    A minimal alignment of the whole template with any stretch, row by row: each cell holds differences and, in the low
    digits, how long ago the stretch began. Of equal ones the leftmost wins, and of these the shortest.
    """
    n, m = len(template), len(block)
    unit = 2 * (m + 1)
    along = np.arange(m + 1, dtype=np.int64) * unit
    cell = m - np.arange(m + 1, dtype=np.int64)
    for word in template:
        below = cell + unit
        below[1:] = np.minimum(below[1:], np.where(block == word, cell[:-1], unit * (n + m + 2)))
        cell = np.minimum.accumulate(below - along) + along
    last = int(np.argmin(cell // unit))
    differences, first = int(cell[last] // unit), m - int(cell[last] % unit)
    extra = (differences + last - first - n) // 2
    return differences - extra, extra, first, last


class Scanner:
    """Compressors, one for each template as raw dictionary and one without, all with the same parameters, made once in a worker."""

    def __init__(self, templates: dict[str, str], most_different: float, level: int = 3):
        import zstandard as z

        self.names = [n for n in sorted(templates) if plain_words(templates[n])]
        words = {n: plain_words(templates[n]) for n in self.names}
        self.number = {w: k for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.template = {n: np.array([self.number[w] for w in ws], dtype=np.int64) for n, ws in words.items()}
        self.most = {n: int(most_different * len(ws) + 1e-9) for n, ws in words.items()}
        self.belongs = {n: np.isin(np.arange(len(self.number) + 1), t) for n, t in self.template.items()}  # the last is for other words
        self.longest = max((len(words[n]) + self.most[n] for n in self.names), default=0)
        how = z.ZstdCompressionParameters.from_level(level, source_size=2048, dict_size=1024, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain = z.ZstdCompressor(compression_params=how)
        self.each = {n: z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(" ".join(words[n]).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for n in self.names}

    def ranked(self, words: list[str], names: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of the block of words, most first, ties by name."""
        block = " ".join(w[:SEEN] for w in words).encode()
        alone = len(self.plain.compress(block))
        return sorted(((alone - len(self.each[n].compress(block)), n) for n in names), key=lambda r: (-r[0], r[1]))

    def regions(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """Stretches (first, last, templates) outside of which no wording of a template can lie.

        A wording with most[n] differences at most lies in a stretch of so many words more than the template's, of
        which so many less belong to the template. Any other stretch is ruled out by counting.
        """
        found = []
        for n in self.names:
            size, k = len(self.template[n]), self.most[n]
            counts = np.concatenate([[0], np.cumsum(self.belongs[n][ids])])
            if counts[-1] < size - k:
                continue
            span = min(size + k, len(ids))
            at = np.flatnonzero(counts[span:] - counts[:-span] >= size - k)
            if len(at):
                cuts = np.flatnonzero(np.diff(at) > span)
                found += [(int(lo), int(hi) + span, n) for lo, hi in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)], strict=True)]
        merged: list[tuple[int, int, set[str]]] = []
        for lo, hi, n in sorted(found):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]), merged[-1][2] | {n})
            else:
                merged.append((lo, hi, {n}))
        return merged

    def scan_words(self, words: list[str]) -> list[tuple]:
        """(first, last, license, bytes saved, missing, extra) of each confirmed wording, in words."""
        other = len(self.number)
        ids = np.fromiter((self.number.get(w, other) for w in words), dtype=np.int64, count=len(words))
        found = []
        for begin, end, names in self.regions(ids):
            # Blocks of bounded size; one answers for the wordings that begin in its first two thirds, all of which lie whole in it.
            for lo in range(begin, end, 2 * self.longest):
                hi, mine = min(end, lo + 3 * self.longest), lo + 2 * self.longest
                for saved, n in self.ranked(words[lo:hi], sorted(names)):
                    # What better ranked templates have claimed is gone; a wording is sought between.
                    stretches = [(lo, hi)]
                    while stretches:
                        a, b = stretches.pop()
                        if np.count_nonzero(self.belongs[n][ids[a:b]]) < len(self.template[n]) - self.most[n]:
                            continue
                        missing, extra, first, last = closest_wording(ids[a:b], self.template[n])
                        if missing + extra > self.most[n] or missing == len(self.template[n]):
                            continue
                        first, last = a + first, a + last
                        if first < mine:
                            found.append((first, last, n, saved, missing, extra))
                            ids[first:last] = other
                        stretches += [(a, first), (last, b)]
        return sorted(found)

    def scan(self, text: str | None) -> list[tuple]:
        """scan_words() of a text, with character offsets."""
        found = self.scan_words(plain_words(text or ""))
        if not found:
            return []
        wanted = {k for first, last, *_ in found for k in (first, last - 1)}
        spans = {k: m.span() for k, m in enumerate(PLAIN.finditer(text)) if k in wanted}
        return [(spans[first][0], spans[last - 1][1], *rest) for first, last, *rest in found]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, most_different: float = 0.1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each license wording in a text: doc_id, start and length (characters), license, bytes_saved, missing, extra, exact.

    A wording differs from its template by at most most_different of the template's words, missing or added (a
    changed word is both). Candidate blocks are all stretches that hold enough of some template's words, so none is
    lost. Each block is compressed alone and with each template as zstandard raw dictionary; templates are tried in
    order of the bytes they save, confirmed by a minimal alignment of words, and claim theirs, so that of several
    that fit a place the best ranked wins. exact: no word differs. Blocks have at most three times the longest
    template's words. Null and empty texts have none. Null ids and repeated rows pass through, each with its own
    rows. Other columns are ignored. Templates without words match nothing.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates, most_different)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["doc_id", "start", "length", "license", "bytes_saved", "missing", "extra", "exact"]
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, a, b - a, name, saved, missing, extra, not missing + extra) for a, b, name, saved, missing, extra in scanner.scan(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    some = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("text <> ''")
    return some.mapInArrow(run, "doc_id long, start long, length long, license string, bytes_saved long, missing long, extra long, exact boolean")
