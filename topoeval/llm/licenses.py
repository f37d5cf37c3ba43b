"""License scans: Dice coefficient over word bigrams against licence templates.

The units of a text are its lines, its paragraphs (stretches between blank lines) of several lines, and
the text itself if it has several paragraphs. A unit's words are its runs of a-z and 0-9 after lower-casing
A-Z. A template is found where the Dice coefficient of both bigram sets is at least THRESHOLD. Dice can
only reach t if the sizes differ by no more than (2 - t) / t, so templates are held by size and
a unit meets only those within that bound; of these, only templates that share a bigram.

Everything is local to a row: no shuffle, and the templates (a few kB) go with the closure.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from topoeval.llm.common import slices, texts

THRESHOLD = 0.8
WORD = re.compile("[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Statements and notices by which texts name their licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORD.findall(text.translate(LOWER))
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def units(text: str) -> Iterator[str]:
    """Lines, paragraphs of several lines, and a text of several paragraphs."""
    lines = text.split("\n")
    yield from lines
    paragraphs, held = 0, []
    for line in [*lines, ""]:
        if line.strip(" \t\r"):
            held.append(line)
        elif held:
            paragraphs += 1
            if len(held) > 1:
                yield "\n".join(held)
            held = []
    if paragraphs > 1:
        yield text


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.by_size: dict[int, list[tuple[str, frozenset]]] = {}
        for name, text in templates:
            b = bigrams(text)
            self.by_size.setdefault(len(b), []).append((name, b))
        self.by_bigram = {p for of in self.by_size.values() for _, b in of for p in b}
        ratio = (2 - threshold) / threshold
        #: sizes of units that can reach the threshold -> templates in bound
        most = int(max(self.by_size) * ratio) + 1
        self.near = {
            n: [t for k, of in self.by_size.items() if n <= k * ratio + 1e-9 and k <= n * ratio + 1e-9 for t in of]
            for n in range(1, most + 1)
        }

    def match(self, unit: str) -> list[tuple[str, float]]:
        """Licences whose templates the unit reaches, with their coefficients."""
        own = bigrams(unit)
        near = self.near.get(len(own))
        if not near or own.isdisjoint(self.by_bigram):
            return []
        return [(name, d) for name, b in near if (d := dice(own, b)) >= self.threshold]

    def scan(self, text: str) -> tuple[int, list[str], str | None, float]:
        """Units with a licence, all licences sorted, the best one (ties: the first by name), its coefficient."""
        n, found = 0, {}
        for unit in units(text):
            if hits := self.match(unit):
                n += 1
                for name, d in hits:
                    found[name] = max(found.get(name, 0.0), d)
        best = min(found, key=lambda k: (-found[k], k), default=None)
        return n, sorted(found), best, found.get(best, 0.0) if best else 0.0


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, n_units, licenses (sorted, comma-joined), best_license (null if none), best_dice of every row.

    Null and empty texts have no units with a licence. Rows that repeat are each returned.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in slices(batches):
            rows = [scanner.scan(x) for x in texts(b)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([",".join(r[1]) for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                    pa.array([math.floor(r[3] * 1e6 + 0.5) / 1e6 for r in rows], pa.float64()),
                ],
                ["doc_id", "n_units", "licenses", "best_license", "best_dice"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_units long, licenses string, best_license string, best_dice double"
    )
