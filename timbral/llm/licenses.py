"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A document's shingles (five words) are covered by windows that overlap, for each
size of template: a window holds 1.25 times the template's shingles at least and
they start every quarter of it, so that an occurrence lies wholly in one.  A
window and the template whose share s of shingles it holds have a Jaccard
similarity of s / (1.25 * 1.5 + 1 - s) at least; with bands of one row each the
template is retrieved with probability 1 - (1 - J) ** BANDS, 0.99999 for s = 0.8.
The share of the template's shingles that the window holds decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.llm.decontaminate import normal_form
from timbral.llm.shared import U64, mix, prefix_hash, shingle_hashes, slices, span_hash, text_bytes, words

WIDTH = 5
LEAST_SHARE = 0.8
BANDS = 24
_SLICE = 1 << 20
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U64)) | U64(1)

# Short notices and the opening words of well-known licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
}


def document_shingles(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle, in order; words are those of the normal form, without punctuation and case."""
    form, off, _ = normal_form(*text_bytes(column))
    start, end, doc = words(form, off)
    return shingle_hashes(span_hash(prefix_hash(form), start, end), doc, WIDTH)


class Templates:
    """Shingle sets of the templates, their MinHash bands, and the classes of window sizes."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = list(texts)
        hashes, own = document_shingles(pa.array([texts[n] for n in self.names], pa.string()))
        self.sets = [np.unique(hashes[own == k]) for k in range(len(self.names))]
        sizes: list[int] = []
        for size in sorted({len(s) for s in self.sets if len(s)}, reverse=True):
            if not sizes or sizes[-1] > 1.5 * size:
                sizes.append(size)
        self.classes = []
        for size in sizes:
            rows = [k for k, s in enumerate(self.sets) if len(s) <= size < 1.5 * len(s) + 1 and size == min(x for x in sizes if x >= len(s))]
            band = np.array([[(mix(self.sets[k] * seed)).min() for k in rows] for seed in _SEEDS], U64)
            seen = np.zeros((BANDS, 1 << 16), bool)
            for b in range(BANDS):
                seen[b, band[b] >> U64(48)] = True
            self.classes.append((size, max(1, size // 4), np.array(rows), band, seen))


def _candidates(hashes: np.ndarray, own: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(first shingle, shingle after the last, template) of the windows whose bands meet a template's."""
    found: set[tuple[int, int, int]] = set()
    n = len(hashes)
    for b, seed in enumerate(_SEEDS):
        value = mix(hashes * seed)
        for size, hop, rows, band, seen in templates.classes:
            low = np.minimum.reduceat(value, np.arange(0, n, hop)) if hop > 1 else value
            blocks = -(-size // hop) + 1  # a window; near a document's end it runs into the next one and is cut when it is verified
            reach = low.copy()
            for j in range(1, blocks):
                reach[: len(low) - j] = np.minimum(reach[: len(low) - j], low[j:])
            for x in np.flatnonzero(seen[b][reach >> U64(48)]):
                for k in rows[band[b] == reach[x]]:
                    found.add((int(x) * hop, min(n, (int(x) + blocks) * hop), int(k)))
    return found


def find_licenses(column: pa.Array | pa.ChunkedArray, templates: Templates, least: float = LEAST_SHARE) -> list[tuple[int, int, float, int]]:
    """(document, template, largest share, windows) of each pair in which a window holds enough of the template's shingles."""
    hashes, own = document_shingles(column)
    if not len(hashes):
        return []
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for a, b, k in _candidates(hashes, own, templates):
        for doc in np.unique(own[a:b]):
            part = hashes[a:b][own[a:b] == doc]
            share = len(np.intersect1d(part, templates.sets[k])) / len(templates.sets[k])
            if share >= least:
                old = best.get((int(doc), k), (0.0, 0))
                best[int(doc), k] = (max(old[0], share), old[1] + 1)
    return [(d, k, share, n) for (d, k), (share, n) in sorted(best.items())]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, license, containment (largest share of the template's shingles in a window) and n_windows, for each license that a document holds.

    docs: doc_id, text; other columns are ignored.  texts: template texts by
    name (TEMPLATES); one of no words matches nothing.  A template or document
    of fewer than five words is one shingle.  Null and empty texts match
    nothing; repeated rows are scanned each; a null doc_id stays null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(TEMPLATES if texts is None else texts)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("n_windows", pa.int64())])

    def scan(batches):
        templates = Templates(sent.value)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                rows = find_licenses(part.column("text"), templates, least)
                ids = part.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": ids[d], "license": templates.names[k], "containment": share, "n_windows": n} for d, k, share, n in rows], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, license string, containment double, n_windows long")
