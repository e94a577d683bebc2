"""License scans: winnowed fingerprints propose, banded alignment decides.

Texts and templates are words of letters and digits, lower case. Of each run of ``window`` word n-grams the least is a
fingerprint, so any ``window + gram - 1`` words in common share one. Templates' fingerprints form an inverted index (a
small table that goes with the task). How many words in a row stay unchanged at the least, if a share ``COVERED`` of a
template is matched, follows from its length; templates are indexed by (gram, window) so that such a run always has a
fingerprint, and no copy that counts is missed for want of a candidate. A text's fingerprints in the index give template
and diagonal; each such band is aligned with the whole template. No shuffle.

Words that tell licences apart (names, conditions, version numbers) are decisive: those in the matched span must be
exactly the template's, in order. Of findings that overlap, the one with most matched words stays.

Defined cases: null and empty texts have no findings; of equal rows each has its own; a template that occurs several
times in a text is found once for each place; a very long text is handled by itself; without templates there are no
rows; a document without a doc_id keeps it null; an empty table gives no row; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import align
from quillon.llm import common as C

U64 = np.uint64
#: The share of a template that has to match; the band's half width in words, as a share of the template, and at least.
COVERED, BAND, LEAST_BAND = 0.8, 1 / 12, 3
#: (gram, window) by the least run of unchanged words that they are sure to catch.
KINDS = {4: (3, 2), 2: (2, 1), 1: (1, 1)}
#: Candidates aligned at once.
STEP = 2048

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
GNU = {"GPL": ("General Public License", ("2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
#: Conditions of the Creative Commons licences: in ids and short notices, and in full names.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}

#: Words that tell licences apart; numbers do so too for a licence whose id has a version.
DECISIVE = frozenset("mit apache bsd isc gnu gpl lgpl agpl lesser affero mozilla eclipse boost creative commons cc cc0 nc sa nd attribution noncommercial sharealike noderivatives noderivs later only unlicense".split())


def gnu_templates() -> list[tuple[str, str]]:
    """Notices of the GNU licences, long and short, for a version alone and for later ones too."""
    out = []
    for kind, (name, versions) in GNU.items():
        for v in versions:
            spdx = f"{kind}-{v if '.' in v else v + '.0'}"
            out += [(f"{spdx}-or-later", GNU_NOTICE.format(name=name, version=f"either version {v} of the License, or (at your option) any later version"))]
            out += [(f"{spdx}-or-later", f"licensed under the GNU {name}, version {v} or later"), (f"{spdx}-or-later", f"GNU {name}, version {v} or later")]
            out += [(spdx, GNU_NOTICE.format(name=name, version=f"version {v} of the License"))]
            out += [(spdx, f"GNU {name}, version {v}"), (spdx, f"This work is licensed under the GNU {name}, version {v}.")]
    return out


def commons_templates() -> list[tuple[str, str]]:
    """Notices of the Creative Commons licences, by full and by short name."""
    out = []
    for short, long in COMMONS.items():
        for v, port in COMMONS_VERSIONS.items():
            out += [(f"CC-{short}-{v}", f"Creative Commons {long} {v}"), (f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {long} {v} {port} License."), (f"CC-{short}-{v}", f"Licensed under CC {short} {v}.")]
    return out


#: Texts of short licences and notices by which works state theirs, by SPDX id.
TEMPLATES = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_END}"),
    ("BSD", BSD_GRANT),
    ("ISC", ISC),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", MPL),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", UNLICENSE),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    *gnu_templates(),
    *commons_templates(),
)

#: Bytes as they count: A-Z lower, other ASCII that is no letter or digit as a space.
LEVEL = np.arange(256, dtype=np.uint8)
LEVEL[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]


def levelled(texts: pa.Array) -> pa.Array:
    """The column with each byte as it counts; lengths stay."""
    data, at = C.raw(texts)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(LEVEL[data].tobytes())])


def word_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the end of it, among all bytes of levelled texts."""
    data, at = C.raw(texts)
    blank = data == 32
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begin = ~blank & (np.concatenate(([True], blank[:-1])) | cut[:-1])
    end = ~blank & (np.concatenate((blank[1:], [True])) | cut[1:])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def fingerprints(words: C.Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the winnowed n-grams among all words, and their names."""
    names = C.windows(words.hashes, gram)
    valid = np.arange(len(names)) + gram + window - 1 <= words.ends()
    least = C.sliding(names, window, np.minimum, U64(0xFFFFFFFFFFFFFFFF))
    most = C.sliding(np.where(valid, least, U64(0))[::-1], window, np.maximum, U64(0))[::-1]
    near = C.sliding(valid[::-1], window, np.logical_or, False)[::-1]
    places = np.flatnonzero(near & (most == names))
    return places, names[places]


def unchanged_run(size: int, covered: float) -> int:
    """Words in a row that are unchanged at the least, if a share ``covered`` of ``size`` words is matched."""
    edits = int(size * (1 - covered) + 1e-9)
    return -(-(size - edits) // (edits + 1))


def kinds_of(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, whether it is decisive as a word, and as a number."""
    distinct = words.dictionary.cast(pa.string()).to_pylist()
    name = np.fromiter((w in DECISIVE for w in distinct), bool, len(distinct))
    number = np.fromiter((w.isascii() and w.isdigit() for w in distinct), bool, len(distinct))
    return name[words.codes], number[words.codes]


@dataclass
class Index:
    """Templates' words and, by (gram, window), the inverted index of their fingerprints."""

    ids: list[str]
    size: np.ndarray
    words: np.ndarray
    band: np.ndarray
    #: Of each template whether numbers are decisive, and its decisive words.
    versioned: np.ndarray
    decisive: list[list[int]]
    #: Fingerprints in order, where the places of each begin, and template and place of these.
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, templates=TEMPLATES, covered: float = COVERED) -> Index:
        words = C.Words(levelled(pa.array([t for _, t in templates], pa.string())))
        table = np.zeros((len(templates), int(words.counts.max()) if len(templates) else 0), np.uint64)
        versioned = np.array([bool(re.search(r"\d\.\d", i)) for i, _ in templates], bool)
        name, number = kinds_of(words)
        decisive = []
        for i, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:], strict=True)):
            table[i, : b - a] = words.hashes[a:b]
            decisive.append(words.hashes[a:b][name[a:b] | (number[a:b] & versioned[i])].tolist())
        kind = np.array([next(r for r in KINDS if unchanged_run(int(n), covered) >= r or r == 1) for n in words.counts], np.int64)
        grams = {}
        for run in set(kind.tolist()):
            places, names = fingerprints(words, *KINDS[run])
            template = np.searchsorted(words.starts, places, side="right") - 1
            own = kind[template] == run
            places, names, template = places[own], names[own], template[own]
            order, cut = C.grouped(names)
            if len(order):
                grams[KINDS[run]] = names[order[cut[:-1]]], cut, template[order], (places - words.starts[template])[order]
        return cls([i for i, _ in templates], words.counts, table, np.maximum(LEAST_BAND, (words.counts * BAND).astype(np.int64)), versioned, decisive, grams)


def candidates(index: Index, words: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, template and first diagonal of the bands that a fingerprint proposes."""
    found = [np.empty((0, 3), np.int64)]
    for (gram, window), (known, cut, of, place) in index.grams.items():
        places, names = fingerprints(words, gram, window)
        g = np.searchsorted(known, names)
        g[g == len(known)] = 0
        real = known[g] == names
        places, g = places[real], g[real]
        many = cut[g + 1] - cut[g]
        at = C.ragged(cut[g], many)
        template, places = of[at], np.repeat(places, many)
        wide = index.band[template] + 1
        row = np.searchsorted(words.starts, places, side="right") - 1
        found.append(np.unique(np.stack((row, template, (places - place[at]) // wide * wide), axis=1), axis=0))
    row, template, diagonal = np.concatenate(found).T
    return row, template, diagonal - index.band[template]


def aligned(index: Index, words: C.Words, covered: float) -> tuple[np.ndarray, ...]:
    """Row, template, matched words, first and last word (end excluded) of alignments that cover enough."""
    row, template, first = candidates(index, words)
    if not len(row):
        return tuple(np.empty((5, 0), np.int64))
    by = np.argsort(index.size[template], kind="stable")
    row, template, first = row[by], template[by], first[by]
    change = np.flatnonzero(np.diff(index.band[template])) + 1
    cuts = np.union1d(np.arange(0, len(row), STEP), change).tolist()
    out = [np.empty((0, 5), np.int64)]
    for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True):
        r, t, f = row[i:j], template[i:j], first[i:j]
        longest, width = int(index.size[t].max()), 3 * int(index.band[t[0]]) + 1
        at = f[:, None] + np.arange(longest + width)
        inside = (at >= words.starts[r][:, None]) & (at < words.starts[r + 1][:, None])
        text = np.where(inside, words.hashes[np.clip(at, 0, len(words.hashes) - 1)], U64(1))
        matched, begin, end = align.local(index.words[t, :longest], index.size[t], text, width)
        good = matched >= covered * index.size[t]
        out.append(np.stack((r, t, matched, f + begin, f + end), axis=1)[good])
    return tuple(np.concatenate(out).T)


OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int64()), ("coverage", pa.float64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
OUT_DDL = "doc_id long, license string, matched_words long, coverage double, start_byte long, end_byte long"


def chosen(index: Index, words: C.Words, row, template, matched, begin, end) -> list[int]:
    """Findings whose decisive words are the template's; of those that overlap, the one with most matched words."""
    name, number = kinds_of(words)
    taken: dict[int, list[tuple[int, int]]] = {}
    stay = []
    for i in np.lexsort((begin, template, -matched / np.maximum(index.size[template], 1), -matched, row)).tolist():
        a, b, t = int(begin[i]), int(end[i]), int(template[i])
        spans = taken.setdefault(int(row[i]), [])
        if any(a < e and b > s for s, e in spans):
            continue
        tells = name[a:b] | number[a:b] if index.versioned[t] else name[a:b]
        if words.hashes[a:b][tells].tolist() == index.decisive[t]:
            spans.append((a, b))
            stay.append(i)
    return stay


def scan(batches, index: Index, covered: float):
    if not index.grams:
        return
    for batch in C.chunks(batches):
        low = levelled(batch.column("text"))
        words = C.Words(low)
        row, template, matched, begin, end = aligned(index, words, covered)
        stay = chosen(index, words, row, template, matched, begin, end) if len(row) else []
        if not stay:
            continue
        row, template, matched, begin, end = (x[stay] for x in (row, template, matched, begin, end))
        byte, byte_end = word_bytes(low)
        _, base = C.raw(low)
        yield C.record(OUT, doc_id=batch.column("doc_id").take(pa.array(row)), license=[index.ids[t] for t in template], matched_words=matched, coverage=matched / index.size[template], start_byte=byte[begin] - base[row], end_byte=byte_end[end - 1] - base[row])


def licenses(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """A row for each place in a document where at least ``covered`` of a template's words are matched, the decisive ones
    all: doc_id, license, matched_words, coverage and the bytes it spans."""
    index = Index.of(templates, covered)
    return C.only(docs, "doc_id", "text").mapInArrow(lambda b: scan(b, index, covered), OUT_DDL)
