"""License scans by conditional compression and exact wording differences.

Every cue word, with as many words before and after it as the longest template's window has, makes a candidate block; blocks that
meet are one. Lines do not matter, so a wrapped notice is whole. A block is compressed plainly and with each template as a zstandard raw dictionary;
the share of bytes that a template saves is its rank, and templates are compared in this order, word by word: the template's words are
aligned with the block's, slots take the one word that stands there (a version, a year), and a template is confirmed if at least ``LEAST`` of its words are
found in order and no more than a third as many foreign words stand between them. What is missing or extra is listed. None is left uncompared for its rank, since a
block may hold many notices; only templates of which too few words stand in the block at all are not tried.
Of confirmed templates that overlap, the one with most words found, less two for each difference, is taken; then the better rank.

Defined results: null and empty texts have no blocks; very long texts and long blocks are read whole; a text
may give several rows, or none; repeated rows each give theirs; ties in rank go to the template listed first;
an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUE = r"(?i)licen[cs]|copyright|warrant|redistribut|public\W+domain|spdx|permission\W+is\W+hereby|all\W+rights\W+reserved|creative\W+commons|\bcc[\s-]+by|binary\W+forms|unencumbered"
LEAST = 0.85

#: Parts of license bodies, as published. Fixed values.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Notices of common licenses, as published. <version>, <year> and <name> stand for one word each. Fixed values.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        MIT_GRANT,
        f"{MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {MIT_WARRANTY}",
    ],
    "Apache": [
        "Licensed under the Apache License, Version <version>.",
        "Released under the Apache License, Version <version>.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version <version> (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version <version>.",
        "Released under the GNU General Public License, version <version>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <version> of the License, or (at your option) any later version.",
    ],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License, version <version>."],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version <version>."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. <version>. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, Version <version>."],
    "BSD": [
        "Released under the BSD License.",
        BSD_CONDITIONS,
        f"{BSD_CONDITIONS} {BSD_CLAUSES} {BSD_WARRANTY}",
        f"{BSD_CONDITIONS} {BSD_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_WARRANTY}",
    ],
    "ISC": [ISC_GRANT, f"{ISC_GRANT} {ISC_WARRANTY}"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-NC": ["Licensed under CC BY-NC <version>.", "This work is licensed under a Creative Commons Attribution-NonCommercial <version> International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA <version>.", "This work is licensed under a Creative Commons Attribution-ShareAlike <version> International License."],
    "CC-BY": ["Licensed under CC BY <version>.", "This work is licensed under a Creative Commons Attribution <version> International License."],
    "CC0": ["Released under CC0 <version>, public domain dedication."],
    "Proprietary": ["All rights reserved."],
}
WORDS = re.compile(r"<\w+>|[^\W_]+(?:[.'-][^\W_]+)*")


def word_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORDS.finditer(text)]


class Scanner:
    """The templates with their dictionaries; built once in each task."""

    def __init__(self) -> None:
        self.plain = self.compressor(None)
        self.templates = [(name, text, [w for w, _, _ in word_spans(text)], self.compressor(text)) for name, texts in TEMPLATES.items() for text in texts]
        self.reach = max(window_size(wanted) for _, _, wanted, _ in self.templates)

    @staticmethod
    def compressor(text: str | None) -> zstandard.ZstdCompressor:
        extra = {} if text is None else {"dict_data": zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
        return zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)

    def saved(self, raw: bytes, k: int) -> float:
        """Share of the compressed size that template ``k`` saves."""
        return 1 - len(self.templates[k][3].compress(raw)) / len(self.plain.compress(raw))

    def ranked(self, block: str, there: set[str]) -> list[tuple[float, int]]:
        """Templates that may be in the block, most saved first."""
        able = [k for k, (_, _, wanted, _) in enumerate(self.templates) if may_reach(wanted, there)]
        if not able:
            return []
        raw = block.encode()
        plain = len(self.plain.compress(raw))
        return sorted(((1 - len(self.templates[k][3].compress(raw)) / plain, k) for k in able), key=lambda x: (-x[0], x[1]))

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Character spans of candidate blocks."""
        first, last = -1, -1
        for cue in re.finditer(CUE, text):
            start = words_before(text, cue.start(), self.reach)
            if first >= 0 and start > last:
                yield first, last
                first = -1
            first = start if first < 0 else first
            for word in islice(WORDS.finditer(text, cue.start()), self.reach):
                last = max(last, word.end())
            last = max(last, cue.end())
        if first >= 0:
            yield first, last

    def confirmed(self, block: str) -> Iterator[dict]:
        """Templates found in the block."""
        words = word_spans(block)
        spoken = [w for w, _, _ in words]
        found = []
        for rank, (_, k) in enumerate(self.ranked(block, set(spoken))):
            name, _, wanted, _ = self.templates[k]
            for at in places(wanted, spoken):
                odd = len(at["missing"]) + len(at["extra"])
                start, end = words[at["first"]][1], words[at["end"] - 1][2]
                said = {"license": name, "template": k, "version": at["slot"], "missing": " ".join(at["missing"]), "extra": " ".join(at["extra"]), "start": start, "end": end}
                found.append((2 * odd - (len(wanted) - len(at["missing"])), rank, at["first"], at["end"], said))
        taken = [False] * len(words)
        for *_, first, end, said in sorted(found, key=lambda f: f[:4]):
            if not any(taken[first:end]):
                taken[first:end] = [True] * (end - first)
                yield said | {"saved": self.saved(block[said["start"] : said["end"]].encode(), said["template"])}


def words_before(text: str, at: int, n: int) -> int:
    """Where the ``n``-th word before ``at`` begins."""
    size = 16 * n
    while True:
        low = max(0, at - size)
        starts = [m.start() for m in WORDS.finditer(text, low, at)]
        if len(starts) > n:  # the first may be cut
            return starts[-n]
        if not low:
            return 0
        size *= 4


def window_size(wanted: list[str]) -> int:
    return len(wanted) + len(wanted) // 3


def may_reach(wanted: list[str], there: set[str]) -> bool:
    """Whether enough of the words are there at all."""
    return sum(w in there or w.startswith("<") for w in wanted) >= LEAST * len(wanted)


def places(wanted: list[str], spoken: list[str]) -> Iterator[dict]:
    """Where ``wanted`` stands in ``spoken``, with what is missing and extra."""
    span = window_size(wanted)
    fixed = [w for w in wanted if not w.startswith("<")]
    first = set(fixed[: int((1 - LEAST) * len(wanted) + 1e-9) + 1])  # not all of these can be missing
    after = 0
    for i, word in enumerate(spoken):
        if i < after or word not in first:
            continue
        window = spoken[i : i + span]
        if not may_reach(wanted, set(window)):
            continue
        matcher = difflib.SequenceMatcher(None, wanted, window, autojunk=False)
        hits = [(a + n, b + n) for a, b, size in matcher.get_matching_blocks() for n in range(size)]
        if not hits or hits[0][1]:  # it begins at a later word, whose window does not cut its end
            continue
        slots, missing, end = [], [], max(b for _, b in hits) + 1
        at = dict(hits)
        used = set(at.values())
        for a, w in enumerate(wanted):
            if a in at:
                continue
            here = at.get(a - 1, -2) + 1
            if w.startswith("<") and 0 <= here < len(window) and here not in used:
                slots.append(window[here])
                used.add(here)
                end = max(end, here + 1)
            else:
                missing.append(w)
        extra = [window[b] for b in range(min(used), end) if b not in used]
        if (len(wanted) - len(missing)) >= LEAST * len(wanted) and 3 * len(extra) <= len(wanted) and len(slots) == sum(w.startswith("<") for w in wanted):
            yield {"first": i + min(used), "end": i + end, "slot": " ".join(slots), "missing": missing, "extra": extra}
            after = i + end


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, version, char_start, char_end, saved, missing, extra)``, a row for each notice found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = text.as_py()
                for a, b in scanner.blocks(said):
                    out += [(id_, m["license"], m["version"], a + m["start"], a + m["end"], round(m["saved"], 6), m["missing"], m["extra"]) for m in scanner.confirmed(said[a:b])]
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

    kind = docs.schema[id_col].dataType.simpleString()
    cued = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CUE))
    return cued.mapInArrow(run, f"doc_id {kind}, license string, version string, char_start long, char_end long, saved double, missing string, extra string")


NAMES = ["doc_id", "license", "version", "char_start", "char_end", "saved", "missing", "extra"]
