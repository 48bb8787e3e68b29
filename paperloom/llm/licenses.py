"""License scans: canonical digest lookup.

A text's canonical form has A-Z lower-cased, copyright lines dropped, runs of
ASCII punctuation and blanks as one blank, and equivalent spellings brought to
one. Its MD5 is looked up, by a hash join, among the digests of known licences
in the same form: for the whole text, and for each of its lines, where notices
stand. Nothing is guessed from parts of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, UPPER, stored

# Spellings that licence matching treats as the same, and the one that is kept.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "favour": "favor", "organisation": "organization", "organisations": "organizations",
    "authorisation": "authorization", "authorised": "authorized", "judgement": "judgment", "acknowledgement": "acknowledgment",
    "fulfil": "fulfill", "whilst": "while", "http": "https", "noncommercial": "nc", "v2": "2", "v3": "3",
}

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: (license, text): texts and notices known by default; a table of the same form may be given instead.
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("proprietary", "All rights reserved."),
]

COPYRIGHT = re.compile(r"^[^a-z0-9©]*(copyright|\(c\)|©)")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F©]+")
LOWERED = str.maketrans(UPPER, LOWER)


def canonical_lines(text: str | None) -> list[str]:
    """The canonical form of each line; empty for copyright lines and lines without words."""
    out = []
    for line in (text or "").translate(LOWERED).split("\n"):
        words = [] if COPYRIGHT.match(line) else WORDS.findall(line)
        out.append(" ".join([SPELLINGS.get(w, w) for w in words]))
    return out


def _digest(form: str) -> bytes:
    return hashlib.md5(form.encode()).digest()


def _digests(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, digests = [], [], []
            for k, text in zip(batch[key].to_pylist(), batch["text"]):
                forms = canonical_lines(text.as_py())
                whole = " ".join(f for f in forms if f)
                keys.append(k)
                lines.append(None)
                digests.append(_digest(whole) if whole else None)
                for form in {f for f in forms if f}:
                    keys.append(k)
                    lines.append(True)
                    digests.append(_digest(form))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.bool_()), pa.array(digests, pa.binary())],
                                             [key, "line", "digest"])
    return run


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Every row as (doc_id, digest, license, notices).

    digest: MD5 of the whole canonical text, NULL for texts without words;
    license: the known licences that the whole text is, notices: those that a line is, each
    in order and joined by commas, NULL for none. `known` (license, text) may repeat
    itself and give one text to several licences; its NULL and empty texts match
    nothing. Repeated rows stay, rows without an id are scanned too; other columns
    are not read; empty tables give no rows or no matches.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    names = known.filter("license is not null").select(F.xxhash64("license", "text").alias("_row"), "license", "text").distinct()
    digests = names.select("_row", "text").mapInArrow(_digests("_row"), "_row bigint, line boolean, digest binary")
    listed = digests.filter("line is null and digest is not null").join(names, "_row").select("digest", "license").distinct()
    found = stored(keyed.select("_row", "text").mapInArrow(_digests("_row"), "_row bigint, line boolean, digest binary"))
    joined = F.nullif(F.array_join(F.array_sort(F.collect_set("license")), ","), F.lit(""))
    notices = found.filter("line").join(listed, "digest").groupBy("_row").agg(joined.alias("notices"))
    whole = found.filter("line is null").select("_row", "digest").distinct()
    licenses = whole.join(listed, "digest").groupBy("_row").agg(joined.alias("license"))
    marks = whole.join(licenses, "_row", "left").join(notices, "_row", "left")
    return keyed.select("doc_id", "_row").join(marks, "_row").select("doc_id", F.lower(F.hex("digest")).alias("digest"), "license", "notices")
