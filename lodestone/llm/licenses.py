"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingles verify them.

Texts and templates are words in lower case without punctuation, and shingles of five of them. A
template belongs to a scale by its size, and each scale has windows of so many shingles, half of
which the next window shares:

    shingles of the template    window    stride    bands x rows
    23 or more (full texts)         16         8           4 x 2
    8 to 22 (notices)                6         3           4 x 1
    1 to 7 (single sentences)        1         1               1

A window's signature has the minima of its shingles' hashes under as many orders as bands times rows;
``rows`` minima make a band. The index holds the bands of
the template's windows at every offset, so whatever a text's own windows begin with, a template
that is there word by word has a window of equal shingles, and its bands collide for certain: at
stride s and window w that takes w + s - 1 shingles, the least of each scale. Where a window of a
changed copy has Jaccard similarity J with the template's, some band collides with probability
1 - (1 - J**rows)**bands, about: at a containment of 0.8 spread evenly, J = 2/3, that is 0.90 a window of
a full text, which mostly has ten or more of them, and 0.988 a window of a notice. A window of one shingle is looked up as it
is. What is retrieved is verified on the words themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import values

SHINGLE = 5
CONTAINMENT = 0.8
SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (least shingles of a template, window, stride, bands, rows) of each scale, the largest first.
SCALES = [(23, 16, 8, 4, 2), (8, 6, 3, 4, 1), (1, 1, 1, 1, 1)]
#: Template shingles, and entries of the band index, that are written into the plan at most.
MOST = 20_000

# License texts without names, years and places, and the notices by which files and pages state their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def shingles_of(text: str) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


def template_shingles(templates: dict[str, str]) -> list[tuple[str, int, str]]:
    """(license, number, words joined by a blank) of all shingles; equal ones of a template count once."""
    out = []
    for name, text in templates.items():
        if not (found := shingles_of(text)):
            raise ValueError(f"{name} has fewer than {SHINGLE} words")
        out += [(name, k, " ".join(x)) for k, x in enumerate(dict.fromkeys(found))]
    return out


def masks(n: int) -> list[int]:
    """``n`` masks, 8 at most, whose leading bits and those of their complements all differ; the first is 0."""
    return [((k << 60) | (k * 0x9E3779B97F4A7C15 & (2**60 - 1))) for k in range(n)]


def _flipped(shingles: Column, mask: int) -> Column:
    return F.transform(shingles, lambda s: s.bitwiseXOR(F.lit(mask)))


def signature(shingles: Column, count: int, rows: int) -> Column:
    """The bands, an array of ``count``, of a set of shingles.

    An order is that of the hashes with a mask flipped, or the reverse of it. As the leading bits
    differ, minima under different orders lie in different regions of the hashes. With one row each
    minimum is a band, with two rows the minima under an order and its reverse.
    """
    out = []
    for m in masks(count * rows // 2):
        flipped = _flipped(shingles, m) if m else shingles
        ends = lambda a: F.array(F.array_min(a), F.array_max(a)) if rows == 1 else F.array(F.xxhash64(F.array_min(a), F.array_max(a)))
        # a transform over an array of one binds the flipped hashes to a name
        out.append(F.transform(F.array(flipped), ends)[0] if m else ends(shingles))
    return F.concat(*out)


def bands(shingles: Column, window: int, stride: int, count: int, rows: int) -> Column:
    """The bands of each window of an array of shingle hashes; windows at the end are shorter."""
    if window == 1:
        return F.transform(shingles, lambda s: F.array(s))
    last = F.floor((F.greatest(F.size(shingles) - window, F.lit(0)) + stride - 1) / stride).cast("int")
    starts = F.when(F.size(shingles) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda i: F.slice(shingles, i * stride + 1, window))
    return F.transform(slices, lambda own: signature(own, count, rows))


def hashed(ws: Column) -> Column:
    """Hashes of the shingles of an array of words; empty for fewer words."""
    h = F.transform(ws, lambda w: F.xxhash64(w))
    at = lambda whole, i: F.xxhash64(*[F.element_at(whole, i + (k + 1)) for k in range(SHINGLE)])
    of = lambda whole: F.when(F.size(whole) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(whole) - SHINGLE), lambda i: at(whole, i))).otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.array(h), of))


def scale_of(shingles: int) -> int:
    return next(k for k, s in enumerate(SCALES) if shingles >= s[0])


def index(docs: DataFrame, templates: dict[str, str]) -> dict[int, list[set[int]]]:
    """By scale and band: the values of all windows of the templates. The templates are a parameter, and at most MOST entries."""
    out: dict[int, list[set[int]]] = {}
    for k, (_, window, stride, count, rows) in enumerate(SCALES):
        of = [" ".join(words(t)[i:]) for t in templates.values() if scale_of(len(shingles_of(t))) == k for i in range(stride)]  # an own offset each
        if of:
            one = values(docs.sparkSession, [(x,) for x in of], "text string").select(hashed(F.split("text", " ")).alias("s")).where(F.size("s") > 0)
            found = one.select(F.explode(bands(F.col("s"), window, stride, count, rows)).alias("b")).collect()
            out[k] = [{r["b"][j] for r in found} for j in range(count)]
    if sum(len(b) for of in out.values() for b in of) > MOST:
        raise ValueError(f"more than {MOST} entries in the index")
    return out


def retrieved(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, text_key, w, s, scales) of rows some window of which collides with the index: words, hashes of shingles, and the scales at which one does."""
    known = index(docs, templates)
    lower = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.filter(F.split(lower, SPLIT), lambda w: w != "").alias("w"))
    rows = rows.select("*", hashed(F.col("w")).alias("s"))

    def hit(scale: int) -> Column:
        _, window, stride, count, per = SCALES[scale]
        if window == 1:  # the band is the shingle
            return F.exists("s", lambda s: s.isin(sorted(known[scale][0])))
        collides = lambda b: _any([b[j].isin(sorted(known[scale][j])) for j in range(count)])
        return F.exists(bands(F.col("s"), window, stride, count, per), collides)

    found = F.filter(F.array(*[F.when(hit(k), F.lit(k)) for k in known]), lambda x: x.isNotNull())
    # a filter would be pushed below the columns it needs, and work them out again; a generator is not
    some = F.filter(F.array(F.struct(found.alias("scales"))), lambda x: F.size(x["scales"]) > 0)
    return rows.select("*", F.explode(some).alias("of")).select("doc_id", "text_key", "w", "s", "of.scales")


def _any(of: list[Column]) -> Column:
    out = of[0]
    for x in of[1:]:
        out = out | x
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and template that it contains: doc_id, license, containment, n_found, first_word.

    containment is the share of the template's distinct five-word shingles that the document has,
    ``containment`` at least; first_word is the number, from 0, of the first word of the first
    one found. Documents are told apart by doc_id and text: repeated rows are one. Null and
    empty texts match nothing; null doc_ids pass through; an empty table gives no rows; further
    columns are not read. Templates are a parameter of bounded size (MOST), and are broadcast.
    """
    spark = docs.sparkSession
    shingles = template_shingles(templates)
    if len(shingles) > MOST:
        raise ValueError(f"more than {MOST} template shingles")
    sizes = {n: sum(1 for x in shingles if x[0] == n) for n in templates}
    rows = [(n, k, scale_of(len(shingles_of(templates[n]))), sizes[n], x) for n, k, x in shingles]
    kept = values(spark, rows, "license string, number int, scale int, size int, shingle string")
    some = sorted({r[0] for r in kept.select(hashed(F.split("shingle", " "))[0]).distinct().collect()})  # at most MOST

    # only shingles whose hash a template has leave the array; the join compares their words
    hits = F.filter(F.transform("s", lambda s, i: F.struct(i.alias("at"), s.alias("s"))), lambda x: x["s"].isin(some))
    one = retrieved(docs, templates).select("doc_id", "text_key", "scales", "w", F.explode(hits).alias("x"))
    shingle = F.concat_ws(" ", F.slice("w", F.col("x.at") + 1, SHINGLE))
    found = one.select("doc_id", "text_key", "scales", F.col("x.at").alias("at"), shingle.alias("shingle")).join(F.broadcast(kept), "shingle").where(F.array_contains("scales", F.col("scale")))
    per = found.groupBy("doc_id", "text_key", "license", "size", "number").agg(F.min("at").alias("at")).groupBy("doc_id", "text_key", "license", "size").agg(F.count("*").alias("n_found"), F.min("at").cast("long").alias("first_word"))
    return per.select("doc_id", "license", (F.col("n_found") / F.col("size")).alias("containment"), "n_found", "first_word").where(F.col("containment") >= containment)


def oracle(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL: exact containment without any retrieval."""
    shingles = template_shingles(templates)
    values = ", ".join(f"('{n}', {k}, '{x}')" for n, k, x in shingles)
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(SHINGLE))
    return f"""
WITH t(license, number, shingle) AS (VALUES {values}),
size AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT DISTINCT doc_id, text FROM documents),
s AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM d),
e AS (SELECT doc_id, text, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM s WHERE len(w) >= {SHINGLE}),
g AS (SELECT doc_id, text, i, {gram} AS shingle FROM e),
f AS (SELECT doc_id, text, license, count(DISTINCT number) AS n_found, min(i) - 1 AS first_word FROM g JOIN t USING (shingle) GROUP BY ALL)
SELECT doc_id, license, n_found / n AS containment, n_found, first_word FROM f JOIN size USING (license) WHERE n_found / n >= {containment}"""
