"""Licence notices in documents, found by diagonal voting.

Templates are the words of known notices. Every run of K words of every document is hashed and joined
with the template positions that have the same hash; each hit votes for a diagonal (place in the document
minus place in the template). A notice with at least COVER of the template's words in order and at most
as many foreign words between as it may miss (and one) has its votes within a known range of diagonals, and a least number of
them, as a missing word breaks K runs and a foreign one K - 1; with K = 2 at least one is left for any
template. Where a range has that many, every place at which the notice can begin is aligned with the template, and the best
spans that do not overlap are reported.

Defined results: a null, empty or wordless text has no row. Repeated rows and repeated ids are one
document each row but share their id in the result; equal result rows stand once. A null id is reported as null.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm._fit import small
from loomtext.llm._text import Words, blocks, flat, signed
from loomtext.session import spread, table, written

K, COVER = 2, 0.8

TEMPLATES = {
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-mit": "Released under the MIT License.",
    "notice-gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-cc-by-4.0": "Licensed under CC BY 4.0.",
    "notice-cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "notice-cc-by-international": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice-bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "notice-all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_RESULT = "doc_id bigint, template string, first_word int, last_word int, matched int, template_words int"


def _words(text: str) -> Words:
    return Words(*flat(pa.array([text.lower()])))


def template_rows(templates: dict[str, str], k: int = K) -> list[tuple[int, int, int]]:
    """(hash, template number, position) of every run of every template; templates shorter than k are refused."""
    rows = []
    for number, text in enumerate(templates.values()):
        words = _words(text)
        if len(words.hash) < k:
            raise ValueError(f"a template needs at least {k} words")
        value, at = words.grams(k)
        rows += [(int(h), number, int(p)) for h, p in zip(signed(value), at)]
    return rows


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """One row for each document with the hashes of all its runs, in order; row_id tells repeated ids apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column(2))
            for i, j in blocks(off, 2_000_000):
                words = Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                value, at = words.grams(k)
                ends = np.searchsorted(words.doc[at], np.arange(words.n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(value)))], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, row_id bigint, grams array<bigint>")


def aligned(words: list, template: list) -> tuple[int, int, int]:
    """Most template words met in order, and the first and last place in ``words`` where that happens."""
    # longest common subsequence as bit vectors over the template; the rows are kept to walk back
    where: dict = {}
    for j, x in enumerate(template):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(template)) - 1
    row, rows = full, []
    for x in words:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    matched = len(template) - row.bit_count()
    i, j, first, last = len(words) - 1, len(template) - 1, 0, 0
    seen = 0
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:  # the template word j adds nothing here
            j -= 1
        elif i and not rows[i - 1] >> j & 1:  # nor did this word of the document bring it
            i -= 1
        else:
            last, first, seen = (i if not seen else last), i, seen + 1
            i, j = i - 1, j - 1
    return matched, first, last


def _limits(n: int, k: int, cover: float) -> tuple[int, int, int, int]:
    """Of a template of n words: most missing words, most foreign words, how far apart a notice's diagonals are, least votes."""
    missing, foreign = n - math.ceil(cover * n - 1e-9), int(n * (1 - cover) + 1 + 1e-9)
    # a missing word breaks k runs, a foreign one k - 1
    return missing, foreign, missing + foreign, max(1, n - k + 1 - k * missing - (k - 1) * foreign)


def notices(words: list, template: list, starts: set[int], cover: float) -> list[tuple[int, int, int, int]]:
    """For each of ``starts`` at which a notice can begin, the best one: score (less is better), first and last place, words met."""
    n = len(template)
    missing, foreign, _, _ = _limits(n, 1, cover)
    least = n - missing
    where: dict = {}
    for j, x in enumerate(template):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << n) - 1
    heads = set(template[: missing + 1])
    known = np.cumsum([0] + [x in where for x in words])
    out = []
    for i in sorted(starts):
        end = min(len(words), i + n + foreign)
        if words[i] not in heads or known[end] - known[i] < least:
            continue
        row, best = full, None
        for j in range(i, end):
            hit = row & where.get(words[j], 0)
            if not hit:
                continue
            row = ((row + hit) | (row - hit)) & full
            matched = n - row.bit_count()
            strange = j - i + 1 - matched
            if matched >= least and strange <= matched * (1 - cover) + 1 + 1e-9:
                best = min(best or (n, 0, 0, 0), (n - 2 * matched + strange, i, j, matched))
        if best:
            out.append(best)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, cover: float = COVER) -> DataFrame:
    """Verified notices: document, template, first and last word of the span, template words met and in all."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    places = spark.createDataFrame(template_rows(templates, k), "gram bigint, template int, at int")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text != ''")
    # a row is known by its id and its text's hash: equal rows are one
    source = source.withColumn("row_id", F.xxhash64("text"))
    grams = _grams(source.select("doc_id", "row_id", "text"), k)
    hits = grams.select("doc_id", "row_id", F.posexplode("grams").alias("place", "gram")).join(small(places), "gram")
    votes = hits.groupBy("doc_id", "row_id", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    limits = [_limits(len(_words(t).hash), k, cover) for t in templates.values()]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    # the diagonals of one notice lie within ``drift``: by a step of half a place more, they are a range of 1
    near = W.partitionBy("doc_id", "row_id", "template").orderBy(F.col("diagonal") / (of([drift for *_, drift, _ in limits]) + 0.5)).rangeBetween(0, 1)
    spans = votes.withColumn("around", F.sum("votes").over(near)).filter(F.col("around") >= of([need for *_, need in limits]))
    merged = written(spans.select("doc_id", "row_id", "template", "diagonal"), "spans")
    return _verified(source, merged, templates, k, cover)


def _verified(source: DataFrame, spans: DataFrame, templates: dict[str, str], k: int, cover: float) -> DataFrame:
    names = list(templates)
    lists = [_words(t).hash.tolist() for t in templates.values()]
    limits = [_limits(len(x), k, cover) for x in lists]
    schema = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("matched", pa.int32()), ("template_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat(batch.column("text"))
            words = Words(raw, off)
            out = []
            for d, doc_id, found in zip(range(len(off) - 1), batch.column("doc_id").to_pylist(), batch.column("found").to_pylist()):
                own = words.hash[words.first[d] : words.first[d + 1]].tolist()
                verified = []
                begins: dict[int, set[int]] = {}
                for x in found:
                    missing, _, drift, _ = limits[x["template"]]
                    begins.setdefault(x["template"], set()).update(range(max(0, x["diagonal"] - drift), min(len(own), x["diagonal"] + drift + missing + 1)))
                for number, starts in begins.items():
                    for score, first, last, matched in notices(own, lists[number], starts, cover):
                        verified.append((score, number, first, last, matched))
                taken: list[tuple[int, int]] = []
                for _, number, first, last, matched in sorted(verified):
                    if all(last < a or first > b for a, b in taken):
                        taken.append((first, last))
                        out.append((doc_id, names[number], first, last, matched, len(lists[number])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    grouped = spans.groupBy("doc_id", "row_id").agg(F.collect_list(F.struct("template", "diagonal")).alias("found"))
    grouped = written(grouped.withColumnRenamed("doc_id", "id"), "found")
    near = source.join(small(grouped.select("row_id").distinct()), "row_id", "left_semi")
    near = near.join(grouped, (near.row_id == grouped.row_id) & near.doc_id.eqNullSafe(grouped.id))
    return near.select("doc_id", "text", "found").mapInArrow(run, _RESULT).distinct()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))
