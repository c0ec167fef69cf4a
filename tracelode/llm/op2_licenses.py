"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates.

Units are the whole text, its paragraphs and its lines. A template is a candidate for a unit only if the unit's
size lets it reach the threshold and if the unit has one of the template's anchors: with so many of n bigrams
needed, one of any n - needed + 1 must be there, so as many rarest bigrams' first words are looked for.
``scan_passages`` takes any run of words as a unit, so notices over several paragraphs and inside a line are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, text_id

THRESHOLD = 0.8
# Public short notices and licence texts, by SPDX identifier.
TEMPLATES = {
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        'in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def normal(text: Column) -> Column:
    """Lower case, letters a-z and digits only, single spaces; line breaks stay."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def words_of(normalised: Column) -> Column:
    return F.split(F.btrim(normalised, F.lit(" \n")), "[ \n]+")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; none below two words."""
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n, F.lit(0))), F.slice(words, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def templates(spark: SparkSession, texts: dict[str, list[str]], threshold: float) -> DataFrame:
    """One row per template: license, template (number), grams, n, anchors (words one of which must occur)."""
    rows = [(name, i, text) for name, many in texts.items() for i, text in enumerate(many)]
    t = spark.createDataFrame(rows, "license string, template int, text string").select("license", "template", bigrams(words_of(normal(F.col("text")))).alias("grams"))
    t = t.withColumn("n", F.size("grams"))
    needed = F.ceil(F.lit(threshold / (2 - threshold)) * F.col("n") - 1e-9)
    # the bigrams with the longest first words serve as the rare ones
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct((-F.length(F.substring_index(g, " ", 1))).alias("l"), g.alias("g"))))
    rare = F.transform(ranked, lambda s: F.substring_index(s["g"], " ", 1))
    return t.withColumn("anchors", F.array_distinct(F.slice(rare, F.lit(1), (F.col("n") - needed + 1).cast("int")))).where("n > 0")


def scan_texts(texts: DataFrame, threshold: float = THRESHOLD, licences: dict[str, list[str]] | None = None) -> DataFrame:
    """``text_key, unit, unit_no, license, dice``: the best licence of each unit of the texts that reaches the threshold.

    ``text_key`` is the hash of the text. Ties go to the smaller licence name.
    """
    known = kept(templates(texts.sparkSession, licences or TEMPLATES, threshold), "licence-templates")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    most = (known.agg(F.max("n").alias("n")).collect()[0]["n"] or 0) * high
    # only a text with an anchor of some template is cut into units
    anchors = F.lit(sorted({w for row in known.select("anchors").collect() for w in row["anchors"]}))
    met = texts.where(F.arrays_overlap(words_of(normal(F.col("text"))), anchors))
    base = met.select(text_id(F.col("text")).alias("text_key"), normal(F.col("text")).alias("t"))
    unit = lambda kind, no, value: F.struct(F.lit(kind).alias("unit"), no.cast("int").alias("unit_no"), value.alias("u"))
    many = lambda kind, mark: F.when(
        F.col("t").rlike(mark), F.transform(F.split("t", mark), lambda part, i: unit(kind, i, part))
    ).otherwise(F.array().cast("array<struct<unit:string,unit_no:int,u:string>>"))
    units = base.select(
        "text_key",
        F.explode(F.concat(F.array(unit("text", F.lit(0), F.col("t"))), many("paragraph", "\n *\n"), many("line", "\n"))).alias("s"),
    ).select("text_key", "s.*")
    words = units.select("text_key", "unit", "unit_no", words_of(F.col("u")).alias("w"))
    # every distinct word but one starts a bigram of its own, so few words are left before bigrams are made
    words = words.withColumn("parts", F.array_distinct("w")).where((F.size("w") >= 2) & (F.size("parts") - 1 <= F.lit(most)))
    own = words.select("text_key", "unit", "unit_no", "parts", bigrams(F.col("w")).alias("own")).where(F.size("own") <= F.lit(most))
    anchored = known.select("license", "template", "n", F.explode("anchors").alias("word"))
    met = own.select("*", F.explode("parts").alias("word")).drop("parts").join(F.broadcast(anchored), "word")
    met = met.where(F.size("own").between(F.lit(low) * F.col("n") - 1e-9, F.lit(high) * F.col("n") + 1e-9))
    pairs = met.join(F.broadcast(known.select("license", "template", "grams")), ["license", "template"])
    shared = F.size(F.array_intersect("own", "grams"))
    pairs = pairs.withColumn("dice", F.lit(2.0) * shared / (F.size("own") + F.col("n"))).where(F.col("dice") >= threshold)
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("license")))
    found = pairs.groupBy("text_key", "unit", "unit_no").agg(best.alias("b"))
    return found.select("text_key", "unit", "unit_no", F.col("b.license").alias("license"), (-F.col("b.d")).alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, licences: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per unit of a document that matches a licence: doc_id, unit, unit_no, license, dice.

    ``unit`` is ``text``, ``paragraph`` or ``line``, numbered from 0; a text without breaks is only a ``text``.
    Null, empty and one-word units match nothing; null ids stay null; repeated rows are reported each; texts of any length
    are scanned whole; only doc_id and text are read. The templates are a parameter (a short list, broadcast).
    """
    found = kept(scan_texts(docs.select("text"), threshold, licences), "licence-units")
    keyed = docs.select("doc_id", text_id(F.col("text")).alias("text_key"))
    return keyed.join(found, "text_key").select("doc_id", "unit", "unit_no", "license", "dice")


def oracle_sql(threshold: float = THRESHOLD, licences: dict[str, list[str]] | None = None) -> str:
    """DuckDB SQL for the rows of ``scan`` over ``documents``."""
    quoted = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{name}', '{quoted(text)}')" for name, many in (licences or TEMPLATES).items() for text in many)
    norm = "regexp_replace(lower({0}), '[^a-z0-9' || chr(10) || ']+', ' ', 'g')"
    grams = (
        "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    )
    split = "list_filter(regexp_split_to_array({0}, '[ ' || chr(10) || ']+'), lambda x: x <> '')"
    return f"""
WITH t(license, body) AS (VALUES {rows}),
t2 AS (SELECT license, {split.format(norm.format("body"))} AS w FROM t),
t3 AS (SELECT license, {grams} AS g FROM t2),
d AS (SELECT doc_id, row_number() OVER () AS r, {norm.format("text")} AS x FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, r, 'text' AS unit, 0 AS unit_no, x AS u FROM d
  UNION ALL
  SELECT doc_id, r, 'line', CAST(unnest(range(len(l))) AS INTEGER), unnest(l)
  FROM (SELECT doc_id, r, string_split(x, chr(10)) AS l FROM d WHERE contains(x, chr(10)))
  UNION ALL
  SELECT doc_id, r, 'paragraph', CAST(unnest(range(len(l))) AS INTEGER), unnest(l)
  FROM (SELECT doc_id, r, regexp_split_to_array(x, chr(10) || ' *' || chr(10)) AS l FROM d WHERE regexp_matches(x, chr(10) || ' *' || chr(10)))
),
u2 AS (SELECT doc_id, r, unit, unit_no, {split.format("u")} AS w FROM u),
u3 AS (SELECT doc_id, r, unit, unit_no, {grams} AS g FROM u2 WHERE len(w) >= 2),
p AS (
  SELECT doc_id, r, unit, unit_no, license, CAST(2 AS DOUBLE) * len(list_intersect(u3.g, t3.g)) / (len(u3.g) + len(t3.g)) AS dice
  FROM u3, t3 WHERE len(u3.g) BETWEEN 0.5 * len(t3.g) AND 2 * len(t3.g)
)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license, dice FROM p WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY r, unit, unit_no ORDER BY dice DESC, license) = 1
"""


_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: The templates with the BSD texts to their end; the query and its SQL keep TEMPLATES.
WHOLE = TEMPLATES | {name: [*TEMPLATES[name], TEMPLATES[name][0] + _DISCLAIMER] for name in ("BSD-2-Clause", "BSD-3-Clause")}


def _windows(grams: list[str], at: list[int], wanted: frozenset[str], threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """start, end (of bigrams), shared, own: the tight windows of a text that reach the threshold with a template.

    ``at`` are the positions of the template's bigrams. A window is tight if its first bigram does not return in it and its
    last one is new in it; any other window holds a tight one with the same shared bigrams and no more of its own.
    """
    n = len(wanted)
    most, needed = (2 - threshold) / threshold * n + 1e-9, threshold / (2 - threshold) * n - 1e-9
    for start in at:
        own, shared = {grams[start]}, 1
        if shared >= needed and 2 >= threshold * (1 + n):
            yield start, start, 1, 1
        for end in range(start + 1, len(grams)):
            g = grams[end]
            if g in own:
                if g == grams[start]:
                    break
                continue
            own.add(g)
            if len(own) > most:
                break
            if g in wanted:
                shared += 1
                if shared >= needed and 2 * shared >= threshold * (len(own) + n) - 1e-9:
                    yield start, end, shared, len(own)
                if shared == n:
                    break


def passages(text: str, known: list[tuple[str, frozenset[str]]], threshold: float) -> list[tuple[int, int, int, int, str, float]]:
    """first_word, last_word, first_line, last_line, license, dice of the passages of a normalised text, in its order."""
    words, lines = [], []
    for no, line in enumerate(text.split("\n")):
        found = line.split()
        words += found
        lines += [no] * len(found)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    have, good = set(grams), []
    for name, wanted in known:
        if len(have & wanted) >= threshold / (2 - threshold) * len(wanted) - 1e-9:
            at = [i for i, g in enumerate(grams) if g in wanted]
            for a, b, shared, own in _windows(grams, at, wanted, threshold):
                good.append((own + len(wanted) - 4 * shared, name, a, b, 2.0 * shared / (own + len(wanted))))
    out: list[tuple[int, int, int, int, str, float]] = []
    taken = bytearray(len(words))
    for _, name, a, b, dice in sorted(good):
        if not any(taken[a : b + 2]):
            taken[a : b + 2] = b"\1" * (b + 2 - a)
            out.append((a, b + 1, lines[a], lines[b + 1], name, dice))
    return sorted(out)


def scan_passages(docs: DataFrame, threshold: float = THRESHOLD, licences: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per passage that matches a licence: doc_id, first_word, last_word, first_line, last_line, license, dice.

    A passage is any run of words, over line and paragraph breaks and inside a line; words (of the normalised text) and lines count
    from 0. Of windows that overlap, the one with the most shared bigrams less those that only one side has stays, then the smaller
    name and place. Nulls and repeated rows as in ``scan``.
    """
    rows = templates(docs.sparkSession, licences or WHOLE, threshold).select("license", "grams", "anchors").collect()
    known = sorted(((r.license, frozenset(r.grams)) for r in rows), key=lambda k: (k[0], sorted(k[1])))
    anchors = F.lit(sorted({w for r in rows for w in r.anchors}))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, p) for i, t in enumerate(batch.column(1)) for p in passages(t.as_py(), known, threshold)]
            ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            values = [pa.array([p[k] for _, p in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", "first_word", "last_word", "first_line", "last_line", "license", "dice"])

    texts = docs.select("doc_id", normal(F.col("text")).alias("t")).where(F.arrays_overlap(words_of(F.col("t")), anchors))
    return texts.mapInArrow(run, f"doc_id {kind}, first_word int, last_word int, first_line int, last_line int, license string, dice double")
