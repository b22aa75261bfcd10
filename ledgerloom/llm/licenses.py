"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies them. DataFrame functions only.

Texts and templates are 5-word shingles of lower-case words without marks at their ends. A template of
n shingles is cut into all its windows of L shingles, L by LEVELS; a text into overlapping windows of
each L, a stride apart. A window's band is the least of its shingle hashes under one of BANDS bit masks,
one row a band. A text that holds a template holds one of its windows exactly, as n >= L + stride - 1,
and then every band agrees; at a window similarity of 0.75 a band is met with probability
1 - 0.25**4 = 0.996. A retrieved template counts if at least CONTAINMENT percent of its distinct
shingles are among the text's.

Defined results: null, empty and short texts hold no license; repeated rows are scanned alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words_of

WORDS, CONTAINMENT = 5, 75
#: (shingles of a window, stride, fewest shingles of a template)
LEVELS = ((16, 8, 23), (4, 2, 5), (1, 1, 1))
BANDS = 4
MASKS = (0, 0x5BD1E995A3C4F217, 0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5)
MARKS = ".,;:()[]\"'!?"


@dataclass(frozen=True)
class Template:
    name: str
    text: str


#: Notices and short licenses as they are worded.
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template(
        "MIT-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "BSD-2-Clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    Template(
        "ISC-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)


def shingles(text: Column) -> Column:
    """array<long>: hashes of all runs of five words, in order."""
    words = F.array_remove(F.transform(words_of(text), lambda w: F.lower(F.trim(w, F.lit(MARKS)))), "")
    return let(
        words,
        lambda w: F.when(F.size(w) < WORDS, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        ),
    )


def _windows(h: Column, size: int, stride: int) -> Column:
    """Starts of the windows of ``h``, the last one flush with its end."""
    last = F.greatest(F.size(h) - size, F.lit(0))
    return F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    )


def bands(h: Column, size: int, stride: int) -> Column:
    """array<long> of band keys; a window of one shingle is its own band."""
    if size == 1:
        return h
    masks = F.array(*map(F.lit, MASKS[:BANDS]))
    return F.flatten(
        F.transform(
            _windows(h, size, stride),
            lambda i: let(F.slice(h, i + 1, size), lambda w: F.transform(masks, lambda m: F.xxhash64(m, F.array_min(F.transform(w, lambda x: x.bitwiseXOR(m)))))),
        )
    )


def index(spark: SparkSession, templates: Sequence[Template] = TEMPLATES) -> tuple[dict[int, list[str]], dict[str, list[int]]]:
    """Band key to template names, and each template's shingles. Templates are few; the same expressions hash them as the texts."""
    rows = spark.createDataFrame([(t.name, t.text) for t in templates], "name string, text string").select("name", shingles(F.col("text")).alias("h"))
    cut = F.array().cast("array<long>")
    for size, _, least in LEVELS[::-1]:
        cut = F.when(F.size("h") >= least, bands(F.col("h"), size, 1)).otherwise(cut)
    keys: dict[int, list[str]] = {}
    sets: dict[str, list[int]] = {}
    for r in rows.select("name", F.array_distinct("h").alias("h"), F.array_distinct(cut).alias("keys")).collect():
        sets[r["name"]] = list(r["h"])
        for k in r["keys"]:
            keys.setdefault(k, []).append(r["name"])
    return keys, sets


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``docs`` with licenses: array<struct<name, percent>> of the templates that their whole texts hold. No shuffle."""
    keys, sets = index(docs.sparkSession, templates)
    lookup = F.create_map(*[x for k, names in sorted(keys.items()) for x in (F.lit(k), F.array(*map(F.lit, names)))])
    content = F.create_map(*[x for name, h in sorted(sets.items()) for x in (F.lit(name), F.array(*map(F.lit, h)))])

    def fetched(h: Column) -> Column:
        hit = F.concat(*[F.filter(bands(h, size, stride), lambda k: k.isin(sorted(keys))) for size, stride, _ in LEVELS])
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(hit), lambda k: F.element_at(lookup, k))))

    def verified(h: Column) -> Column:
        def percent(name: Column) -> Column:
            own = F.element_at(content, name)
            return let(own, lambda o: 100.0 * F.size(F.array_intersect(o, h)) / F.size(o))

        found = F.transform(fetched(h), lambda n: F.struct(n.alias("name"), percent(n).alias("percent")))
        return F.sort_array(F.filter(found, lambda x: x["percent"] >= CONTAINMENT))

    return docs.drop("licenses").withColumn("licenses", let(shingles(F.col("text")), verified))
