"""License scans with DataFrame functions alone: MinHash bands over windows retrieve templates, containment verifies.

Texts are lower-cased and cut into words; a shingle is the hash of five of them.
Windows are runs of shingles, of the power of two next to a template's number of
shingles, at an eighth of a window's step, so that whatever holds a template is
nearly aligned with a window.  A window and a template that share one of
``BANDS`` minima meet in a join; a match stands where the text beside the window
holds at least ``PERCENT`` of the template's shingles.

How sure retrieval is follows from the settings: at 80 % containment, in a window
of up to twice the template's size and a sixteenth out of line, the sets'
similarity is at least 0.29, and 1 - (1 - 0.29)^40 is above 0.999998.

Only texts and windows that hold some shingle of some template can match any, so
the rest is passed over at once: texts without any of the words that every
template shingle needs (a small hitting set found on the driver), then texts
without a template's shingle, then windows without one.

Defined cases: null and empty texts and texts of fewer than five words match
nothing; rows of one id are one document, which has the licenses of all of them;
templates of fewer than five words, or of more than ``MOST_SHINGLES`` in all, are
not allowed; the result's columns are
fixed, whatever other columns there are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import let, local_table

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GNU_BODY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

# fixed values: notices and short license texts, in the wording of their authors
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_BODY),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GNU_BODY),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

WORDS, PERCENT, BANDS = 5, 80, 40
#: Shingles of all templates together, at most: they are broadcast, 8 bytes each for the lookup and 330 for the bands.
MOST_SHINGLES = 1 << 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def anchors(texts: list[str], percent: int = PERCENT) -> list[str]:
    """Words of which every text that matches a template has at least one.

    A match holds all but a few of a template's shingles, so the words need not be
    in every shingle, but in one more than those few.
    """
    sets = [{tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} for w in map(_words, texts)]
    short = [len(s) - -(-len(s) * percent // 100) + 1 for s in sets]
    chosen: list[str] = []
    while any(n > 0 for n in short):
        gain = Counter()
        for s, n in zip(sets, short):
            own = Counter(word for shingle in s for word in set(shingle))
            for word, times in own.items():
                gain[word] += min(times, max(n, 0))
        # rare words are long ones as a rule
        best = max(gain, key=lambda word: (gain[word] > 0 and len(word) >= 5, gain[word], len(word), word))
        chosen.append(best)
        short = [n - sum(best in shingle for shingle in s) for s, n in zip(sets, short)]
        sets = [{shingle for shingle in s if best not in shingle} for s in sets]
    return [w for w in chosen if not any(v != w and v in w for v in chosen)]


def _hashes(words: Column) -> Column:
    """Shingle hashes of a word array; empty if it is too short."""

    def made(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - WORDS + 1, F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) >= WORDS, every).otherwise(F.array().cast("array<bigint>"))

    return let(words, made)


def _marks(every: Column, known: Column) -> Column:
    """Positions of the shingles that some template has."""
    at = lambda x, shared: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.array_contains(shared, F.get(x, i)))
    held = lambda x, shared: F.when(F.size(shared) > 0, at(x, shared)).otherwise(F.array().cast("array<int>"))
    return let(every, lambda x: let(F.array_intersect(x, known), lambda shared: held(x, shared)))


def _minima(window: Column) -> Column:
    return let(window, lambda w: F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.array_min(F.transform(w, lambda h: F.xxhash64(h, i)))))


def _span(size: int) -> int:
    span = 1
    while span < size:
        span *= 2
    return span


def prepared(spark: SparkSession, templates: list[tuple[str, str]], percent: int) -> tuple[DataFrame, list[str], DataFrame, list[int]]:
    """The templates with their shingles and minima, the anchor words, one row of all their shingles, and the window sizes."""
    if any(len(_words(t)) < WORDS for _, t in templates):
        raise ValueError(f"a template needs at least {WORDS} words")
    rows = [(i, name, _words(t), _span(len(_words(t)) - WORDS + 1)) for i, (name, t) in enumerate(templates)]
    table = local_table(spark, rows, "template int, license string, words array<string>, span int").withColumn("wanted", F.array_distinct(_hashes(F.col("words")))).withColumn("minima", _minima(F.col("wanted"))).drop("words")
    if sum(len(r[2]) for r in rows) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} words in all must be dealt to several scans")
    known = table.select(F.explode("wanted").alias("h")).agg(F.collect_set("h").alias("lookup"))
    return table, anchors([t for _, t in templates], percent), known, sorted({r[3] for r in rows})


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, license, template, first shingle of the window and share (of 1) for every template found in a text."""
    spark = docs.sparkSession
    table, words_needed, known, spans = prepared(spark, templates or TEMPLATES, percent)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("low"))
    near = own.filter(F.exists(F.array(*map(F.lit, words_needed)), lambda w: F.contains(F.col("low"), w)))
    # one row beside each text, so that a large set of templates is not a part of the plan
    near = near.crossJoin(F.broadcast(known))
    words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    cut = let(_hashes(words), lambda every: F.struct(every.alias("all"), _marks(every, F.col("lookup")).alias("marks")))
    # explode() also keeps the arrays from being computed again where later lambdas use them
    marked = near.select("id", F.explode(F.array(cut)).alias("cut")).filter(F.size("cut.marks") > 0).select("id", "cut.all", "cut.marks")
    sized = marked.select("id", "all", "marks", F.explode(F.array(*map(F.lit, spans))).alias("span"))
    step = F.greatest(F.floor(F.col("span") / 8), F.lit(1)).cast("int")
    # starts at multiples of the step whose windows hold a mark; also those that begin before the text does
    first, last = (lambda i: F.ceil((i - F.col("span") + 1) / step).cast("int")), (lambda i: F.floor(i / step).cast("int"))
    starts = F.array_distinct(F.flatten(F.transform("marks", lambda i: F.transform(F.sequence(first(i), last(i)), lambda k: k * step))))
    windows = sized.select("id", "all", "span", F.explode(starts).alias("start"))
    shown = F.slice("all", F.greatest("start", F.lit(0)) + 1, F.greatest(F.least(F.col("start") + F.col("span"), F.size("all")) - F.greatest("start", F.lit(0)), F.lit(0)))
    beside = F.slice("all", F.greatest(F.col("start") - step, F.lit(0)) + 1, F.col("span") + 2 * step)
    banded = windows.select("id", "span", "start", F.array_distinct(beside).alias("beside"), _minima(shown).alias("minima"))
    met = banded.select("id", "span", "start", "beside", F.posexplode("minima").alias("band", "low"))
    keyed = table.select("template", "license", "span", "wanted", F.posexplode("minima").alias("band", "low"))
    pairs = met.join(F.broadcast(keyed), ["span", "band", "low"])
    share = F.size(F.array_intersect("beside", "wanted")) / F.size("wanted")
    found = pairs.select("id", "license", "template", "start", share.alias("share")).filter(F.col("share") * 100 >= percent)
    best = found.groupBy("id", "license", "template").agg(F.max("share").alias("share"), F.min("start").alias("start"))
    return best.withColumnRenamed("id", id_col)


def report(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: its id, the licenses found (sorted, comma-joined, "" if none) and how many templates."""
    found = matches(docs, templates, id_col=id_col, text_col=text_col, percent=percent)
    per = found.groupBy(F.col(id_col).alias("__id")).agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_templates"))
    rows = docs.select(F.col(f"`{id_col}`")).join(per, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return rows.select(id_col, F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"))
