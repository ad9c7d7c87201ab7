"""License scan in DataFrame functions: MinHash bands over text windows retrieve templates, shingle containment verifies."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public notices and license texts (opening paragraphs of the long ones), by name.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
}

WORD = r"[^\p{L}\p{N}]+"  # what separates words


def template_words(text: str) -> list[str]:
    """The words that ``words_of`` finds, for the short fixed templates."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Distinct hashes of the k-word shingles; of the whole sequence if it has 1 to k - 1 words."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))))


def collision_probability(jaccard: float, bands: int, rows: int) -> float:
    """Chance that two sets of that similarity share a band."""
    return 1 - (1 - jaccard ** rows) ** bands


def anchors(templates: dict[str, str], k: int, least: float) -> dict[str, set[str]]:
    """For every template a set of words of which any ``least`` of its shingles must contain one.

    More than 1 - least of the shingles contain a word of the set, so a window with ``least`` of them cannot be without.
    Words are taken by how many shingles they add, long words and words other templates use first, so that few are needed.
    """
    out: dict[str, set[str]] = {}
    used: set[str] = set()
    for name, text in sorted(templates.items(), key=lambda t: len(t[1])):
        words = template_words(text)
        grams = {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))}
        goal, chosen, open_ = (1 - least) * len(grams), set(), set(grams)
        while len(grams) - len(open_) <= goal:
            gain = Counter(w for g in open_ for w in set(g))
            best = max(gain, key=lambda w: (len(w) > 5, w in used, gain[w], len(w), w))
            chosen.add(best)
            open_ = {g for g in open_ if best not in g}
        out[name] = chosen
        used |= chosen
    return out


def window_class(words: int) -> tuple[int, int]:
    """(longest template, step) of a template's length class; windows have their sum of words, one every step."""
    longest = 5
    while longest < words:
        longest += max(1, longest // 4)
    return longest, max(1, longest // 4)


def least_similarity(words: int, k: int, least: float) -> float:
    """Smallest Jaccard similarity between a template of so many words and the window that holds an occurrence."""
    longest, step = window_class(words)
    template, window = max(words - k + 1, 1), longest + step - k + 1
    return least * template / (window + (1 - least) * template)


def _signature(shingles: Column, bands: int, rows: int) -> Column:
    """One number per band: the hash of its ``rows`` least shingle hashes under different orders."""
    def low(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*[F.xxhash64(*[low(b * rows + r) for r in range(rows)], F.lit(b)) for b in range(bands)])


def _template_table(spark: SparkSession, templates: dict[str, str], k: int, bands: int, rows: int) -> DataFrame:
    """(license, longest, shingles, band) of the fixed templates, four columns of literals: some KB whatever the input."""
    def row(name: str, text: str) -> Column:
        longest, _ = window_class(len(template_words(text)))
        return F.struct(F.lit(name).alias("license"), F.lit(text).alias("text"), F.lit(longest).alias("longest"))

    one = spark.range(1).select(F.explode(F.array(*[row(n, t) for n, t in templates.items()])).alias("t")).select("t.*")
    hashed = one.select("license", "longest", shingles_of(words_of(F.col("text")), k).alias("template"))
    return hashed.select("license", "longest", "template", F.explode(F.array_distinct(_signature(F.col("template"), bands, rows))).alias("band"))


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, k: int = 5, bands: int = 24, rows: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start_word, containment): every license found in a document, with its best window.

    Windows of a length class overlap so far that every occurrence of its templates lies whole in one. A window's MinHash bands are looked up among
    the templates' bands; for the default bands and these lengths a window with ``least`` of a template's
    shingles is retrieved with probability over 0.999 (``collision_probability`` of ``least_similarity``). Then the
    share of the template's k-word shingles in the window is counted, and ``least`` of them is a match.

    Only windows around a template's anchor words are made (``anchors``), which loses none: a match must contain one. All of it is
    built-in functions, so nothing leaves the JVM. One shuffle, of the matches, by document and license; the templates are
    constants of some KB and are broadcast.

    Null and empty texts match nothing; texts of under k words only a template of the same words; a null id stays null and its
    matches are reported together, as are those of rows with equal ids; ties of containment take the first window; an
    empty table gives no row; other columns are ignored.
    """
    templates = templates or TEMPLATES
    spark = df.sparkSession
    words_in = anchors(templates, k, least)
    by_class: dict[tuple[int, int], set[str]] = {}
    for name, text in templates.items():
        by_class.setdefault(window_class(len(template_words(text))), set()).update(words_in[name])
    any_of = sorted(set().union(*by_class.values()))

    # a document without any of the anchor words has no match
    low = F.lower(F.col("text"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .filter(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in _shortest(any_of)]))
    docs = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    n = F.size("words")

    def places(longest: int, step: int, near: set[str]) -> Column:
        """Windows (longest, step, number) of a class that contain one of its anchor words."""
        length = longest + step
        found = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), i).isin(*sorted(near)))
        first = lambda p: F.greatest(F.floor((p - length) / F.lit(step)) + 1, F.lit(0))
        numbers = F.array_distinct(F.flatten(F.transform(found, lambda p: F.sequence(first(p), F.floor(p / F.lit(step))))))
        return F.transform(numbers, lambda j: F.struct(F.lit(longest).alias("longest"), F.lit(length).alias("length"),
                                                       (j * step).cast("int").alias("start")))

    classes = F.flatten(F.array(*[places(*c, near) for c, near in sorted(by_class.items())]))
    windows = docs.filter(n > 0).select("doc_id", "words", F.explode(classes).alias("w"))
    windows = windows.select("doc_id", "w.longest", F.col("w.start").alias("start_word"),
                             shingles_of(F.slice("words", F.col("w.start") + 1, F.col("w.length")), k).alias("shingles"))
    banded = windows.select("*", F.explode(F.array_distinct(_signature(F.col("shingles"), bands, rows))).alias("band"))
    table = _template_table(spark, templates, k, bands, rows)
    candidates = banded.join(F.broadcast(table), ["longest", "band"])
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    matches = candidates.select("doc_id", "license", "start_word", share.alias("containment")).filter(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("start_word")).alias("at")))
    return matches.groupBy("doc_id", "license").agg(best.alias("b")).select(
        "doc_id", "license", (-F.col("b.at")).alias("start_word"), F.col("b.containment").alias("containment"))


def _shortest(words: list[str]) -> list[str]:
    """Without words that contain another one."""
    return [w for w in words if not any(o != w and o in w for o in words)]
