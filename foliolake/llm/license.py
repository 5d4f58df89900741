"""License notices by MinHash bands over overlapping windows, in DataFrame functions only.

Templates are the notices below and the full texts in the folder licenses/.

1. Anchors. Of each template some words are chosen so that fewer than 80 of 100 of its
   shingles do without them; a match then has one, and other documents and windows are
   left aside before any hashing.
2. Windows. Templates of like length share a class. Its windows are as long as its longest
   template plus one stride (a quarter of that), so every run of a template's length lies
   within a window. Each window with an anchor is taken once, whatever the number of
   anchors; texts too short for four fifths of the class's least template have none.
3. Bands. A window's BANDS smallest hashes, one to a band, are looked up among the
   templates' (a broadcast table, bounded by the templates). A matching window and its
   template have a Jaccard similarity of 0.4 at least, so all bands miss with a
   probability below 0.6^BANDS < 5e-6.
4. The hits are verified on the full sets: at least 80 of 100 of the template's
   5-word shingles lie in the window.

Usual short wordings are looked up as exact runs of words besides, and SPDX identifier
lines by their form; templates of the caller are taken alone.

Words are runs of letters and digits, in lower case. Cases: a null or empty text matches
nothing; a template of fewer than 5 words is one shingle; rows with equal or null doc_id
count as one document's; an empty table gives an empty result; extra columns aren't read."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, PERCENT, BANDS = 5, 80, 24
BROADCAST_CHARS = 2_000_000
SPLIT = r"[^\p{L}\p{N}]+"

#: Notices as their licenses ask for them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Apache-2.0-text": '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. For the purposes of this definition,',
    "GPL-3.0-text": 'The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too. When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.',
    "BSD-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
}

@lru_cache(1)
def full_texts() -> dict[str, str]:
    """The licenses' full texts, up to the end of their terms."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return {f"{f.stem}-full": f.read_text(encoding="utf-8").split("END OF TERMS AND CONDITIONS")[0] for f in files}


#: Exact wordings, as words in lower case. A version is named where the wording has one.
_GNU = {"GPL": ("gnu general public license", "gpl", "gnu gpl"), "LGPL": ("gnu lesser general public license", "lgpl", "gnu lgpl"), "AGPL": ("gnu affero general public license", "agpl", "gnu agpl")}
_CC = {"BY": ("by", "attribution"), "BY-SA": ("by sa", "attribution sharealike"), "BY-ND": ("by nd", "attribution noderivatives"), "BY-NC": ("by nc", "attribution noncommercial"), "BY-NC-SA": ("by nc sa", "attribution noncommercial sharealike"), "BY-NC-ND": ("by nc nd", "attribution noncommercial noderivatives")}


def _phrases() -> dict[str, list[str]]:
    out = {
        "MIT-notice": ["under the mit license", "under the terms of the mit license", "under an mit license", "under mit license", "mit licensed"],
        "Apache-2.0-notice": ["apache license version 2 0", "apache license v2 0", "apache license v 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0 licensed"],
        "BSD-notice": ["under the bsd license", "under a bsd license", "under the terms of the bsd license", "bsd style license", "bsd licensed", *[f"{n} clause bsd" for n in (2, 3, 4)], *[f"bsd {n} clause" for n in (2, 3, 4)]],
        "MPL-2.0": [f"mozilla public license {v}" for v in ("version 2 0", "v 2 0", "v2 0", "2 0")] + ["mpl 2 0", "mpl v2 0"],
        "All-rights-reserved": ["all rights reserved"],
    }
    for kind, names in _GNU.items():
        for full, v in (("2.0", "2"), ("2.1", "2 1"), ("3.0", "3")):
            said = [f"{n} {w}{v}" for n in names for w in ("version ", "v", "v ", "")] + [f"version {v} of the {n}" for n in names] + [f"{kind.lower()}v{v}"]
            out[f"{kind}-{full}-notice"] = said
    for kind, (short, long) in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{kind}-{v}"] = [f"{w} {v.replace('.', ' ')}" for w in ("cc " + short, "creative commons " + long)]
    return out


PHRASES = _phrases()
_ID = r"[a-z0-9][a-z0-9.+:-]*"
SPDX = rf"spdx-license-identifier\s*[:=]\s*\(*({_ID}(?:\)*[ \t]+(?:and|or|with)[ \t]+\(*{_ID})*)"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates: dict[str, str], percent: int = PERCENT) -> list[str]:
    """Words of which every match has one. Each step takes the word that is in most of
    the shingles still to cover; words chosen before come first."""
    chosen: list[str] = []
    for text in templates.values():
        w = template_words(text)
        sets = [set(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]
        size = len({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})
        while True:
            free = [s for s in sets if not s & set(chosen)]
            if 100 * len(free) < percent * size:
                break
            chosen.append(max(sorted(set().union(*free)), key=lambda x: (min(len(x), 6), sum(x in s for s in free))))
    return chosen


def classes(templates: dict[str, str]) -> dict[str, int]:
    """Template -> length in words of the longest one of its class; within a class the
    lengths differ by a fifth at most, or by 2."""
    out, top = {}, 0
    for name, n in sorted(((k, len(template_words(t))) for k, t in templates.items()), key=lambda x: -x[1]):
        if not top or n < min(top - 2, 0.8 * top):
            top = n
        out[name] = top
    return out


def n_shingles(text: str) -> int:
    w = template_words(text)
    return len({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})


def shingles(words: str) -> Column:
    """Distinct hashes of the shingles of an array of words."""
    return F.expr(f"array_distinct(transform(sequence(1, greatest(size({words}) - {SHINGLE - 1}, 1)), i -> xxhash64(array_join(slice({words}, i, {SHINGLE}), ' '))))")


def band_values(hashes: str) -> Column:
    return F.array(*[F.expr(f"array_min(transform({hashes}, x -> xxhash64(x, {b})))") for b in range(BANDS)])


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    longest = classes(templates)
    rows = [(k, longest[k], template_words(t)) for k, t in templates.items()]
    df = spark.createDataFrame(rows, "name string, longest int, words array<string>").withColumn("want", shingles("words"))
    return df.select("name", "longest", "want", F.posexplode(band_values("want")).alias("band", "value"))


def find(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, name, containment) of each template found in a document."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES | full_texts()
    signs = anchors(templates)
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    some = F.lit(False)
    for a in signs:
        some = some | low.contains(a)
    df = docs.where(some).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(F.filter(F.split(low, SPLIT), lambda x: x != ""))).alias("words"))
    longest = classes(templates)
    least = {n: min(-(-n_shingles(t) * PERCENT // 100) for k, t in templates.items() if longest[k] == n) for n in set(longest.values())}
    grid = F.array(*[F.struct(F.lit(n).alias("longest"), F.lit(max(1, n // 4)).alias("stride"), F.lit(least[n]).alias("least")) for n in sorted(least)])
    # the grid's windows that have an anchor: by the anchors' places, not by trying all
    places = F.expr("filter(transform(words, (x, i) -> CASE WHEN x IN (" + ", ".join(f"'{a}'" for a in signs) + ") THEN i END), x -> x IS NOT NULL)")
    df = df.select("doc_id", "words", F.explode(F.array(places)).alias("places")).select("*", F.explode(grid).alias("g")).select("doc_id", "words", "places", "g.*")
    df = df.where(f"size(words) - {SHINGLE - 1} >= least OR least = 1")
    hits_of = "sequence(greatest(0, cast(ceil((p - longest - stride + 1) / stride) AS int)), cast(floor(p / stride) AS int))"
    starts = F.array_distinct(F.flatten(F.expr(f"transform(places, p -> {hits_of})")))
    df = df.select("doc_id", "longest", "stride", "words", F.explode(F.array(starts)).alias("starts"))
    df = df.select("doc_id", "longest", F.explode(F.expr("transform(starts, k -> slice(words, k * stride + 1, longest + stride))")).alias("window"))
    df = df.select("doc_id", "longest", F.explode(F.array(shingles("window"))).alias("have"))
    df = df.select("doc_id", "longest", "have", F.posexplode(band_values("have")).alias("band", "value"))
    known = _templates(spark, templates)
    # the library's own templates are bounded; a caller's are sent to every task up to a size
    small = sum(map(len, templates.values())) <= BROADCAST_CHARS
    hits = df.join(F.broadcast(known) if small else known.hint("merge"), ["longest", "band", "value"])
    hits = hits.select("doc_id", "name", (F.size(F.array_intersect("have", "want")) / F.size("want")).alias("containment"))
    return hits.where(F.col("containment") * 100 >= PERCENT - 1e-9).groupBy("doc_id", "name").agg(F.max("containment").alias("containment"))


def find_phrases(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, name) of each exact wording, and of each SPDX identifier line."""
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = docs.where(low.rlike(r"\b(?:licen|rights|commons|spdx|cc)|bsd|gpl|mpl")).select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
    df = df.select("doc_id", "low", F.explode(F.array(F.concat(F.lit(" "), F.regexp_replace("low", SPLIT, " "), F.lit(" ")))).alias("words"))
    told = F.array(*[F.when(_any(ps), F.lit(name)) for name, ps in PHRASES.items()])
    spdx = F.transform(F.regexp_extract_all("low", F.lit(SPDX), F.lit(1)), lambda x: F.concat(F.lit("SPDX "), F.regexp_replace(x, r"[.:]+$", "")))
    return df.select("doc_id", F.explode(F.array_distinct(F.concat(told, spdx))).alias("name")).where("name IS NOT NULL")


def _any(phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        # no version may follow another one: version 2 isn't 2.1
        end = r"(?! [0-9])" if p[-1].isdigit() and not re.search(r"[0-9] [0-9]$", p) else ""
        one = F.col("words").contains(f" {p} ")
        out = out | (one & F.col("words").rlike(rf" {p}(?= ){end}") if end else one)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_licenses, licenses (names in order, comma-joined)."""
    every = find(docs, templates, text).select("doc_id", "name")
    if templates is None:
        every = every.unionByName(find_phrases(docs, text)).distinct()
    found = every.groupBy(F.col("doc_id").alias("of")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("licenses"), F.count("*").alias("n_licenses"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))
