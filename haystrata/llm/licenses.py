"""Licence scan by Dice coefficient over word bigrams (operator 3, DataFrame functions only).

A text's units are its lines, its paragraphs (between blank lines) and the whole text. A unit
and a licence template are sets of bigrams of normalised words (``[a-z0-9]+`` after lower-casing
A-Z). Dice = 2 * shared / (both sizes). Dice of at least t bounds a unit's size between
t / (2 - t) and (2 - t) / t times the template's: other templates are pruned by size. The same
bound says how many of a template's bigrams a unit may lack: words are chosen that touch more
bigrams than that, and a text with none of these words' beginnings is skipped before it is cut
up. Both prunings are exact.

A notice among other words is found by windows over the whole text's words: a window starts and
ends with a bigram of the template (other ends only lower Dice), is at most (2 - t) / t times the
template's bigrams long, and every such window is scored; a template that shares too few bigrams
with the text has none. Of a template's overlapping windows the best stays. A window gives way to
a unit or another window over the same words whose licence contains its own (``covers``).

Everything is one projection of the documents: no shuffle, no Python. Null and empty texts and
texts of one word match nothing. Rows are independent. Ties between templates go to the first
name. Only the named columns are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Licence notices and short licence texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
# Words too common to guard a text by.
COMMON = frozenset("a an and any are as at be by can file for from if in is it may not of on one or other provided that the this to under use used was with without will work you either no all any".split())


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def guards(own: list[str], threshold: float) -> set[str]:
    """Beginnings of long words, or else bigrams, that touch more bigrams than a unit at the threshold may lack."""
    least = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
    left, chosen = set(own), set()
    while len(left) >= least:
        heads = {w[:6] for b in left for w in b.split() if len(w) > 5}
        touched = {h: {b for b in left if any(w.startswith(h) for w in b.split())} for h in heads} | {b: {b} for b in left}
        # a beginning of a word unless a bigram does as well
        best = max(sorted(touched), key=lambda h: (len(touched[h]), -len(COMMON.intersection(h.split())), len(h)))  # noqa: B023
        chosen.add(best)
        left -= touched[best]
    return chosen


def _flat(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, "[^a-z0-9]+", " "))


def _flat_bigrams(flat: Column) -> Column:
    w = F.split(flat, " ")
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _best(own: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The template with the highest Dice at the threshold, or null; sizes out of bounds are not compared."""
    n = F.size(own)
    scores = []
    for name, grams in templates:
        m = len(grams)
        shared = F.size(F.array_intersect(own, F.split(F.lit("|".join(grams)), "[|]")))
        fits = n.between(math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9))
        scores.append(F.when(fits, F.struct((2.0 * shared / (n + m)).alias("dice"), F.lit(name).alias("license"))))
    found = F.filter(F.array(*scores), lambda s: s.isNotNull() & (s["dice"] >= threshold))
    order = lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).otherwise(1)
    return F.get(F.array_sort(found, order), F.lit(0))


def covers(known: list[tuple[str, list[str]]], threshold: float) -> dict[str, list[str]]:
    """For each licence those, itself among them, whose template alone could match it."""
    return {b: [a for a, ga in known if len({*ga} & {*gb}) >= len(gb) * threshold / (2 - threshold) - 1e-9] for b, gb in known}


def _windows(own: Column, known: list[tuple[str, list[str]]], units: Column, threshold: float) -> Column:
    """own: the text's bigrams in order; units: matched units with first and last bigram. Windows as struct<first, last, license, dice>."""
    over = covers(known, threshold)
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.split(F.lit("|".join(g)), "[|]").alias("grams"), F.lit(len(g)).alias("m"), F.lit(math.ceil(len(g) * threshold / (2 - threshold) - 1e-9)).alias("least"), F.lit(math.floor(len(g) * (2 - threshold) / threshold + 1e-9)).alias("most"), F.split(F.lit("|".join(over[n])), "[|]").alias("over")) for n, g in known])
    table = F.filter(table, lambda t: F.size(F.array_intersect(own, t["grams"])) >= t["least"])
    meet = lambda a, b: (a["first"] <= b["last"]) & (b["first"] <= a["last"])
    better = lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).otherwise(a["last"] - b["last"])

    def of(t: Column) -> Column:
        places = F.filter(F.transform(own, lambda g, k: F.when(F.array_contains(t["grams"], g), k)), lambda k: k.isNotNull())

        def best(at: Column, a: Column) -> Column:
            """The best window that starts at a."""
            ends = F.filter(F.slice(at, F.array_position(at, a).cast("int"), t["most"]), lambda b: b - a < t["most"])

            def one(b: Column) -> Column:
                grams = F.array_distinct(F.slice(own, a + 1, b - a + 1))
                return F.struct(a.alias("first"), b.alias("last"), t["license"].alias("license"), (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["m"])).alias("dice"), t["over"].alias("over"))

            scored = F.filter(F.transform(F.slice(ends, t["least"], F.greatest(F.size(ends) - t["least"] + 1, F.lit(0))), one), lambda w: w["dice"] >= threshold)
            return F.get(F.array_sort(scored, better), F.lit(0))

        found = F.flatten(F.transform(F.array(places), lambda at: F.filter(F.transform(at, lambda a: best(at, a)), lambda w: w.isNotNull())))
        # from left to right: a window after the last one is new, a better one that overlaps it takes its place
        none = F.expr("cast(array() as array<struct<first:int,last:int,license:string,dice:double,over:array<string>>>)")
        last = lambda kept: F.element_at(kept, -1)
        return F.aggregate(found, none, lambda kept, w: F.when(F.size(kept) == 0, F.array(w)).when(last(kept)["last"] < w["first"], F.concat(kept, F.array(w))).when(last(kept)["dice"] < w["dice"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(w))).otherwise(kept))

    def stays(w: Column, all_: Column) -> Column:
        beats = lambda v: (v["license"] != w["license"]) & F.array_contains(w["over"], v["license"]) & meet(v, w) & (~F.array_contains(v["over"], w["license"]) | (v["dice"] > w["dice"]) | ((v["dice"] == w["dice"]) & (v["license"] < w["license"])))
        return ~F.exists(all_, beats) & ~F.exists(units, lambda u: F.array_contains(w["over"], u["license"]) & meet(u, w))

    return F.flatten(F.transform(F.array(F.flatten(F.transform(table, of))), lambda all_: F.filter(all_, lambda w: stays(w, all_))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col``, matches array<struct<unit, number, license, dice>> in order of unit; a window's number is its first word's."""
    known = sorted((name, bigrams(t)) for name, t in (templates or TEMPLATES).items())
    heads = sorted(set().union(*(guards(g, threshold) for _, g in known)))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = docs.select(F.col(id_col).alias("id"), text.alias("low"))
    guarded = lambda flat: F.exists(F.split(F.lit("|".join(heads)), "[|]"), lambda h: F.contains(flat, h))

    def matched(units: Column, kind: str) -> Column:
        flat = F.transform(units, lambda u, k: F.struct(k.cast("long").alias("number"), _flat(u).alias("flat")))
        flat = F.filter(flat, lambda r: guarded(r["flat"]) & F.contains(r["flat"], F.lit(" ")))
        cut = F.transform(flat, lambda r: F.struct(r["number"].alias("number"), _flat_bigrams(r["flat"]).alias("own")))
        rows = F.transform(cut, lambda r: F.struct(F.lit(kind).alias("unit"), r["number"].alias("number"), _best(r["own"], known, threshold).alias("best")))
        return F.transform(F.filter(rows, lambda r: r["best"].isNotNull()), lambda r: F.struct(r["unit"].alias("unit"), r["number"].alias("number"), r["best"]["license"].alias("license"), r["best"]["dice"].alias("dice")))

    paragraphs = F.split("low", "\n[ \\t\\r]*\n")
    lines = F.split("low", "\n")
    # the array of one binds the flat text, or it would be made again for every beginning
    maybe = F.exists(F.array(_flat(F.col("low"))), guarded)
    none = F.expr("cast(array() as array<struct<unit:string,number:bigint,license:string,dice:double>>)")
    found = F.concat(
        matched(lines, "line"),
        F.when(F.size(paragraphs) > 1, matched(paragraphs, "paragraph")).otherwise(none),
        F.when(F.size(lines) > 1, matched(F.array(F.col("low")), "text")).otherwise(none),
    )
    rows = low.select("id", "low", F.when(maybe, found).alias("found"))
    size = lambda text: F.size(F.filter(F.split(_flat(text), " "), lambda w: w != ""))

    def placed(m: Column) -> Column:
        """A matched unit with its first and last bigram in the text."""
        cut = F.when(m["unit"] == "line", lines).when(m["unit"] == "paragraph", paragraphs).otherwise(F.array("low"))
        first = size(F.array_join(F.slice(cut, 1, m["number"].cast("int")), " "))
        return F.struct(m["license"].alias("license"), first.alias("first"), (first + size(F.get(cut, m["number"].cast("int"))) - 2).alias("last"))

    words = F.split(_flat(F.col("low")), " ")
    # the outer arrays of one bind what every template and window reads
    own = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    inside = F.flatten(F.transform(own, lambda g: F.flatten(F.transform(F.array(F.transform("found", placed)), lambda u: _windows(g, known, u, threshold)))))
    inside = F.transform(inside, lambda w: F.struct(F.lit("window").alias("unit"), w["first"].cast("long").alias("number"), w["license"].alias("license"), w["dice"].alias("dice")))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("found").isNotNull(), F.concat("found", F.array_sort(inside))).otherwise(none).alias("matches"))
