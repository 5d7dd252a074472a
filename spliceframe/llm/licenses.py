"""Licence scan: lines, whole texts and windows of words against licence templates, by Dice coefficient over distinct word bigrams.

A unit of n bigrams can reach the threshold t only with templates of t / (2 - t) * n to (2 - t) / t * n bigrams, so these bounds prune the
other templates before anything is compared; windows are searched only for templates of which the text holds t / (2 - t) of the bigrams.
All of it is column expressions over one row: no shuffle.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceframe.llm.common import ascii_lower

PERCENT = 75
#: Well-known notices, each as it is commonly placed in files. Fixed values.
TEMPLATES = (
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0-or-later-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Whole licence texts, without copyright lines, and notices of several lines.
TEXTS = tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
#: Templates of more distinct bigrams are compared with long texts only, each by itself.
SHORT = 400


def _bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_bigrams(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(name, _bigrams(_words(text))) for name, text in templates]


def bounds(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Least and largest number of bigrams that a unit may have to reach the threshold with a template of n."""
    return -(-percent * n // (200 - percent)), (200 - percent) * n // percent


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _table(percent: int, templates) -> Column:
    """The templates in order of their names, as a constant. n: distinct bigrams; lo, hi: bounds of a unit's; need: least number that a unit has
    to share; span: longest window in bigrams, repeats counted."""
    rows = []
    for name, text in sorted(templates):
        grams, repeats = _bigrams(_words(text)), len(_words(text)) - 1
        lo, hi = bounds(len(grams), percent)
        # A unit that shares m bigrams has at least m, so 2 * m / (m + n) bounds its score.
        numbers = {"n": len(grams), "lo": lo, "hi": hi, "need": lo, "span": bounds(repeats, percent)[1] + repeats}
        rows.append(F.struct(F.lit(name).alias("name"), *(F.lit(v).alias(k) for k, v in numbers.items()), F.split(F.lit("|".join(grams)), "[|]").alias("grams")))
    return F.array(*rows)


_MATCH = "array<struct<score:double,license:string,line:int>>"


def _pairs(words: Column) -> Column:
    """Word bigrams in order, repeats kept."""
    return _let(words, lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))


def _unit(grams: Column, line: Column, table: Column, percent: int) -> Column:
    """Matches of a unit of distinct bigrams with the templates within its bounds."""
    near = F.filter(table, lambda t: (t["lo"] <= F.size(grams)) & (F.size(grams) <= t["hi"]))
    score = lambda t: F.size(F.array_intersect(t["grams"], grams)) * 2 / (F.size(grams) + t["n"])
    return F.filter(F.transform(near, lambda t: F.struct(score(t).alias("score"), t["name"].alias("license"), line.alias("line"))), lambda m: m["score"] * 100 >= percent)


def _windows(lines: Column, t: Column, percent: int) -> Column:
    """array<struct<score, at, end, line, last>> of the windows of consecutive words, over line ends, that match one template.

    A window begins where a run of the template's bigrams begins: adding one more of them in front never lowers a score. From there one pass keeps
    the numbers of distinct and of shared bigrams (those without an earlier occurrence in the window) and the best end. Of windows that
    overlap, the better stays."""
    placed = F.flatten(F.transform(lines, lambda x: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), w.alias("word")))))

    def best(w: Column, p: Column, x: Column) -> Column:
        def step(s: Column, y: Column) -> Column:
            new = (y["prev"] < x["at"]).cast("int")
            d, i = s["d"] + new, s["i"] + F.when(y["hit"], new).otherwise(F.lit(0))
            score = i * 2 / (d + t["n"])
            return F.struct(i.alias("i"), d.alias("d"), F.greatest(score, s["score"]).alias("score"), F.when(score > s["score"], y["at"]).otherwise(s["end"]).alias("end"))

        none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.lit(0.0).alias("score"), F.lit(-1).alias("end"))
        line = lambda at: F.get(w, at)["line"]
        run = F.aggregate(F.slice(p, x["at"] + 1, t["span"]), none, step)
        return _let(run, lambda r: F.struct(r["score"].alias("score"), x["at"].alias("at"), r["end"].alias("end"), line(x["at"]).alias("line"), line(r["end"] + 1).alias("last")))

    def of_hits(w: Column, p: Column, h: Column) -> Column:
        # need of the template's bigrams must lie within one span.
        enough = lambda x, k: F.get(h, k + t["need"] - 1)["at"] - x["at"] < t["span"]
        starts = F.filter(h, lambda x, k: F.coalesce(F.get(h, k - 1)["at"] < x["at"] - 1, F.lit(True)) & F.coalesce(enough(x, k), F.lit(False)))
        found = F.filter(F.transform(starts, lambda x: best(w, p, x)), lambda m: m["score"] * 100 >= percent)
        kind = "array<struct<score:double,at:int,end:int,line:int,last:int>>"

        def apart(kept: Column, x: Column) -> Column:
            last = F.get(kept, F.size(kept) - 1)
            return F.when(F.coalesce(last["end"] < x["at"], F.lit(True)), F.concat(kept, F.array(x))).when(last["score"] < x["score"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

        return F.aggregate(found.cast(kind), F.array().cast(kind), apart)

    def of_words(w: Column) -> Column:
        grams = F.transform(_pairs(F.transform(w, lambda x: x["word"])), lambda g, i: F.struct(g.alias("g"), i.alias("at")))
        before = lambda s, k: F.get(s, k - 1)
        linked = lambda s: F.transform(s, lambda x, k: F.struct(x["at"].alias("at"), F.coalesce(F.when(before(s, k)["g"] == x["g"], before(s, k)["at"]), F.lit(-1)).alias("prev"), F.array_contains(t["grams"], x["g"]).alias("hit")))
        return _let(F.sort_array(_let(F.sort_array(grams), linked)), lambda p: _let(F.filter(p, lambda x: x["hit"]), lambda h: of_hits(w, p, h)))

    return _let(placed, of_words)


def scan(text: Column, percent: int = PERCENT, templates=TEMPLATES + TEXTS) -> Column:
    """array<struct<score, license, line>> of the matches in a text: lines count from 1; the whole text, if it has several lines, is line 0.

    Then come windows of words, with the line they begin in, of templates that neither the whole text nor a line within the window matches."""
    short = sorted({g for _, grams in template_bigrams(templates) if len(grams) <= SHORT for g in grams})
    lines = F.transform(F.split(ascii_lower(text), "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " "), lambda w: w != "").alias("words")))
    grams = lambda words: F.array_distinct(_pairs(words))

    def units(x: Column, whole: Column, table: Column) -> Column:
        each = F.flatten(F.transform(x, lambda u: _let(grams(u["words"]), lambda g: _unit(g, u["line"], table, percent))))
        return F.when(F.size(x) > 1, F.concat(each, _unit(whole, F.lit(0), table, percent))).otherwise(_unit(whole, F.lit(1), table, percent)).cast(_MATCH)

    def windows(x: Column, whole: Column, common: Column, table: Column, found: Column) -> Column:
        # Nothing below need shared bigrams in the whole text can match in a part of it.
        shared = lambda t: F.when(t["n"] > SHORT, F.size(F.array_intersect(t["grams"], whole))).when(F.size(common) >= t["need"], F.size(F.array_intersect(t["grams"], common))).otherwise(F.lit(0))
        able = F.filter(table, lambda t: (F.size(whole) >= t["need"]) & (shared(t) >= t["need"]))
        able = F.filter(able, lambda t: ~F.exists(found, lambda m: (m["license"] == t["name"]) & ((m["line"] == 0) | (F.size(x) == 1))))
        fresh = lambda t, m: ~F.exists(found, lambda o: (o["license"] == t["name"]) & o["line"].between(m["line"], m["last"]))
        one = lambda t: F.transform(F.filter(_windows(x, t, percent), lambda m: fresh(t, m)), lambda m: F.struct(m["score"].alias("score"), t["name"].alias("license"), m["line"].alias("line")))
        return F.concat(found, F.flatten(F.transform(able, one)).cast(_MATCH))

    def both(x: Column, table: Column) -> Column:
        def of(whole: Column) -> Column:
            common = F.array_intersect(F.split(F.lit("|".join(short)), "[|]"), whole)
            return _let(common, lambda c: _let(units(x, whole, table), lambda found: windows(x, whole, c, table, found)))

        return _let(grams(F.flatten(F.transform(x, lambda u: u["words"]))), of)

    return F.coalesce(_let(_table(percent, templates), lambda table: _let(lines, lambda x: both(x, table))), F.array().cast(_MATCH))


def scan_licenses(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, license, score, line, n_matches, matches for each row; the best match first by score, then by licence name, then by line.

    Null and empty texts, and texts without a match, have a null license, score and line and 0 matches. Rows that repeat a doc_id are judged each by itself."""
    found = docs.select("doc_id", scan(F.col("text"), percent).alias("m"))
    best = F.array_min(F.transform("m", lambda x: F.struct((-x["score"]).alias("less"), x["license"].alias("license"), x["line"].alias("line"))))
    return found.select("doc_id", best.alias("b"), F.size("m").cast("long").alias("n_matches"), F.col("m").alias("matches")).select(
        "doc_id", F.col("b.license").alias("license"), (-F.col("b.less")).alias("score"), F.col("b.line").cast("long").alias("line"), "n_matches", "matches"
    )
