"""License scans: lines of normalised text compared to licence templates by Dice over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Fixed values: (name, the notice or text by which works declare the licence).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Whole texts, without the copyright line.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
)


def normalised_words(text: str) -> list[str]:
    """What words() is to a column: lower-cased A-Z, digits and dots inside words; all else parts words."""
    kept = "".join(c.lower() if c.isascii() and (c.isalnum() or c == ".") else c if not c.isascii() else " " for c in text)
    return [w for w in (x.strip(".") for x in kept.split(" ")) if w]


def words(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_replace(F.translate(line, upper, upper.lower()), r"[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.transform(F.split(plain, " "), lambda x: F.btrim(x, F.lit("."))), lambda x: x != "")


def bigrams(words_: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words_, words_[1:])})


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, license, template, dice) of each line with a Dice coefficient of `least` or more, with its best template.

    Lines end at \\n and are numbered from 1. Dice is 2 * shared / (own + template's) over distinct bigrams of normalised words. Ties go
    to the template listed first (template counts from 0). Lines and texts without a bigram (null, empty, one word) match none.
    Rows are looked at alone: repeated rows give repeated results, a null id stays null. No other column of docs is looked at.

    A notice that is wrapped over lines, or that stands inside a longer line, is a passage: a run of words of the whole text, from one of a
    template's bigrams to another, with a coefficient of `least` or more. line_no is the line it starts in. Passages that meet a line
    that matches by itself are left out; of passages that meet, the one with the highest coefficient is given (of equal ones, that of the longer template).

    A text without any of the templates' longest words holds none of them, and isn't cut. By its number of words alone, a line too short or too long for every template is left out before bigrams are made; of the
    rest, a template is compared only if its size and the line's allow the coefficient. The templates are part of the plan.
    """
    known = [(name, bigrams(normalised_words(text))) for name, text in templates]
    ratio = least / (2 - least)
    shortest = min(len(b) for _, b in known) * ratio
    longest = max(len(b) for _, b in known) / ratio
    lines = _likely(docs, known, ratio, id_col, text_col).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # A word takes at least one character and a space; a line of w words has at most w - 1 distinct bigrams.
    lines = lines.where(F.length("line") >= 2 * shortest + 1)
    first = sorted({w for _, b in known for w in b})
    # Each step is a row of its own array, so that it is computed once however often it is used.
    bound = lambda c: F.explode(F.array(c))
    lines = lines.select("doc_id", (F.col("at") + 1).alias("line_no"), bound(words(F.col("line"))).alias("w")).where(F.size("w") - 1 >= shortest)
    pairs = F.array_distinct(F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1))))
    sized = lines.where(F.exists("w", lambda x: x.isin(*sorted({x.split(" ")[0] for x in first})))).select("doc_id", "line_no", bound(pairs).alias("own"))
    mine = sized.where((F.size("own") >= shortest) & (F.size("own") <= longest) & F.arrays_overlap("own", F.array(*[F.lit(x) for x in first])))

    def dice(k: int) -> Column:
        theirs, n = known[k][1], F.size("own")
        value = 2.0 * F.size(F.array_intersect("own", F.array(*[F.lit(x) for x in theirs]))) / (n + len(theirs))
        return F.when((n >= len(theirs) * ratio) & (n <= len(theirs) / ratio), F.struct(value.alias("dice"), F.lit(-k).alias("order"), F.lit(known[k][0]).alias("license")))

    best = mine.select("doc_id", "line_no", F.array_max(F.array(*[dice(k) for k in range(len(known))])).alias("b"))
    by_line = best.where(F.col("b.dice") >= least).select("doc_id", "line_no", "b.license", (-F.col("b.order")).alias("template"), "b.dice")
    return by_line.unionByName(_passages(docs, known, least, id_col, text_col))


def _needed_words(known, ratio: float) -> list[str]:
    """A text that holds a share `ratio` of a template's bigrams has one of these: the rest of the bigrams is too few."""
    out = set()
    for _, b in known:
        ranked = sorted(b, key=lambda x: (-max(map(len, x.split(" "))), x))
        out |= {max(x.split(" "), key=len) for x in ranked[: len(b) - max(1, math.ceil(len(b) * ratio - 1e-9)) + 1]}
    # Where a word is inside another, a text with that has it too.
    return sorted(x for x in out if not any(y in x for y in out if y != x))


def _likely(docs: DataFrame, known, ratio: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, low) of the texts that have one of the needed words; low is the text in lower case, made once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.explode(F.array(F.lower("text"))).alias("low"))
    return rows.where(functools.reduce(lambda a, b: a | b, [F.col("low").contains(x) for x in _needed_words(known, ratio)]))


def _passages(docs: DataFrame, known, least: float, id_col: str, text_col: str) -> DataFrame:
    """Passages of scan_licenses. Only texts with a template's longest words are cut into words; a passage has at most twice the places
    that its template's largest number of distinct bigrams needs."""
    ratio = least / (2 - least)
    bound = lambda c: F.explode(F.array(c))
    rows = _likely(docs, known, ratio, id_col, text_col)
    each = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(words(x), lambda y: F.struct(y.alias("w"), (i + 1).alias("line")))))
    cut = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), bound(each).alias("w")).where(F.size("w") > 1)
    pair = lambda x, i: F.struct(F.concat_ws(" ", x["w"], F.get("w", i + 1)["w"]).alias("b"), x["line"].alias("line"), F.get("w", i + 1)["line"].alias("last"))
    pairs = cut.select("doc_id", "row", bound(F.transform(F.slice("w", F.lit(1), F.size("w") - 1), pair)).alias("own"))
    templates = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("license"), F.array(*[F.lit(x) for x in b]).alias("theirs")) for k, (name, b) in enumerate(known)]
    hit = lambda t: F.filter(F.transform("own", lambda x, i: F.when(F.array_contains(t["theirs"], x["b"]), i)), lambda x: x.isNotNull())
    # A text is copied for no template but those that have enough of their bigrams in it.
    likely = F.filter(F.transform(F.array(*templates), lambda t: F.struct(t.alias("t"), hit(t).alias("hits"))), lambda x: F.size(x["hits"]) >= F.size(x["t"]["theirs"]) * ratio)
    one = pairs.select("*", F.explode_outer(likely).alias("l")).where("l IS NOT NULL").select("doc_id", "row", "own", "l.t", "l.hits")
    few = F.size("t.theirs") * ratio
    near = one.select("*", F.posexplode("hits").alias("x", "s"))
    ends = F.filter(F.slice("hits", F.col("x") + 1, F.size("hits") - F.col("x")), lambda e: e - F.col("s") < 2 * F.size("t.theirs") / ratio)
    wide = near.select("doc_id", "row", "own", "t", "s", bound(ends).alias("ends")).where(F.size("ends") >= few)

    def dice(e: Column) -> Column:
        run = F.array_distinct(F.transform(F.slice("own", F.col("s") + 1, e - F.col("s") + 1), lambda x: x["b"]))
        return F.transform(F.array(run), lambda r: F.struct((2.0 * F.size(F.array_intersect(r, "t.theirs")) / (F.size(r) + F.size("t.theirs"))).alias("dice"), (-e).alias("e")))[0]

    best = wide.select("*", F.array_max(F.transform("ends", dice)).alias("b")).where(F.col("b.dice") >= least)
    found = best.select("doc_id", "row", "own", F.struct("b.dice", F.size("t.theirs").alias("size"), (-F.col("t.k")).alias("order"), (-F.col("s")).alias("back"), "s", (-F.col("b.e")).alias("e"), "t.license").alias("p"))
    by_text = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("own").alias("own"), F.reverse(F.array_sort(F.collect_list("p"))).alias("ps"))
    meets = lambda p, q: (p["s"] <= q["e"]) & (q["s"] <= p["e"])
    kind = "array<struct<dice:double,size:int,order:int,back:int,s:int,e:int,license:string>>"
    # Lines that match by themselves, of those that passages touch.
    touched = F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(F.get("own", p["s"])["line"], F.get("own", p["e"])["last"]))))

    def whole(line: Column) -> Column:
        own = F.array_distinct(F.transform(F.filter("own", lambda x: (x["line"] == line) & (x["last"] == line)), lambda x: x["b"]))
        return F.exists(F.array(own), lambda r: F.exists(F.array(*templates), lambda t: 2.0 * F.size(F.array_intersect(r, t["theirs"])) / (F.size(r) + F.size(t["theirs"])) >= least))

    free = by_text.select("*", bound(F.filter(touched, whole)).alias("taken")).select("doc_id", "own", F.filter("ps", lambda p: ~F.exists("taken", lambda x: (F.get("own", p["s"])["line"] <= x) & (x <= F.get("own", p["e"])["last"]))).alias("ps"))
    kept = F.aggregate("ps", F.expr(f"CAST(array() AS {kind})"), lambda acc, p: F.when(F.exists(acc, lambda q: meets(p, q)), acc).otherwise(F.concat(acc, F.array(p))))
    return free.select("doc_id", "own", F.explode(kept).alias("p")).select("doc_id", F.get("own", F.col("p.s"))["line"].alias("line_no"), "p.license", (-F.col("p.order")).alias("template"), "p.dice")
