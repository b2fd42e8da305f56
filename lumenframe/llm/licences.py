"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text is normalised (ASCII lower case, all but letters and digits to one blank) and
compared unit by unit: each line, the whole text, and windows of the whole text, so
that a notice is found that is wrapped over lines of a longer document or stands
within a longer line. A window has as many words as the template and starts at a word
whose bigram the template has; of such words in a block of an eighth of the template's
length only the first starts one, so that work per word is bounded. A notice that
stands in a text word for word is therefore always found.

A template can only reach the threshold t against a unit whose number of distinct
bigrams lies within [t / (2 - t), (2 - t) / t] times its own, and only if the unit
shares t / (2 - t) of the template's bigrams with it. A unit's bigrams are among the
text's, so a text that shares fewer is done with that template without any unit.

Scale: templates are a short fixed list, so the scan is one narrow pass without a
shuffle, built from DataFrame functions alone. Most texts share few bigrams with any
template and are read once.

Edge cases: null and empty texts, and units of fewer than two words, match nothing;
ties go to the template of most bigrams, then to the first by name; repeated rows get equal results;
extra columns pass through, and those named like an added column are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_row, let, text_or_empty, unpack

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public licence notices and whole short licences, by SPDX-like name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text_or_empty(text), UPPER, LOWER), "[^a-z0-9]+", " "))


def bigrams(unit: Column) -> Column:
    """Word bigrams of a normalised unit, in order."""
    return let(F.split(unit, " "), lambda w: F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))


def template_bigrams(templates: dict[str, str]) -> list[tuple[str, list[str], int]]:
    """(name, distinct bigrams, words) in order of names; templates of fewer than two words go."""
    out = []
    for name in sorted(templates):
        w = re.sub("[^a-z0-9]+", " ", templates[name].translate(str.maketrans(UPPER, LOWER))).split()
        if pairs := sorted({f"{a} {b}" for a, b in zip(w, w[1:])}):
            out.append((name, pairs, len(w)))
    return out


def block(words: int) -> int:
    """Positions of which only the first with a known bigram starts a window."""
    return max(1, words // 8)


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows with licence, dice (both null without a match), and n_matches: the templates that any unit matches."""
    known = template_bigrams(templates)
    share = threshold / (2 - threshold)
    vocabulary = sorted({x for _, b, _ in known for x in b})
    fields = lambda n, b, w: (F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("size"), F.lit(w - 1).alias("width"), F.lit(block(w)).alias("block"))
    table = F.array(*[F.struct(*fields(*t)) for t in known])

    def against(grams: Column, t: Column) -> Column:
        """Dice of a unit (distinct bigrams) and a template, 0 beyond the size bounds."""
        n = F.size(grams)
        dice = F.size(F.array_intersect(grams, t["grams"])) * F.lit(2.0) / (n + t["size"])
        return F.when((n >= t["size"] * share - 1e-9) & (n <= t["size"] / share + 1e-9), dice).otherwise(0.0)

    def windows(pairs: Column, t: Column) -> Column:
        """The distinct bigrams of each window of the template's length."""
        places = F.filter(F.transform(pairs, lambda x, i: F.when(F.array_contains(t["grams"], x), i)), lambda i: i.isNotNull())
        blocks = lambda i: F.floor(i / t["block"])
        starts = let(places, lambda p: F.filter(p, lambda i, k: (k == 0) | (blocks(F.get(p, k - 1)) != blocks(i))))
        return F.transform(starts, lambda i: F.array_distinct(F.slice(pairs, i + 1, t["width"])))

    def matches(text: Column, pairs: Column) -> Column:
        """(minus the best dice, minus the bigrams, name) of the templates that any unit matches; of equal ones the longest comes first."""
        own = F.array_distinct(F.filter(pairs, lambda x: x.isin(vocabulary)))
        enough = lambda grams: F.filter(table, lambda t: (F.size(grams) >= t["size"] * share - 1e-9) & (F.size(F.array_intersect(grams, t["grams"])) >= t["size"] * share - 1e-9))
        units = F.concat(F.array(F.array_distinct(pairs)), F.transform(F.split(text, "\n"), lambda u: F.array_distinct(bigrams(normalised(u)))))

        def all_units(fits: Column) -> Column:
            best = lambda units, t: F.array_max(F.transform(F.concat(units, windows(pairs, t)), lambda g: against(g, t)))
            scored = let(units, lambda u: F.transform(fits, lambda t: F.struct((-best(u, t)).alias("minus"), (-t["size"]).alias("less"), t["name"].alias("name"))))
            return F.when(F.size(fits) > 0, F.filter(scored, lambda s: s["minus"] <= -threshold))

        return let(let(own, enough), all_units)

    text = text_or_empty(F.col(f"_row.`{text_col}`"))
    found = let(bigrams(normalised(text)), lambda pairs: matches(text, pairs)) if known else F.lit(None).cast("array<struct<minus:double,less:int,name:string>>")
    rows = keep_row(docs).select("_row", found.alias("_found")).withColumn("_best", F.array_min("_found"))
    added = {"licence": F.col("_best.name"), "dice": -F.col("_best.minus"), "n_matches": F.coalesce(F.size("_found"), F.lit(0)).cast("long")}
    return unpack(rows, docs.columns, added)
