"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

Texts and licence templates are normalised to words. A passage is any run of
words of a text, wherever lines and blocks end; its likeness to a template is
twice the shared bigrams over all bigrams of both, repeats counted. A Dice of
``least`` bounds the sizes: a template of n bigrams is matched only by passages
of n * least / (2 - least) to n * (2 - least) / least bigrams, and only if the
whole text has the lesser number of its bigrams, which prunes nearly all
candidate templates. Of those that are left, passages that begin and end with
a shared bigram are scored; any other passage is no better than the one inside
it. Before that, texts go that have none of a few telltale words; a match
cannot do without all of them, since they touch more of a template's bigrams
than a match can lack.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import lower_ascii, words
from .storage import Carried, cut, joined

# Texts of public licences and of usual grants. A template is (licence, text).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("BSD-2-Clause", f"{_BSD_2}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_2}\n{_BSD_THIRD}\n{_BSD_END}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MPL-2.0", _MPL),
)

#: Letters, digits and all signs beyond ASCII make words; A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_words(text: str) -> list[str]:
    """The words of a template, as ``words(lower_ascii(...))`` has them."""
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def template_bigrams(text: str) -> Counter[str]:
    """How often a template has each pair of neighbouring words."""
    tokens = normal_words(text)
    return Counter(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))


def bigrams(tokens: str | Column) -> Column:
    """The pairs of neighbouring words of an array, by place."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def telltales(of: tuple[tuple[str, str], ...], least: float) -> list[str]:
    """Words of which any passage has one that reaches ``least`` with a template.

    A match shares at least ``least / (2 - least)`` of a template's bigrams.
    Words are taken, those that touch most bigrams first and short ones last,
    until they touch more than a match can lack.
    """
    chosen: set[str] = set()
    for counts in (template_bigrams(text) for _, text in of):
        lacking = sum(counts.values()) * (1 - least / (2 - least))
        pairs = {(*g.split(" "),): n for g, n in counts.items()}
        open_ = {g: n for g, n in pairs.items() if not chosen & {*g}}
        while open_ and sum(pairs.values()) - sum(open_.values()) <= lacking:
            tokens = {w for g in open_ for w in g}
            word = max(sorted(tokens), key=lambda w: (len(w) >= 6, len(w) >= 3, sum(n for g, n in open_.items() if w in g)))
            chosen.add(word)
            open_ = {g: n for g, n in open_.items() if word not in g}
    return sorted(chosen)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = 0.8, of: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``licence``, ``dice`` and ``licences``.

    ``licences`` holds a struct (licence, dice) for each licence that a passage
    reaches ``least`` with, best first, then by name; ``licence`` and ``dice``
    are the first of them or null. Every passage of the whole text counts, of
    any length and place. Null and empty texts and texts of one word have no
    bigrams and no licence; rows that repeat a row are judged alike. Columns
    named like a new one are replaced.
    """
    known = [(i, name, text, sum(template_bigrams(text).values())) for i, (name, text) in enumerate(of)]
    known = [t for t in known if t[3]]
    if not 0 < least <= 1 or not known:
        raise ValueError("least must be in (0, 1], and some template must have bigrams")
    carried = Carried(docs, text, keep)
    base = carried.df.withColumn("key", carried.row_key())
    told = reduce(or_, [F.contains(F.lower("body"), F.lit(w)) for w in telltales(of, least)])
    templates = docs.sparkSession.createDataFrame(known, "t int, licence string, body string, n int")
    grams = templates.select("t", "n", F.explode(bigrams(words(lower_ascii("body"), SEPARATORS))).alias("gram"))
    grams = cut(grams.groupBy("t", "n", "gram").agg(F.count(F.lit(1)).cast("int").alias("c")), "templates")
    spaced = base.where(told).select("key", words(lower_ascii("body"), SEPARATORS).alias("words"))
    # posexplode_outer: for posexplode, Spark would infer a filter that builds the arrays a second time.
    placed = spaced.select("key", F.posexplode_outer(bigrams("words")).alias("pos", "gram"))
    hits = joined(placed, grams, ["gram"], "inner").groupBy("key", "t", "n").agg(F.array_sort(F.collect_set(F.struct("gram", "pos", "c"))).alias("hits"))
    lower, upper = F.ceil(F.col("n") * least / (2 - least)), F.floor(F.col("n") * (2 - least) / least).cast("int")
    hits = hits.where(F.size("hits") >= lower)
    # A template has a bigram c times: of more in a passage, c count. So a hit counts from the start after the c-th such hit before it.
    last = lambda h, i: F.get(F.col("hits"), i - h["c"])
    after = lambda h, i: F.when(last(h, i)["gram"] == h["gram"], last(h, i)["pos"] + 1).otherwise(0)
    hits = hits.withColumn("hits", F.array_sort(F.transform("hits", lambda h, i: F.struct(h["pos"].alias("pos"), after(h, i).alias("after")))))
    hits = hits.where(F.size(F.filter("hits", lambda h: h["after"] == 0)) >= lower)

    def best_from(start: Column, i: Column) -> Column:
        """The best Dice of the passages that begin at a hit."""
        def longer(seen: Column, h: Column) -> Column:
            count = seen["count"] + F.when((h["after"] <= start["pos"]) & (h["pos"] < start["pos"] + upper), 1).otherwise(0)
            dice = 2.0 * count.cast("double") / (h["pos"] - start["pos"] + 1 + F.col("n")).cast("double")
            return F.struct(count.alias("count"), F.greatest(seen["dice"], dice).alias("dice"))

        return F.aggregate(F.slice("hits", i + 1, upper), F.struct(F.lit(0).alias("count"), F.lit(0.0).alias("dice")), longer, lambda seen: seen["dice"])

    found = hits.select("key", "t", F.array_max(F.transform("hits", best_from)).alias("dice")).where(F.col("dice") >= least)
    best = found.join(F.broadcast(templates.select("t", "licence")), "t").groupBy("key", "licence").agg(F.max("dice").alias("dice"))  # one row per template
    listed = best.groupBy(F.col("key").alias("found_key")).agg(F.sort_array(F.collect_list(F.struct((-F.col("dice")).alias("less"), "licence"))).alias("ranked"))
    listed = listed.select("found_key", F.transform("ranked", lambda r: F.struct(r["licence"].alias("licence"), (-r["less"]).alias("dice"))).alias("licences"))
    out = base.join(listed, F.col("key") == F.col("found_key"), "left")
    out = out.withColumn("licences", F.coalesce("licences", F.array().cast("array<struct<licence:string,dice:double>>")))
    first = F.get("licences", F.lit(0))
    return carried.restore(out.withColumns({"licence": first["licence"], "dice": first["dice"]}), "licence", "dice", "licences")
