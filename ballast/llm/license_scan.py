"""Licence scan: passages of documents against licence templates.

Method: text is normalised (lower case, runs of anything but letters and digits
become one space) and every line of a document is compared with each template
by the Dice coefficient over the sets of word bigrams.  A template is compared
only where the sizes allow the wanted coefficient: ``dice >= t`` needs
``t / (2 - t) <= |a| / |b| <= (2 - t) / t``.  ``scan`` sees one line at a time;
``passages`` compares windows of the whole text, whose words may stand in one
line or in several.  DataFrame code alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import any_of

#: Fixed values: (licence, notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: What ``passages`` looks for: the notices above and the paragraphs of the standard ones in full.
NOTICES = (
    *TEMPLATES,
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def normalised(lowered: Column) -> Column:
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def words_of(text: Column) -> Column:
    return F.filter(F.split(normalised(text), " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The set of word bigrams; one word alone is its own only element."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Licence findings in ``docs(doc_id, text)``.

    One row per doc_id and licence found: doc_id, license, n_hits (pairs of a
    line and a template at or above the threshold), dice (the best).  Null, empty
    and licence-free texts give no row; repeated rows count together, rows of
    a null doc_id form one group; further columns are ignored.  Every line of
    any length is compared, but for those that hold no anchor word, which can't
    reach the threshold.  The templates are a fixed list in the plan, so a
    line meets them in its own row and only findings are shuffled.
    """
    grams = [list(dict.fromkeys(map(" ".join, zip(w, w[1:])))) or w for w in map(_plain, (t for _, t in templates))]
    known = F.array(*(
        F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("size"), F.array(*map(F.lit, g)).alias("grams"))
        for (name, _), g in zip(templates, grams)
    ))
    ratio = threshold / (2 - threshold)
    size = F.size("grams")
    candidates = F.filter(known, lambda t: (size >= t["size"] * ratio - 1e-9) & (size * ratio <= t["size"] + 1e-9))
    scored = F.transform(
        candidates,
        lambda t: F.struct(t["license"].alias("license"), (2 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (size + t["size"])).alias("dice")),
    )
    holds = any_of([F.col("low").contains(a) for a in anchors(grams, threshold)])
    hits = (
        docs.select("doc_id", F.lower("text").alias("low"))
        .filter(holds)
        .select("doc_id", F.explode(F.split("low", r"[\n\r]+")).alias("low"))
        .filter(holds)
        .select("doc_id", bigrams(words_of(F.col("low"))).alias("grams"))
        .select("doc_id", F.explode(F.filter(scored, lambda s: s["dice"] >= threshold)).alias("hit"))
    )
    return hits.groupBy("doc_id", F.col("hit.license").alias("license")).agg(
        F.count(F.lit(1)).alias("n_hits"), F.max("hit.dice").alias("dice")
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though lambdas name it often."""
    return F.transform(F.array(value), use)[0]


def passages(docs: DataFrame, notices=NOTICES, threshold: float = 0.8) -> DataFrame:
    """Licence findings in ``docs(doc_id, text)``, wherever a notice stands in the text.

    One row per doc_id and licence found: doc_id, license, n_hits (passages),
    dice (the best).  Every window of words of the whole text, across line
    breaks, is compared whose number of bigrams is within the size bounds of a
    notice and that begins and ends with one of its bigrams (any other window
    does no better than the one within it that does).  Of windows of one licence
    that overlap the best counts, then the one that shares more, then the first.
    Null, empty and licence-free texts give no row; repeated rows count
    together, rows of a null doc_id form one group.
    """
    grams = [list(dict.fromkeys(map(" ".join, zip(w, w[1:])))) for w in map(_plain, (t for _, t in notices))]
    ratio = threshold / (2 - threshold)

    def literal(g: list[str]) -> Column:
        need, longest = math.ceil(ratio * len(g) - 1e-9), math.floor(len(g) / ratio + 1e-9)  # a window shares ``need`` at least
        return F.struct(F.lit(len(g)).alias("size"), F.lit(need).alias("need"), F.lit(longest).alias("longest"), F.array(*map(F.lit, g)).alias("grams"))

    known = F.array(*(
        F.struct(F.lit(name).alias("license"), F.array(*(literal(g) for (n, _), g in zip(notices, grams) if n == name)).alias("notices"))
        for name in dict.fromkeys(n for n, _ in notices)
    ))
    gram_at = lambda k: F.get(F.col("grams"), k)

    def windows(t: Column) -> Column:
        def of(at: Column) -> Column:
            def window(i: Column, j: Column) -> Column:
                begin, n = F.get(at, i), F.get(at, j) - F.get(at, i) + 1
                shared = F.size(F.array_distinct(F.transform(F.slice(at, i + 1, j - i + 1), gram_at)))
                dice = 2 * shared / (F.size(F.array_distinct(F.slice(F.col("grams"), begin + 1, n))) + t["size"])
                return F.struct((-dice).alias("worse"), (-shared).alias("fewer"), begin.alias("begin"), (begin + n).alias("end"))

            def near(i: Column, j: Column) -> Column:
                return F.get(at, j) - F.get(at, i) < t["longest"]

            starts = F.filter(F.sequence(F.lit(0), F.size(at) - t["need"]), lambda i: near(i, i + t["need"] - 1))
            ends = lambda i: F.filter(F.sequence(i + t["need"] - 1, F.least(F.size(at), i + t["longest"]) - 1), lambda j: near(i, j))
            found = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: window(i, j))))
            return F.when(F.size(at) >= t["need"], F.filter(found, lambda w: -w["worse"] >= threshold))

        at = F.filter(F.col("marks"), lambda k: F.array_contains(t["grams"], gram_at(k)))
        return F.coalesce(_bound(at, of), F.array().cast("array<struct<worse:double,fewer:int,begin:int,end:int>>"))

    found = F.transform(known, lambda x: F.struct(x["license"].alias("license"), F.flatten(F.transform(x["notices"], windows)).alias("windows")))
    # best first, and whatever overlaps none that is taken
    span = "array<struct<begin:int,end:int>>"
    taken = F.aggregate(
        F.array_sort("hit.windows"),
        F.array().cast(span),
        lambda held, w: F.when(F.exists(held, lambda h: (h["begin"] <= w["end"]) & (w["begin"] <= h["end"])), held).otherwise(
            F.concat(held, F.array(F.struct(w["begin"].alias("begin"), w["end"].alias("end"))))
        ),
    )
    every = sorted({x for g in grams for x in g})
    # an exploded array of one keeps what it holds from being computed anew in every lambda
    hits = (
        docs.select("doc_id", F.lower("text").alias("low"))
        .filter(any_of([F.col("low").contains(a) for a in anchors(grams, threshold)]))
        .select("doc_id", F.explode(F.array(words_of(F.col("low")))).alias("words"))
        .filter(F.size("words") > 1)
        .select("doc_id", F.explode(F.array(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))).alias("grams"))
        .select("doc_id", "grams", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("grams") - 1), lambda k: gram_at(k).isin(every)))).alias("marks"))
        .filter(F.size("marks") > 0)
        .select("doc_id", F.explode(F.filter(found, lambda x: F.size(x["windows"]) > 0)).alias("hit"))
        .select("doc_id", "hit.license", F.size(taken).alias("n"), (-F.array_min("hit.windows")["worse"]).alias("dice"))
    )
    return hits.groupBy("doc_id", "license").agg(F.sum("n").alias("n_hits"), F.max("dice").alias("dice"))


def anchors(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold with some template holds at least one.

    By the size bounds such a line shares at least ``t (1 + t / (2 - t)) / 2``
    of a template's bigrams, so it can't miss all of any set of bigrams that is
    larger than the rest.  Words are taken, those that cover the most and are
    the longest first, until each template has so many bigrams covered.
    """
    left = {}
    for k, g in enumerate(grams):
        shared = math.ceil(threshold * (1 + threshold / (2 - threshold)) / 2 * len(g) - 1e-9)
        left[k] = [set(g), len(g) - shared + 1]
    chosen: list[str] = []
    while left:
        gain: dict[str, int] = {}
        for open_grams, need in left.values():
            for word in {w for g in open_grams for w in g.split()}:
                gain[word] = gain.get(word, 0) + min(need, sum(word in g.split() for g in open_grams))
        word = max(gain, key=lambda w: (len(w) >= 4, gain[w] * len(w), w))
        chosen.append(word)
        for k, (open_grams, need) in list(left.items()):
            covered = {g for g in open_grams if word in g.split()}
            left[k] = [open_grams - covered, need - len(covered)]
            if left[k][1] <= 0:
                del left[k]
    return sorted(chosen)


def _plain(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()
