"""Licence scans: Dice coefficient over word bigrams against licence templates, built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: wording of public licences and of their customary notices
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
                      "If a copy of the MPL was not distributed with this file, You can obtain one at "
                      "https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                         "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                         "specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version. This program is distributed in the hope that it "
                      "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
                      "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
           "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
           "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
           "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
           "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
           "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
           "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
           "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
           "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
# words too common to tell a licence by
COMMON = ("a", "an", "and", "any", "as", "at", "be", "by", "for", "if", "in", "is", "it", "no", "not", "of", "on", "or",
          "the", "this", "to", "with", "you")
LEAST = 0.8


def template_words(text: str) -> list[str]:
    """Words of a template as :func:`normal` gives them."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def normal(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def sure_words(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words of which every text that reaches ``least`` has one.

    A text with Dice >= t has at least t / (2 - t) of the template's bigrams, so it must have one of any choice of
    more than the rest. Bigrams whose longer uncommon word is longest are chosen, and that word stands for each.
    """
    out = set()
    for text in templates.values():
        words = template_words(text)
        pairs = sorted({(a, b) for a, b in zip(words, words[1:])})
        need = len(pairs) - math.ceil(round(len(pairs) * least / (2 - least), 9)) + 1
        mark = lambda p: max(p, key=lambda w: (w not in COMMON, len(w), w))
        best = sorted(pairs, key=lambda p: (mark(p) in COMMON, -len(mark(p)), p))[:need]
        out.update(mark(p) for p in best)
    return sorted(out)


def _windows(words: Column, pairs: list[str], least: float) -> Column:
    """Runs of words around a template's bigrams that can reach ``least``: array of (first bigram, last bigram).

    Dice >= t means that (2 - t) for every distinct template bigram of the run, less t for every other bigram, comes
    to t times the template's bigrams. One pass over the places of template bigrams keeps the run with the largest
    sum; it ends where the sum falls under 0, where it has dropped by more than a template can win back, or where the
    next bigram would pass the largest size that can match. The work grows with the text, not with pairs of places.
    """
    n = len(pairs)
    gain, high = 2 - least, math.floor(round(n * (2 - least) / least, 9))
    at = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    indices = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(F.transform(indices, lambda i: F.struct(i.alias("i"), at(i).alias("pair"))), lambda x: x["pair"].isin(pairs))
    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("top"),
                     F.lit(-1).alias("end"), F.array().cast("array<string>").alias("seen"), none.alias("out"))

    def closed(a):
        here = F.array(F.struct(a["first"].alias("first"), a["end"].alias("last")))
        return F.when(a["top"] >= F.lit(round(least * n, 9) - 1e-9), F.concat(a["out"], here)).otherwise(a["out"])

    def step(a, x):
        paid = a["sum"] - F.lit(least) * (x["i"] - a["last"] - 1)
        fresh = ((a["first"] < 0) | (paid <= 0) | (a["top"] - paid > F.lit(gain * n))
                 | (x["i"] - a["first"] + 1 > F.lit(high)))
        again = F.array_contains(a["seen"], x["pair"])
        # a run that is enough already, and its first bigram once more: the next copy
        fresh = fresh | ((a["top"] >= F.lit(round(least * n, 9) - 1e-9)) & (F.get(a["seen"], F.lit(0)) == x["pair"]))
        total = F.when(fresh, F.lit(gain)).when(again, paid).otherwise(paid + F.lit(gain))
        better = fresh | (total > a["top"])
        return F.struct(
            total.alias("sum"), F.when(fresh, x["i"]).otherwise(a["first"]).alias("first"), x["i"].alias("last"),
            F.when(better, total).otherwise(a["top"]).alias("top"), F.when(better, x["i"]).otherwise(a["end"]).alias("end"),
            F.when(fresh, F.array(x["pair"])).when(again, a["seen"]).otherwise(F.array_append(a["seen"], x["pair"])).alias("seen"),
            F.when(fresh, closed(a)).otherwise(a["out"]).alias("out"))

    return F.aggregate(hits, start, step, closed)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, anywhere: bool = False) -> DataFrame:
    """Passages that match a template: ``doc_id, license, dice, bigrams, passage``.

    Passages are the whole text, its paragraphs (between blank lines), its lines and its sentences, normalised and
    distinct within a row. One row comes for each passage and its best template (ties: smaller name) with
    Dice >= ``least``. With ``anywhere``, runs of words that match across or inside those passages are passages too
    (see :func:`_windows`), if the row has no passage of that licence that contains them or lies in them. A null or empty text has no passages; rows are independent, so repeated rows give
    repeated findings; other columns are ignored; an empty table gives no rows.

    Documents without any of :func:`sure_words` are left out first, which cannot lose a match; then template sizes
    outside [t / (2 - t), (2 - t) / t] of the passage are skipped. No shuffle.
    """
    templates = TEMPLATES if templates is None else templates
    rows = []
    for name, text in sorted(templates.items()):
        words = template_words(text)
        rows.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.split(normal(F.col("text")), " ")
    likely = base.filter(F.arrays_overlap(words, F.lit(sure_words(templates, least))))
    parts = F.concat(F.array("text"), F.split("text", r"\n\s*\n"), F.split("text", "\n"),
                     F.split("text", r"[.!?]\s+"))
    own, kept = F.array_distinct(F.transform(parts, normal)), []
    if not anywhere:
        passages = likely.select("doc_id", F.explode(own).alias("passage"))
    else:
        spans = [F.when(F.arrays_overlap("words", F.lit(sure_words({name: templates[name]}, least))),
                        _windows(F.col("words"), pairs, least)) for name, pairs in rows if pairs]
        none = F.array().cast("array<struct<first:int,last:int>>")
        cut = lambda x: F.array_join(F.slice("words", x["first"] + 1, x["last"] - x["first"] + 2), " ")
        runs = F.array_distinct(F.transform(F.concat(none, *[F.coalesce(x, none) for x in spans]), cut))
        near = lambda r: F.filter("own", lambda p: (F.length(p) > 0) & (F.contains(p, r) | F.contains(r, p)))
        each = F.concat(F.transform("own", lambda p: F.struct(p.alias("passage"), F.array().cast("array<string>").alias("rivals"))),
                        F.transform("runs", lambda r: F.struct(r.alias("passage"), near(r).alias("rivals"))))
        passages = likely.withColumn("words", words).withColumn("own", own).withColumn("runs", runs).select(
            "doc_id", F.inline(each))
        kept = ["rivals"]
    sized = passages.withColumn("pairs", word_bigrams(F.split("passage", " "))).withColumn("bigrams", F.size("pairs"))
    low, high = least / (2 - least), (2 - least) / least
    scores = []
    for name, pairs in rows:
        share = F.lit(2.0) * F.size(F.array_intersect("pairs", F.lit(pairs))) / (F.col("bigrams") + F.lit(len(pairs)))
        fits = F.col("bigrams").between(math.ceil(round(len(pairs) * low, 9)), math.floor(round(len(pairs) * high, 9)))
        scores.append(F.when(fits, F.struct(share.alias("dice"), F.lit(name).alias("license"))))
    found = sized.filter(F.col("bigrams") > 0).withColumn("all", F.filter(
        F.array(*scores), lambda x: x.isNotNull() & (x["dice"] >= least)))
    best = F.reduce("all", F.col("all")[0], lambda b, x: F.when(x["dice"] > b["dice"], x).otherwise(b))
    found = found.filter(F.size("all") > 0).withColumn("best", best).select(
        "doc_id", "best.license", "best.dice", F.col("bigrams").cast("bigint").alias("bigrams"), "passage", *kept)
    if not anywhere:
        return found

    def told(passage):
        """Whether the passage itself matches the licence of the row."""
        own = word_bigrams(F.split(passage, " "))
        dice = [F.when(F.col("license") == name, F.lit(2.0) * F.size(F.array_intersect(own, F.lit(pairs)))
                       / (F.size(own) + F.lit(len(pairs)))) for name, pairs in rows]
        return F.coalesce(*dice) >= least

    return found.filter(~F.exists("rivals", told)).drop("rivals")
