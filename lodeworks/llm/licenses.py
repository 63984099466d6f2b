"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which texts name their license, and the terms of short licenses, in their usual wording.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
SHINGLE = 5
CONTAINED = 0.8
#: Bands of two MinHash values each. Windows are as long as a template, whose length counts up to a tenth more, or to the next
#: even number up to eight; they begin at each quarter of it and are longer by that, so one covers any place of the template.
#: With 0.8 of the template's shingles it has a Jaccard similarity of 0.8 / (1.1 * 1.25 + 1 - 0.8) = 0.51 with it or more, and
#: meets it in a band with 1 - (1 - 0.51**2)**24 = 0.9993.
BANDS, ROWS = 24, 2
#: Shingles of a text that are taken at once.
SEGMENT = 512


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _words(text: Column) -> Column:
    """Runs of a-z and 0-9 of a text in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once for each row, however often `use` names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(text: str) -> list[tuple[str, ...]]:
    words = words_of(text)
    return list(dict.fromkeys(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))


def anchors(templates: dict[str, tuple[str, ...]], contained: float = CONTAINED) -> list[str]:
    """Few words, one of which every text has that holds `contained` of a template's shingles.

    Such a text lacks less than a share of 1 - contained of the shingles, so of one more of them it has one: for each
    template, words are chosen that so many shingles have, long words first, which are rare in other texts.
    """
    found: set[str] = set()
    for text in (t for texts in templates.values() for t in texts):
        shingles = _shingles(text)
        enough = len(shingles) - math.ceil(contained * len(shingles) - 1e-9) + 1
        open_ = [s for s in shingles if found.isdisjoint(s)]
        while len(shingles) - len(open_) < enough:
            best = max((w for s in open_ for w in s), key=lambda w: (len(w), w))
            found.add(best)
            open_ = [s for s in open_ if best not in s]
    return sorted(found)


def grid(n: int) -> int:
    """The length that a template of n shingles counts as: 1, 2, 4, 6, 8, and then whole numbers, each a tenth more."""
    if n <= 8:
        return n if n < 2 else n + n % 2
    length = 8
    while length < n:
        length = max(length + 1, int(length * 1.1))
    return length


def width_of(length: int) -> int:
    """Shingles of a window for templates of a length: one such window begins early enough, and ends late enough, for any place."""
    return length + max(1, length // 4) - 1


def _bands(least: Callable[[Column], Column]) -> Column:
    """Band values of a window whose MinHash values are least(i): hashes of two of them and the band's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))


def _signature(hashes: Column) -> Column:
    """A row of further hashes of all shingles for each MinHash value."""
    return F.array(*[F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i))) for i in range(BANDS * ROWS)])


def _template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """(license, template, length, shingles, bands), a row for each template: a fixed, small table."""
    rows = []
    for name, texts in sorted(templates.items()):
        for i, text in enumerate(texts):
            shingles = [" ".join(s) for s in _shingles(text)]
            rows.append((name, i, grid(len(shingles)), shingles))
    frame = spark.createDataFrame(rows, "license string, template int, length int, texts array<string>")
    frame = frame.withColumn("shingles", F.transform("texts", lambda t: F.xxhash64(t))).drop("texts")
    return frame.withColumn("bands", _let(_signature(F.col("shingles")), lambda sig: _bands(lambda i: F.array_min(F.get(sig, i)))))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, template, containment, at) for each document and license notice it has.

    docs: doc_id, text; other columns are ignored. Texts are cut in runs of a-z and 0-9, lower-cased, and in shingles of
    five words. Overlapping windows of each length that templates have go over the shingles; a window whose MinHash agrees
    with a template's in a band is a candidate, and is verified, with its whole size more on both sides, by the exact share
    of the template's shingles that it has: `contained` or more. Windows without one of few words, without which none can
    have that share of any template, are passed over. containment is the best window's, `at` the first word's place of the
    earliest such window. Null and empty texts have none; a template of fewer than five words is one shingle; rows without
    doc_id are scanned too, as one document; repeated rows with one doc_id count as one document.

    All of it happens within rows of a text's shingles, SEGMENT at a time, against the few templates; only found notices are
    shuffled.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if not any(templates.values()):
        return spark.createDataFrame([], "doc_id long, license string, template int, containment double, at long")
    wanted = _template_table(spark, templates)
    known: dict[int, set[int]] = {}
    for row in wanted.select("length", "bands").collect():  # of the templates alone
        known.setdefault(row["length"], set()).update(row["bands"])
    around = max(map(width_of, known))
    some = anchors(templates, contained)
    pattern = "(?i)(?:" + "|".join(some) + ")"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").rlike(pattern))

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)])))

    def segments(w: Column, hs: Column) -> Column:
        """Parts of a text's shingles, of those that may have a notice: the place of the first window, what windows reach and
        what is verified before and behind them, where that begins, and where the few words stand."""

        def segment(at: Column) -> Column:
            base, end = F.greatest(at - around, F.lit(0)), F.least(at + SEGMENT + around + SHINGLE, F.size(w)) - 1
            inside = F.slice(hs, base + 1, at - base + SEGMENT + 3 * around)
            marks = F.filter(F.transform(F.sequence(at, F.greatest(at, end)), lambda i: F.when(F.get(w, i).isin(some), i)), lambda i: i.isNotNull())
            return F.struct(at.alias("at"), base.alias("base"), inside.alias("hs"), F.size(hs).alias("n"), marks.alias("marks"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(hs) - 1, F.lit(SEGMENT)), segment), lambda x: F.size(x["marks"]) > 0)

    def candidates(sig: Column) -> Column:
        found = []
        for length in sorted(known):
            step, width, at = max(1, length // 4), width_of(length), F.col("at")
            first, last = F.ceil(at / step).cast("int") * step, F.least(at + SEGMENT, F.col("n")) - 1

            def around_mark(m: Column) -> Column:  # these are called before the next length is taken
                lo = F.greatest(F.ceil((m - (width + SHINGLE - 2)) / step).cast("int") * step, first)
                hi = F.least(m, last)
                return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi), F.lit(step))).otherwise(F.array().cast("array<int>"))

            def window(k: Column) -> Column:
                bands = _bands(lambda i: F.array_min(F.slice(F.get(sig, i), k - at + 1, F.lit(width))))
                return F.struct(F.lit(length).alias("length"), k.alias("place"), bands.alias("bands"))

            places, own = F.array_distinct(F.flatten(F.transform("marks", around_mark))), sorted(known[length])
            found.append(F.filter(F.transform(places, window), lambda w: F.exists(w["bands"], lambda b: b.isin(own))))
        return F.concat(*found)

    made = _let(_words(F.col("text")), lambda w: _let(hashes(w), lambda hs: segments(w, hs)))
    cut = texts.select("doc_id", F.inline(made).alias("at", "base", "hs", "n", "marks"))
    reached = F.slice("hs", F.col("at") - F.col("base") + 1, F.lit(SEGMENT + around))
    met = cut.select("doc_id", "base", "hs", F.inline(_let(_signature(reached), candidates)).alias("length", "place", "bands"))
    joined = met.join(F.broadcast(wanted.withColumnRenamed("bands", "template_bands")), "length").filter(F.arrays_overlap("bands", "template_bands"))
    width = F.col("length") + F.greatest(F.floor(F.col("length") / 4), F.lit(1)).cast("int") - 1
    start = F.greatest(F.col("place") - width, F.lit(0))
    own = F.slice("hs", start - F.col("base") + 1, F.col("place") - start + 2 * width)
    with_own = joined.select("doc_id", "license", "template", "shingles", start.alias("start"), own.alias("own"))
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    first = F.array_min(F.transform("own", lambda h, i: F.when(F.array_contains("shingles", h), i)))
    verified = with_own.select("doc_id", "license", "template", share.alias("containment"), (F.col("start") + first).alias("at")).filter(F.col("containment") >= contained)
    best = F.max(F.struct("containment", (-F.col("at")).alias("early"))).alias("best")
    rows = verified.groupBy("doc_id", "license", "template").agg(best)
    return rows.select("doc_id", "license", "template", F.col("best.containment").alias("containment"), (-F.col("best.early")).cast("long").alias("at"))
