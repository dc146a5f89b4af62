"""License scans: sparse word n-gram logistic regression over paragraphs, with an unknown class and a template comparison.

The model is small and fixed by the texts below: it is fitted on the driver once.
The scan is made of DataFrame functions only. A paragraph is a run of lines in
which each but the last is a wrapped one: not longer than ``WRAPPED`` characters,
not followed by an empty line, and without the end of a sentence at its end.

Every paragraph gets the class that the model gives it. Most need no sum for
that: a class other than none needs an n-gram that speaks for it, so a paragraph
without a word of such n-grams (:func:`key_words`) is none whatever else it holds.

The comparison that confirms a family doesn't use the model: the paragraph holds
a name of the family next to the words of a notice, or most of a sentence of the licence.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import literal, quoted, spare, written

#: Characters of a line that may go on in the next.
WRAPPED = 120
#: Function words: an n-gram of nothing else is no feature.
FUNCTION_WORDS = frozenset("a above all an and any are as at be been by can do for from had has have he her his i if in is it its may more most must no nor not of on one only or other our shall she so some such than that the their there these they this those to under was we were what when which who whom will with without would you your".split())

#: Names that licence families go by.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL-3.0", "AGPLv3", "GNU Affero General Public License, version 3", "AGPL-3.0-or-later"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License", "ASL 2.0"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Simplified BSD License", "Modified BSD License"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons NonCommercial license"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons ShareAlike license"],
    "cc0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GPL-2.0-only"],
    "isc": ["ISC License", "ISC", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL-3.0", "LGPL-2.1", "LGPLv3", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT", "MIT license terms", "Expat License", "MIT/X11 License", "X11 License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License, version 2.0"],
    "proprietary": ["proprietary license", "commercial license agreement", "end user license agreement", "proprietary and confidential terms"],
    "unlicense": ["Unlicense", "The Unlicense", "Unlicense terms"],
}
OTHER = ["Zlib License", "Artistic License 2.0", "Eclipse Public License", "EPL-2.0", "Common Development and Distribution License", "CDDL", "Boost Software License", "PostgreSQL License", "Python Software Foundation License", "SIL Open Font License", "Open Software License", "Academic Free License", "European Union Public Licence", "Microsoft Public License", "Ruby License", "Vim license", "license of the authors", "license in the file LICENSE", "terms of the license", "Open Database License", "same license as the original"]
NOTICES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the {}.",
    "This file is distributed under the terms of the {}.", "This project is licensed under the {} - see the LICENSE file for details.", "License: {}", "The code is available under the {}.",
    "This software is released under the {}, see LICENSE.", "SPDX-License-Identifier: {}", "Published under a {}.", "You may use this under the terms of the {}.", "All content is available under {} unless otherwise noted.", "{}", "It is free software under the {}; see the file COPYING.",
]
#: Sentences of the licences themselves: fixed values.
TEXTS = {
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."],
    "cc-by": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "You may not use the material for commercial purposes under this Creative Commons license."],
    "cc-by-sa": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited without written permission.", "This software is proprietary and confidential and may not be redistributed without a license."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means, without a license.", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."],
}
NONE_TEXTS = [
    "He lost his driving license in the spring.", "The pub applied for a new licence last year.", "A fishing license costs twenty euros.", "She asked for permission to leave the room.", "The warranty covers all parts for two years.", "Police issued a warrant for his arrest.",
    "Copyright law was debated in parliament.", "The museum gave permission to film inside.", "Apache helicopters flew over the valley.", "The Apache people lived in the southwest.", "The wealth was redistributed among the poor.", "Licensed electricians must renew every year.", "You need a license plate for the trailer.",
    "The state redistributes taxes to the regions.", "Such claims warrant further study.", "No permission was given for the march.", "The liquor license was revoked by the council.", "His poetic license was admired by critics.", "The lake is in the public domain of the state.", "Drivers without a licence were fined.",
]
#: Sentences in which a name stands for something else: {} is the first word of a licence's name.
ELSEWHERE = [
    "The {} people lived in the valley for centuries.", "She met a {} professor at a conference on law.", "Two {} helicopters flew over the town.", "He wrote a book about the history of {}.", "A {} team won the race last year.", "The museum shows {} art and asks for permission to film.",
    "Students at {} built a robot.", "The rights of the {} nation were debated in court.", "{} is a word that many people know.", "The {} river floods in spring.", "They moved from {} to the coast.", "He has a driving licence and works for {}.",
    "the {}", "of {} and", "in {}", "a {} or", "by the {}", "{}", "{} {}",
]
CLASSES = [*NAMES, "unknown", "none"]
#: A family with less than this calibrated probability is unknown; a comparison with a sentence of a licence needs this share of its n-grams.
LEAST_PROBABILITY, LEAST_SHARE = 0.6, 0.6
#: What stands next to a name in a notice: fixed values.
CUES = ["licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "redistributed under", "provided under", "covered by", "subject to", "terms of", "software under", "spdx license identifier", "license", "licence", "lizenz", "licencia"]
#: Paragraphs whose verdicts are broadcast, by their number and characters; beyond, they are shuffled to the lines, ``SALTS`` copies each.
MOST_ROWS, MOST_CHARS, SALTS = 100_000, 32 << 20, 16
#: The German word and the institute are written the same in lower case.
_UPPER, _UPPER_TO = r"\bMIT\b", "MIT.x"
_WORD = r"[a-z0-9][a-z0-9.+]*"


def paragraphs(text: str) -> list[str]:
    """The plain version of :func:`_paragraphs`."""
    lines = text.replace("\r", "").split("\n")
    out = lines[:1]
    for before, line in zip(lines, lines[1:], strict=False):
        if line and 1 <= len(before) <= WRAPPED and before[-1] not in ".!?:;":
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def words_of(paragraph: str) -> list[str]:
    return [w.rstrip(".+") for w in re.findall(_WORD, re.sub(_UPPER, _UPPER_TO, paragraph, flags=re.A).lower())]


def grams_of(paragraph: str) -> set[str]:
    """Distinct words and pairs of neighbouring words, without those of function words alone."""
    words = words_of(paragraph)
    return {g for g in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) if not FUNCTION_WORDS.issuperset(g.split(" "))}


def examples() -> list[tuple[str, str]]:
    # one plain word alone is no statement
    out = [(notice.format(name), family) for family, names in NAMES.items() for name in names for notice in NOTICES if notice != "{}" or not name.isalpha()]
    out += [(text, family) for family, texts in TEXTS.items() for text in texts]
    out += [(notice.format(name), "unknown") for name in OTHER for notice in NOTICES if notice != "{}"]
    first = sorted({name.split()[0].split("-")[0].split("/")[0] for names in NAMES.values() for name in names if name[0].isupper()} - {name for names in NAMES.values() for name in names if any(c.isdigit() for c in name)})
    return out + [(text.format(word, word), "none") for word in first for text in ELSEWHERE] + [(text, "none") for text in NONE_TEXTS]


@functools.cache
def model(seed: int = 0) -> tuple[dict[str, list[float]], list[float]]:
    """(weights of each n-gram for ``CLASSES``, their intercepts).

    Softmax regression, sparse by soft thresholds. A fifth of the
    examples is kept from it before the rest are copied with words left
    out at random; the weights are scaled by the temperature that makes that fifth likeliest.
    """
    rng = random.Random(seed)
    base = examples()
    rng.shuffle(base)
    # ordinary sentences are too few to keep some back
    apart = [k % 5 == 4 and text not in NONE_TEXTS for k, (text, _) in enumerate(base)]
    kept = [x for x, own in zip(base, apart, strict=True) if own]
    rows = []
    for text, family in (x for x, own in zip(base, apart, strict=True) if not own):
        words = text.split()
        rows += [(text, family)] * (4 if text in NONE_TEXTS else 1)
        # names stay whole: without one word they are those of other families
        rows += [(" ".join(w for w in words if not w[0].islower() or rng.random() > 0.15), family) for _ in range(1 if len(words) < 12 else 5) if len(words) > 3]
        # a wrapped sentence may be cut
        rows += [(" ".join(words[k : k + max(8, len(words) // 2)]), family) for k in range(0, len(words) - 7, 4) if len(words) >= 16]
    counts = Counter(g for text, _ in rows for g in grams_of(text))
    vocabulary = sorted(g for g, n in counts.items() if n >= 3)
    place = {g: k for k, g in enumerate(vocabulary)}

    def table(part: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(part), len(vocabulary) + 1), np.float32)
        x[:, -1] = 1
        for i, (text, _) in enumerate(part):
            x[i, [place[g] for g in grams_of(text) if g in place]] = 1
        return x, np.array([CLASSES.index(f) for _, f in part])

    x, y = table(rows)
    none = CLASSES.index("none")
    w = np.zeros((x.shape[1], len(CLASSES)), np.float32)
    w[-1, none] = 1
    speed, target = np.zeros_like(w), np.eye(len(CLASSES), dtype=np.float32)[y]
    weight = (np.bincount(y, minlength=len(CLASSES)) ** -0.5)[y][:, None].astype(np.float32)
    weight /= weight.sum()
    for _ in range(1000):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 3.0 * (x.T @ ((p - target) * weight))
        w += speed
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 1.5e-4, 0)
        # a paragraph without a known n-gram is no licence
        w[-1, none] = max(w[-1, none], w[-1, :none].max() + 0.6)
    x, t = table(kept)
    z = x @ w

    def loss(scale: float) -> float:
        s = z * scale
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(t)), t]).mean())

    w = w * min((k / 4 for k in range(1, 17)), key=loss)
    return {g: [round(float(v), 4) for v in w[k]] for g, k in place.items() if w[k].any()}, [round(float(v), 4) for v in w[-1]]


@functools.cache
def key_words() -> tuple[str, ...]:
    """Words of the n-grams that speak for any class against none; a paragraph without them is none."""
    none = CLASSES.index("none")
    weights, bias = model()
    if max(bias) > bias[none]:
        raise AssertionError("a paragraph without n-grams is none")
    return tuple(sorted({w for g, v in weights.items() if max(v) > v[none] for w in g.split(" ")} - FUNCTION_WORDS))


@functools.cache
def templates() -> tuple[dict[str, list[str]], list[tuple[str, list[str]]]]:
    """(family -> its names as words, those that no other family or licence has within a name of its own; (family, n-grams) of the sentences of licences)."""
    names = {family: sorted({" ".join(words_of(n)) for n in own}) for family, own in NAMES.items()}
    return names, [(family, sorted(grams_of(text))) for family, texts in TEXTS.items() for text in texts if len(grams_of(text)) >= 4]


def longest_name(words: str) -> str | None:
    """The family of the longest name in a paragraph's words, ties to the first family: "gnu lesser general public license" is no "general public license"."""
    found = [(-len(n), family) for family, own in templates()[0].items() for n in own if f" {n} " in f" {words} "]
    return min(found)[1] if found else None


def classify(paragraph: str) -> tuple[str, float, bool] | None:
    """The plain version of the scan for one paragraph: (class, probability, confirmed), or None if it is no licence statement."""
    weights, bias = model()
    grams, words = grams_of(paragraph), " ".join(words_of(paragraph))
    z = [bias[k] + sum(weights[g][k] for g in sorted(grams) if g in weights) for k in range(len(CLASSES))]
    p = [float(np.exp(v - max(z))) for v in z]
    best = max(range(len(CLASSES)), key=lambda k: (z[k], -k))
    share, family = p[best] / sum(p), CLASSES[best]
    if family == "none":
        return None
    if family == "unknown" or share < LEAST_PROBABILITY:
        return "unknown", share, False
    named = longest_name(words)
    noted = named == family and (any(f" {c} " in f" {words} " for c in CUES) or words in templates()[0][family])
    shares = {f: max(len(grams.intersection(own)) / len(own) for g, own in templates()[1] if g == f) for f, _ in templates()[1]}
    near = shares.get(family, 0) >= max(LEAST_SHARE, *shares.values())
    return family, share, noted or (near and named in (None, family))


def _paragraphs(text: Column) -> Column:
    # the line end comes first, so that nothing is looked back from other places
    plain = F.translate(text, "\r", "")
    return F.split(F.regexp_replace(plain, rf"\n(?<=(?:^|\n)[^\n]{{0,{WRAPPED - 1}}}[^\n.!?:;]\n)(?=[^\n])", " "), "\n")


def _plain(paragraph: Column) -> Column:
    return F.lower(F.when(F.contains(paragraph, F.lit("MIT")), F.regexp_replace(paragraph, _UPPER, _UPPER_TO)).otherwise(paragraph))


def _words(paragraph: Column) -> Column:
    return F.transform(F.regexp_extract_all(_plain(paragraph), F.lit(f"({_WORD})"), 1), lambda w: F.rtrim(w, F.lit(".+")))


def _branches(words: list[str]) -> str:
    """An expression for any of some words that looks at each letter once."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[:1], []).append(w[1:])
    if "" in first:
        return ""
    return "(?:" + "|".join(re.escape(c) + _branches(rest) for c, rest in sorted(first.items())) + ")"


def _has_key(paragraph: Column) -> Column:
    """Whether a paragraph has a key word: first whether a word begins like one, which is cheap, then on the very words."""
    begins = rf"(?<![a-z0-9]){_branches(list(key_words()))}"
    return F.rlike(_plain(paragraph), F.lit(begins)) & F.arrays_overlap(_words(paragraph), F.array(*map(F.lit, key_words())))


def _grams(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def _any(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def statements(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``docs`` with a row number; their licence statements: _row, paragraph (from 0), family, probability, confirmed).

    Texts are read once, whole; what is written is the kept columns and the
    paragraphs with a key word. Null and empty texts have no statement; ties of classes go to the first;
    repeated rows are rows of their own; an empty table gives empty results.
    """
    spark = docs.sparkSession
    weights, bias = model()
    said = F.transform(_paragraphs(quoted(text_col)), lambda s, i: F.struct(i.alias("paragraph"), s.alias("said")))
    said = F.filter(said, lambda x: _has_key(x["said"]))
    if "_row" in keep:
        raise ValueError("_row is the row number of the result")
    [found] = spare(list(keep), "said")
    rows = written(docs.select(*map(quoted, keep), F.monotonically_increasing_id().alias("_row"), said.alias(found)), "licenses")
    # a paragraph that many documents share is classified once
    each = rows.select("_row", F.inline(found))
    own = each.select("said").distinct().withColumn("words", _words(F.col("said"))).withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    # these tables come from the fixed texts above: a few thousand rows, whatever the corpus
    names, texts = templates()
    of_text: dict[str, list[int]] = {}
    for k, (_, grams) in enumerate(texts):
        for g in grams:
            of_text.setdefault(g, []).append(k)
    table = literal(spark, [(g, weights.get(g, [0.0] * len(CLASSES)), of_text.get(g, [])) for g in sorted({*weights, *of_text})], "gram string, w array<double>, texts array<int>")
    grams = own.select("said", F.explode_outer(_grams(F.col("words"))).alias("gram")).join(F.broadcast(table), "gram")
    sums = grams.groupBy("said").agg(
        *(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(CLASSES))),
        *(F.count_if(F.array_contains("texts", k)).alias(f"t{k}") for k in range(len(texts))),
    )
    z = F.array(*(F.round(F.col(f"z{k}") + bias[k], 9) for k in range(len(CLASSES))))
    share = lambda family: F.array_max(F.array(*(F.lit(0.0), *(F.col(f"t{k}") / len(g) for k, (f, g) in enumerate(texts) if f == family))))
    sums = sums.select("said", z.alias("z"), F.array(*map(share, names)).alias("shares"))
    top = F.array_max("z")
    sums = sums.withColumns({"best": F.array_position("z", top).cast("int"), "probability": 1 / F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)})
    family = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("best"))
    known = (F.col("best") <= len(NAMES)) & (F.col("probability") >= LEAST_PROBABILITY)
    sums = sums.where(family != "none").join(own.select("said", "line"), "said")
    holds = lambda n: F.contains("line", F.lit(f" {n} "))
    named = functools.reduce(lambda rest, n: F.when(holds(n[1]), F.lit(n[2])).otherwise(rest), sorted(((-len(n), n, f) for f, own in names.items() for n in own), key=lambda x: (x[0], x[2]), reverse=True), F.lit(None).cast("string"))
    noted = F.coalesce(named == family, F.lit(False)) & (_any([holds(c) for c in CUES]) | _any([F.trim("line") == n for own in names.values() for n in own]))
    near = F.coalesce(F.try_element_at("shares", "best") >= F.greatest(F.lit(LEAST_SHARE), F.array_max("shares")), F.lit(False)) & F.coalesce(named == family, F.lit(True))
    confirmed = known & (noted | near)
    sums = written(sums.select("said", F.when(known, family).otherwise(F.lit("unknown")).alias("family"), "probability", confirmed.alias("confirmed")), "license-classes")
    size = sums.agg(F.count("*"), F.coalesce(F.sum(F.length("said")), F.lit(0))).first()
    if size[0] <= MOST_ROWS and size[1] <= MOST_CHARS:
        met = each.join(F.broadcast(sums), "said")
    else:
        # the documents of a common paragraph are dealt to several tasks
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["said", "salt"])
    return rows.drop(found), met.select("_row", "paragraph", "family", "probability", "confirmed")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, families (confirmed ones, sorted, comma-joined), n_confirmed, n_unconfirmed, n_unknown (paragraphs of each kind), best_probability (0 without a statement).

    One row for each row of ``docs``; null and empty texts have no statement;
    long texts are read whole; an empty table gives an empty result.
    """
    rows, found = statements(docs, **options)
    sums = found.groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if(F.col("confirmed")).alias("n_confirmed"),
        F.count_if((F.col("family") != "unknown") & ~F.col("confirmed")).alias("n_unconfirmed"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.max("probability").alias("best_probability"),
    )
    return rows.join(sums, "_row", "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_confirmed", "n_unconfirmed", "n_unknown")), F.coalesce("best_probability", F.lit(0.0)).alias("best_probability"))
