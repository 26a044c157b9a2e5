"""Licence scans by a trained paragraph classifier, with DataFrame functions alone over the corpus.

A text is split into paragraphs at blank lines and at line breaks that follow the end of a sentence, so a
wrapped notice stays in one piece. A paragraph's distinct word unigrams and bigrams are the sparse features
of a multinomial logistic regression over licence families and one class for everything else. Features are
the n-grams of the names and notices below, without words that are common in the corpus; all other n-grams
have weight zero. The regression is fitted on the driver from altered notices and from a bounded number of
the corpus' own paragraphs; its probabilities are calibrated by one temperature on rows left out of the
fit. Of a predicted family, the texts of its names and notices confirm the prediction.

A paragraph without any word of the features scores exactly the bias, which is the class of everything
else. So only paragraphs with such a word have their n-grams joined to the weight table, and no verdict
depends on that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm.work import drawn, folder, written

SAMPLE_TEXTS = 200  #: most texts whose paragraphs are drawn as examples of everything else
SAMPLE_PARAGRAPHS = 2000  #: most paragraphs of these texts
COMMON = 0.01  #: words in more than this share of drawn paragraphs are no features
UNKNOWN = "unknown"
SURE = 0.5  #: least probability of a family
CONFIRMED = 0.6  #: least share of a notice's words; of a name, all words are needed

# Names and notices of common public licences, by family.
NAMES: dict[str, list[str]] = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL-3.0", "Affero GPL version 3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Licence", "Apache 2.0", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause", "Modified BSD License"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "GNU GPL version 2"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL v2.1", "LGPL-3.0-or-later"],
    "mit": ["MIT License", "MIT", "Expat License", "MIT/Expat licence"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "proprietary": ["rights reserved", "rights are reserved worldwide"],
    "unlicense": ["Unlicense"],
}
NOTICES: dict[str, list[str]] = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": [
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "Copyright 2021 by the publisher, all rights reserved worldwide.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# How names are put, and sentences that use a licence's words for something else.
CARRIERS = [
    "{}", "License: {}", "SPDX-License-Identifier: {}", "Distributed under {}.", "This project is available under the {}.", "Covered by the {}, see the file for details.",
    "You may use this text under the terms of the {}.", "Code and texts are under {}.", "It is made available to all under the {}, without charge.", "The {} applies to this work.",
]
OTHER = [
    "He lost his driving license last year.",
    "She is a licensed physician with a private practice.",
    "The film was released under another title.",
    "The version published in the general press was distributed to the public.",
    "Permission to enter the building was granted by the guard.",
    "The warranty covers repairs for two years.",
    "Copyright law is a subject of the second year.",
    "They asked for permission to use the hall free of charge.",
    "The committee reserved all the rooms.",
    "A license fee is due every year.",
    "An open letter on the rights of the public.",
    "The software was redistributed to all schools.",
    "The creative commons of the village, by the river.",
    "Version 2.0 of the report is a work for the public.",
    "Apache is the name of a people, and Mozilla of a company.",
    "A copy of the above list is free of charge for any person.",
]

#: never features alone, however rare in a sample: function words and digits
PLAIN = set("the of to a and in is it this that for with by or on as at be are an may you all any not no from have its use see".split()) | set("0123456789")

_WORD = re.compile(r"[a-z0-9]+")
_BREAK = r"(?<=[.!?])[ \t]*\r?\n|\n[ \t\r]*\n\s*"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(text: str) -> set[str]:
    words = words_of(text)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Classifier:
    classes: list[str]
    grams: list[str]
    weight: np.ndarray  #: class x gram, temperature included
    bias: np.ndarray
    temperature: float

    def words(self) -> list[str]:
        """Words of which every feature holds one at least."""
        single = {g for g in self.grams if " " not in g}
        return sorted(single)

    def probabilities(self, text: str) -> np.ndarray:
        """Of the classes, for one paragraph."""
        own = grams_of(text)
        z = self.bias + self.weight[:, [i for i, g in enumerate(self.grams) if g in own]].sum(1)
        p = np.exp(z - z.max())
        return p / p.sum()


def examples(rng: np.random.Generator) -> list[tuple[str, str]]:
    """Family and text of names in their carriers, and of notices whole, with words left out, or in part."""
    out = [(f, c.format(n)) for f, names in NAMES.items() for n in names for c in CARRIERS]
    for f, notices in NOTICES.items():
        for t in notices:
            words = t.split()
            out += [(f, t), (f, f"Copyright 2020 the authors. {t}"), (f, f"{t} See the file for details.")]
            out += [(f, " ".join(w for w in words if rng.random() > 0.15)) for _ in range(12)]
            if len(words) > 12:
                third = len(words) // 3
                out += [(f, " ".join(words[a:b])) for a, b in ((0, 2 * third), (third, None), (0, third + 6))] * 3
    return out


def candidate_grams() -> set[str]:
    """N-grams of all names and notices."""
    return {g for t in [x for group in (NAMES, NOTICES) for ts in group.values() for x in ts] for g in grams_of(t)}


def confirmed_by(words: set[str]) -> bool:
    """Whether the words hold all of a name (of two words or more that aren't plain), or enough of a notice."""
    names = (set(words_of(t)) for ts in NAMES.values() for t in ts)
    notices = (set(words_of(t)) for ts in NOTICES.values() for t in ts)
    return any(len(n - PLAIN) > 1 and n <= words for n in names) or any(len(n & words) >= CONFIRMED * len(n) for n in notices)


def train(other: Iterable[set[str]], seed: int = 3, steps: int = 300) -> Classifier:
    """Fit the regression and its temperature. ``other``: n-grams of paragraphs of the corpus, of the class of everything else but
    for those that a name or notice confirms, which are left out. Words that are common in the others are no features."""
    rng = np.random.default_rng(seed)
    other = [frozenset(x) for x in other if not confirmed_by({g for g in x if " " not in g})]
    texts = examples(rng)
    count: dict[str, int] = {}
    for own in other:
        for g in own:
            count[g] = count.get(g, 0) + 1
    least = max(2.0, COMMON * len(other))
    common = {g for g, n in count.items() if n > least and " " not in g} | PLAIN
    # a bigram counts only with a word that is a feature itself
    grams = sorted(g for g in candidate_grams() if not set(g.split()) <= common)
    classes = [*sorted({*NAMES, *NOTICES}), UNKNOWN]
    index = {g: i for i, g in enumerate(grams)}
    last = len(classes) - 1

    weighed: dict[tuple[frozenset[str], int], float] = {}
    rows = [(frozenset(grams_of(t) & index.keys()), classes.index(f)) for f, t in texts]
    rows += [(frozenset(grams_of(t) & index.keys()), last) for t in OTHER] * 4
    rows += [(frozenset(x & index.keys()), last) for x in other] + [(frozenset(), last)]
    for r in rows:
        weighed[r] = weighed.get(r, 0.0) + 1.0
    keys = sorted(weighed, key=lambda r: (r[1], sorted(r[0])))
    x = np.zeros((len(keys), len(grams)), np.float32)
    for i, (own, _) in enumerate(keys):
        x[i, [index[g] for g in own]] = 1
    y = np.array([k for _, k in keys])
    n = np.minimum(np.array([weighed[k] for k in keys]), 20.0)
    share = np.bincount(y, weights=n, minlength=len(classes))
    sample = (n / np.maximum(share, 1)[y]).astype(np.float32)
    sample[y == last] *= len(classes) / 2
    left_out = rng.random(len(keys)) < 0.15
    one = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(classes), len(grams)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    xf, of, sf = x[~left_out], one[~left_out], sample[~left_out, None]
    for _ in range(steps):
        z = xf @ w.T + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - of) * sf
        vw = 0.9 * vw - 0.4 * (d.T @ xf / len(classes) + 1e-4 * w)
        vb = 0.9 * vb - 0.4 * d.sum(0) / len(classes)
        w, b = w + vw, b + vb

    def loss(t: float) -> float:
        z = (x[left_out] @ w.T + b) / t
        z -= z.max(1, keepdims=True)
        return float((sample[left_out] * (np.log(np.exp(z).sum(1)) - z[np.arange(left_out.sum()), y[left_out]])).sum())

    t = min(np.geomspace(0.2, 5, 41), key=loss)
    return Classifier(classes, grams, w.astype(float) / t, b.astype(float) / t, float(t))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Distinct unigrams and bigrams."""
    inner = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), inner), F.slice(words, F.lit(2), inner), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``paragraph`` (its number from 0) and ``words`` of every paragraph with a word."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), _BREAK)).alias("paragraph", "text"))
    return rows.select("id", "paragraph", _words(F.col("text")).alias("words")).where(F.size("words") > 0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> Classifier:
    """Train with at most ``sample_paragraphs`` paragraphs of at most ``sample_texts`` texts, both drawn by a hash. Of a paragraph,
    only n-grams of the names and notices come to the driver, so their size is bounded, too."""
    ids = drawn(docs.select(id_col).where(F.col(id_col).isNotNull()), id_col, sample_texts).distinct()
    texts = docs.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi")
    known = F.lit(sorted(candidate_grams()))
    own = paragraphs(texts, id_col, text_col).select(F.xxhash64("words", "paragraph", "id").alias("key"), F.array_intersect(_grams(F.col("words")), known).alias("grams"))
    return train([set(r["grams"]) for r in sorted(drawn(own, "key", sample_paragraphs).collect(), key=lambda r: (r["key"], sorted(r["grams"])))])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph that is more likely than not a licence: id, ``paragraph`` (its number from 0), ``family`` (``unknown`` where no
    family reaches ``SURE``), ``probability`` of the family (of any licence, where unknown), ``similarity`` to the nearest name or
    notice of the family (share of its words) and ``confirmed``.

    Null, empty and other texts give no rows. Of families of equal probability, the first by name is taken. A paragraph of any length is
    scored whole. Repeated rows and null ids are scanned row by row; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    features = model.words()
    some = paragraphs(docs, id_col, text_col).where(F.exists("words", lambda w: w.isin(features)))
    # the number of a row holds once it is written
    some = written(some.withColumn("row", F.monotonically_increasing_id()), f"{folder(spark)}/paragraphs")
    each = some.select("row", F.explode(_grams(F.col("words"))).alias("gram")).join(F.broadcast(_weights(spark, model)), "gram")
    k = len(model.classes)
    sums = each.groupBy("row").agg(*((F.sum(F.col("w")[i]) + float(model.bias[i])).alias(f"z{i}") for i in range(k)))
    z = F.array(*(f"z{i}" for i in range(k)))
    p = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    sums = sums.select("row", F.transform(p, lambda v: v / total).alias("p"))
    family = F.slice("p", 1, k - 1)
    guess = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", F.array_max(family)).cast("int"))
    any_licence = 1 - F.element_at("p", k)
    found = sums.where(any_licence >= 0.5).select(
        "row",
        F.when(F.array_max(family) >= SURE, guess).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.when(F.array_max(family) >= SURE, F.array_max(family)).otherwise(any_licence).alias("probability"),
    )
    near = found.join(some, "row").join(F.broadcast(_templates(spark)), "family", "left")
    share = lambda t: F.size(F.array_intersect(t["words"], F.array_distinct("words"))) / F.size(t["words"])
    templates = F.coalesce("templates", F.array().cast(_TEMPLATES))
    similarity = F.coalesce(F.array_max(F.transform(templates, share)), F.lit(0.0))
    confirmed = F.exists(templates, lambda t: share(t) >= t["least"])
    return near.select(F.col("id").alias(id_col), "paragraph", "family", "probability", similarity.alias("similarity"), confirmed.alias("confirmed"))


_TEMPLATES = "array<struct<least:double,words:array<string>>>"


def _weights(spark: SparkSession, model: Classifier) -> DataFrame:
    rows = [(g, [float(v) for v in model.weight[:, i]]) for i, g in enumerate(model.grams)]
    return spark.createDataFrame(rows, "gram string, w array<double>")


def _templates(spark: SparkSession) -> DataFrame:
    """Words of the names, all of which are needed, and of the notices."""
    kinds = ((NAMES, 1.0), (NOTICES, CONFIRMED))
    rows = [(f, [(least, sorted(set(words_of(t)))) for group, least in kinds for t in group.get(f, [])]) for f in sorted({*NAMES, *NOTICES})]
    kind = T.StructType([T.StructField("least", T.DoubleType()), T.StructField("words", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(rows, T.StructType([T.StructField("family", T.StringType()), T.StructField("templates", T.ArrayType(kind))]))
