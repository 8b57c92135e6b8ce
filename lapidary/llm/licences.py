"""Licence scan: a trained paragraph classifier, confirmed by comparison with the templates of the family it names and
by the n-grams that name the family and its version.

A sparse softmax regression over word n-grams (one to three words, presence only) scores each paragraph for each
licence family and for "unknown". It is fitted on the driver on a bounded set: the given templates, seeded variants of
them with words left out, added and cut off, sentences that only use the same vocabulary, and at most ``sample`` paragraphs of
as many corpus texts, both first by hash, as unknown ones. Proximal steps keep the weights sparse; a temperature fitted on held-out rows
calibrates the probabilities, of the unknown class too.

On the corpus all work is native expressions. A paragraph can only leave "unknown" if it holds one of the anchor
words: each n-gram is charged to its rarest word, and anchors are chosen so that all that is charged to the other words
cannot outweigh the unknown class (an exact bound, as each n-gram counts once). So paragraphs without an anchor need
no scoring. The others are joined n-gram by n-gram with the weight table, whose size is bounded by the templates, and
summed per paragraph.

Defined results: paragraphs are the lines of a text; null and empty texts have none. Words are runs of a-z, 0-9 with
single marks . + - inside, in lower case. Rows that agree in id and text count once. Ties go to the first family by name.
Without corpus paragraphs the templates and variants alone are fitted. Very long texts are scanned whole, line by line.
An empty table gives an empty result. Only id and text are read, so names of other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import first_by, written

WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WIDTHS = (1, 2, 3)
SAMPLE, VARIANTS, SEED = 1500, 24, 17
UNKNOWN = "unknown"
MIN_CONTAINMENT = 0.6

#: Production templates: notices as the licences' stewards word them.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-2-clause": [
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 2-Clause License.",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nc-nd-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is marked with CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        # Without a version any published one can be chosen.
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
#: N-grams that name a family and its version. A paragraph is confirmed by a template only if it holds those that the template holds.
MARKS: dict[str, list[str]] = {
    "agpl-3.0": ["gnu affero general", "version 3", "agpl-3.0-only"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2.0": ["apache", "2.0", "apache-2.0"],
    "bsd-2-clause": ["bsd 2-clause", "bsd-2-clause"],
    "bsd-3-clause": ["bsd 3-clause", "bsd-3-clause"],
    "cc-by-4.0": ["attribution 4.0", "cc by 4.0"],
    "cc-by-nc-4.0": ["attribution-noncommercial 4.0", "cc by-nc 4.0"],
    "cc-by-nc-nd-4.0": ["attribution-noncommercial-noderivatives 4.0", "cc by-nc-nd 4.0"],
    "cc-by-nc-sa-4.0": ["attribution-noncommercial-sharealike 4.0", "cc by-nc-sa 4.0"],
    "cc-by-nd-4.0": ["attribution-noderivatives 4.0", "cc by-nd 4.0"],
    "cc-by-sa-4.0": ["attribution-sharealike 4.0", "cc by-sa 4.0"],
    "cc0-1.0": ["waived all copyright", "cc0 1.0", "cc0-1.0"],
    "gpl-2.0": ["gnu general public", "version 2", "gpl-2.0-only"],
    "gpl-3.0": ["gnu general public", "version 3", "gpl-3.0-only"],
    "isc": ["isc"],
    "lgpl-2.1": ["gnu lesser general", "version 2.1", "lgpl-2.1-only"],
    "lgpl-3.0": ["gnu lesser general", "version 3", "lgpl-3.0-only"],
    "mit": ["mit"],
    "mpl-2.0": ["mozilla", "2.0", "mpl-2.0"],
    "unlicense": ["public domain", "unlicense"],
}
#: Sentences with the same vocabulary that name no licence.
NEAR_MISSES = [
    "A driving license is required for this work.",
    "The version of the program is 3.",
    "The doctor is licensed in this state.",
    "The general public may use the library free of charge.",
    "The work was released under pressure in version 2.0 of the plan.",
    "Attribution of the painting is a matter of dispute.",
    "Please renew your license before the end of the year.",
    "The permission is granted to any person on request.",
    "The right to speak is reserved for members.",
    "All seats are reserved and all rights of way are open.",
    "The author has waived the fee to the extent possible.",
    "The source of the work is in the public library.",
    "The form is subject to the terms of the contract.",
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: Sequence[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in WIDTHS for i in range(len(words) - n + 1)}


def _naming(words: frozenset[str]) -> set[str]:
    """The words of all marks that stand wholly in ``words``."""
    return {w for marks in MARKS.values() for m in marks if words.issuperset(m.split(" ")) for w in m.split(" ")}


def _variants(template: str, filler: list[str], rng: np.random.Generator) -> list[list[str]]:
    """The template's words, whole and then with up to a fifth left out, cut at an end, or among other words.

    Words that name a family are not left out: without them a notice is an example of none.
    """
    words = words_of(template)
    naming = _naming(frozenset(words))
    found = [words]
    for i in range(VARIANTS - 1):
        kept = [w for w in words if rng.random() > 0.2 * (i % 3) / 2 or w in naming]
        if i % 4 == 3:
            kept = kept[: max(3, len(kept) * 3 // 4)]
        around = [filler[j] for j in rng.integers(0, len(filler), 2 * (i % 5))] if filler else []
        found.append(around[: len(around) // 2] + (kept or words) + around[len(around) // 2 :])
    return found


class Model:
    """Weights per n-gram and class, biases and temperature; class 0 is unknown. ``common`` counts words of plain text."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float, common: Mapping[str, int]):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature
        in_templates = Counter(w for g in weights for w in g.split(" "))
        self.rank = {w: (common.get(w, 0), n, -len(w), w) for w, n in in_templates.items()}

    def margin(self, gram: str) -> np.ndarray:
        w = np.array(self.weights[gram])
        return w[1:] - w[0]

    def charges(self) -> dict[str, np.ndarray]:
        """The most that the n-grams charged to a word can add per family; each is charged to its rarest word."""
        found = {w: np.zeros(len(self.classes) - 1) for w in self.rank}
        for gram in self.weights:
            found[min(gram.split(" "), key=self.rank.get)] += np.maximum(self.margin(gram), 0)
        return found

    def anchors(self) -> list[str]:
        """The words without which no paragraph leaves the unknown class.

        From the commonest word on, words are left out as long as all that is charged to them cannot outweigh the
        unknown class for any family.
        """
        charges, found = self.charges(), []
        rest = np.array(self.bias[1:]) - self.bias[0]
        for word in sorted(charges, key=self.rank.get, reverse=True):
            if (rest + charges[word] < 0).all():
                rest = rest + charges[word]
            elif charges[word].any():
                found.append(word)
        return found


def fit(templates: Mapping[str, Sequence[str]], others: list[str], rounds: int = 400, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    classes = [UNKNOWN, *sorted(templates)]
    filler = sorted({w for t in others for w in words_of(t)})
    rows, target = [], []
    for number, family in enumerate(classes[1:], 1):
        for template in templates[family]:
            made = _variants(template, filler, rng)
            rows += made
            target += [number] * len(made)
    near = [v for t in NEAR_MISSES for v in _variants(t, filler, rng)]
    rows += near + [words_of(t) for t in others]
    target += [0] * (len(near) + len(others))
    columns = {g: i for i, g in enumerate(sorted(set().union(*(grams_of(words_of(t)) for ts in templates.values() for t in ts))))}
    x = np.zeros((len(rows), len(columns) + 1))
    x[:, -1] = 1
    for row, words in enumerate(rows):
        x[row, [columns[g] for g in grams_of(words) if g in columns]] = 1
    y = np.eye(len(classes))[target]
    held = np.arange(len(rows)) % 5 == 4
    say = (1 / y[~held].sum(axis=0))[np.array(target)[~held]] / len(classes)
    weights, rate = np.zeros((x.shape[1], len(classes))), 4.0
    for _ in range(rounds):
        logits = x[~held] @ weights
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= rate * (x[~held].T @ ((p - y[~held]) * say[:, None]))
        # sparse n-gram weights; the bias stays free
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - rate * 2e-4, 0)
    logits = x[held] @ weights

    def loss(temperature: float) -> float:
        z = logits / temperature
        z -= z.max(axis=1, keepdims=True)
        return float(-(y[held] * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum())

    temperature = min((float(t) for t in np.geomspace(0.2, 5, 40)), key=loss)
    used = {g: [round(float(w), 6) for w in weights[i]] for g, i in columns.items() if np.abs(weights[i]).max() > 0}
    common = Counter(w for t in [*others, *NEAR_MISSES] for w in set(words_of(t)))
    return Model(classes, used, [round(float(b), 6) for b in weights[-1]], round(temperature, 6), common)


def train(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """``docs`` has ``text``. Paragraphs with a word that marks licences in nearly any wording are no unknown examples."""
    some = first_by(docs.select("text"), F.xxhash64(F.lit(seed), "text"), sample)
    lines = some.select(F.explode_outer(F.split("text", "\n")).alias("line")).filter("length(line) between 1 and 1000")
    plain = lines.filter(~F.lower("line").rlike("licen[sc]e|copyright|spdx|permission|rights reserved|redistribution and use|free software|public domain")).select("line")
    # Bounded: at most `sample` lines of at most 1000 characters.
    others = plain.select(F.xxhash64(F.lit(seed), "line").alias("order"), "line").distinct().orderBy("order", "line").limit(sample)
    return fit(templates, [r.line for r in others.collect()], seed=seed)


def _grams(words: Column) -> Column:
    def of_width(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))

    return F.array_distinct(F.concat(*map(of_width, WIDTHS)))


def _known(templates: Mapping[str, Sequence[str]], marks: Mapping[str, Sequence[str]]) -> list[tuple]:
    """Family, n-grams, marks needed, and for a template without a version the versions of its family, for each template."""
    found = []
    for family, texts in sorted(templates.items()):
        for grams in (grams_of(words_of(t)) for t in texts):
            versions = [m for m in marks.get(family, ()) if m.startswith("version ")]
            found.append((family, sorted(grams), [m for m in marks.get(family, ()) if m in grams], [] if grams.intersection(versions) else versions))
    return found


def scan(
    docs: DataFrame, model: Model, templates: Mapping[str, Sequence[str]] = TEMPLATES, min_containment: float = MIN_CONTAINMENT,
    marks: Mapping[str, Sequence[str]] = MARKS,
) -> DataFrame:
    """``doc_id, paragraph, text, family, probability, containment, confirmed`` of paragraphs that are not unknown.

    ``docs`` has ``doc_id, text``; ``paragraph`` counts lines from 0. A paragraph is confirmed if it holds at least
    ``min_containment`` of a template of its family and all ``marks`` of the family that the template holds; by a
    template without a version only if it states none or the family's.
    """
    spark = docs.sparkSession
    out = "doc_id {}, paragraph int, text string, family string, probability double, containment double, confirmed boolean"
    anchors = model.anchors()
    if not anchors:
        return spark.createDataFrame([], out.format(docs.schema["doc_id"].dataType.simpleString()))
    anchored = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(anchors)) + ")(?![a-z0-9])"
    some = docs.select("doc_id", "text").filter(F.lower("text").rlike(anchored))
    lines = some.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    marked = written(lines.filter(F.lower("text").rlike(anchored)).distinct(), "paragraphs")

    k = len(model.classes)
    columns = [f"w{i}" for i in range(k)]
    table = spark.createDataFrame([(g, *w) for g, w in sorted(model.weights.items())], "gram string, " + ", ".join(f"{c} double" for c in columns))
    paragraph = ["doc_id", "copy", "paragraph"]
    # Bounded: the n-grams of the templates.
    listed = marked.withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    hits = listed.select(*paragraph, "text", F.explode(_grams(F.col("w"))).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy(*paragraph, "text").agg(*[F.sum(c).alias(c) for c in columns])
    logits = [(F.col(c) + b) / model.temperature for c, b in zip(columns, model.bias)]
    top = F.greatest(*logits)
    total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
    family = F.lit(None).cast("string")
    for name, x in reversed(list(zip(model.classes, logits))):
        family = F.when(x == top, name).otherwise(family)
    named = sums.select(*paragraph, "text", family.alias("family"), F.round(1 / total, 4).alias("probability")).filter(F.col("family") != UNKNOWN)

    # Bounded: the templates.
    known = F.broadcast(spark.createDataFrame(_known(templates, marks), "family string, template array<string>, needed array<string>, versions array<string>"))
    listed = named.withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    compared = listed.withColumn("grams", _grams(F.col("w"))).join(known, "family")
    share = F.round(F.size(F.array_intersect("template", "grams")) / F.size("template"), 4)
    another = F.exists("grams", lambda g: g.rlike("^version [0-9]")) & ~F.arrays_overlap("versions", "grams")
    marked_so = (F.size(F.array_except("needed", "grams")) == 0) & ((F.size("versions") == 0) | ~another)
    best = compared.groupBy(*paragraph, "text", "family", "probability").agg(
        F.max(share).alias("containment"), F.max((share >= min_containment) & marked_so).alias("confirmed")
    )
    return best.select("doc_id", "paragraph", "text", "family", "probability", "containment", "confirmed").distinct()
