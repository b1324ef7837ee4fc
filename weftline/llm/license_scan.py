"""Licence families of paragraphs: logistic regression on word n-grams, then template comparison.

The model is fitted on the driver, on the templates below with seeded variations and
on a bounded sample of documents.  Scoring is DataFrame operations only, within each
row: a paragraph is a stretch of lines that hold the model's trigger words (without
any of them no family can reach the calibrated probability, which fitting makes sure
of); its n-grams that have weights are looked up and summed, the best family is set
against the calibrated threshold for ``unknown``, and a prediction holds if the
paragraph also shares enough n-grams with a template of the family.  Nothing is
shuffled.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import picked

#: Notices by licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    ),
}
UNKNOWN = "unknown"
#: Documents that teach what isn't a licence: the first by hash of their id.
SAMPLE_DOCS = 512
#: Variations of each template in the training set, and in the set that calibrates.
VARIATIONS, HELD_VARIATIONS = 24, 8
#: Share of the n-grams of a template or of the paragraph, whichever are fewer (LEAST_GRAMS at least), that confirms a prediction.
CONFIRM, LEAST_GRAMS = 0.6, 4
#: Share of held-out paragraphs without a licence that may pass for one.
FALSE_SHARE = 1e-3
#: N-grams in a larger share of the paragraphs without a licence aren't features: they tell nothing, and would make triggers of everyday words.
COMMON = 0.002

#: A word; the same pattern serves Java and Python.
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def ngrams(text: str) -> set[str]:
    words = re.findall(WORD, _ascii_lower(text))
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def template_share(grams: set[str], template: set[str]) -> float:
    """Common n-grams over those of the smaller set."""
    return len(grams & template) / max(LEAST_GRAMS, min(len(grams), len(template)))


@dataclass(frozen=True)
class Model:
    """Of each n-gram its weights by family against ``unknown``, the families' biases, trigger words, and the probability that calibration asks for."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    triggers: list[str]
    least: float


def _variations(others: list[str], seed: int, count: int) -> tuple[list[set[str]], list[int]]:
    """N-gram sets and classes of each template's variations (words left out, foreign ones added), and of notices' words out of order, which are no licence."""
    rng = random.Random(seed)
    sets, classes = [], []
    for c, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = template.split()
            for v in range(count):
                some = [w for w in words if not v or len(words) < 4 or rng.random() > 0.1]
                if v % 3 == 1 and others:
                    some = some + rng.choice(others).split()[: rng.randint(1, 12)]
                sets.append(ngrams(" ".join(some)))
                classes.append(c)
    vocabulary = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    for _ in range(8 * count):
        sets.append(ngrams(" ".join(rng.choices(vocabulary, k=rng.randint(1, 3)) + (rng.choice(others).split()[:20] if others else []))))
        classes.append(len(TEMPLATES))
    return sets, classes


def _regression(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of multinomial logistic regression, by Adam."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, rounds + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - y) * weigh[:, None]
        gw, gb = x.T @ d + penalty * w, d.sum(axis=0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        scale = 0.1 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w, b = w - scale * mw / (np.sqrt(vw) + 1e-9), b - scale * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def fit(others: list[str], seed: int = 8, rounds: int = 300, penalty: float = 1e-4) -> Model:
    """The model from the templates and paragraphs ``others`` that hold no licence (ones that nearly are a template, or a part of one, are left out)."""
    families = [*TEMPLATES]
    known = [ngrams(t) for ts in TEMPLATES.values() for t in ts]
    others = [t for t in others if t.strip() and not any(template_share(ngrams(t), k) >= CONFIRM for k in known)]
    random.Random(seed).shuffle(others)
    held, taught = others[: len(others) // 4], others[len(others) // 4 :]
    spread = Counter(g for t in taught for g in ngrams(t))
    vocabulary = sorted(g for g in set().union(*known) if spread[g] <= max(2, COMMON * len(taught)))
    index = {w: i for i, w in enumerate(vocabulary)}
    sets, classes = _variations(taught, seed, VARIATIONS)
    # paragraphs that hold the same features are one row with a weight
    rows = Counter((frozenset(index[g] for g in s if g in index), c) for s, c in zip([*sets, *map(ngrams, taught)], [*classes, *[len(families)] * len(taught)], strict=True))
    order = sorted(rows, key=lambda r: (r[1], sorted(r[0])))
    x, y = np.zeros((len(order), len(vocabulary))), np.zeros((len(order), len(families) + 1))
    for i, (features, c) in enumerate(order):
        x[i, list(features)] = 1.0
        y[i, c] = 1.0
    count = np.array([rows[r] for r in order], dtype=float)
    weigh = count / (y.T @ count)[[c for _, c in order]]  # classes count alike
    w, b = _regression(x, y, weigh / weigh.sum(), rounds, penalty)
    w, b = w[:, :-1] - w[:, -1:], b[:-1] - b[-1]

    # calibration: slope and offset of the best family's log-odds, on paragraphs and variations that taught nothing
    def top(grams: set[str]) -> float:
        return float((b + sum((w[index[g]] for g in grams if g in index), np.zeros(len(families)))).max())

    sets, classes = _variations(held, seed + 1, HELD_VARIATIONS)
    odds = np.array([top(s) for s in sets] + [top(ngrams(t)) for t in held])
    real = np.array([c < len(families) for c in classes] + [False] * len(held))
    share = np.where(real, 0.5 / max(1, real.sum()), 0.5 / max(1, (~real).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -500, 500)))
        g, h = (p - real) * share, np.maximum(p * (1 - p), 1e-6) * share
        a = np.array([[np.sum(h * odds * odds) + 1e-3, np.sum(h * odds)], [np.sum(h * odds), np.sum(h) + 1e-3]])
        step = np.linalg.solve(a, [np.sum(g * odds) + 1e-3 * (slope - 1), np.sum(g) + 1e-3 * offset])
        slope, offset = max(0.05, slope - np.clip(step[0], -0.5, 0.5)), offset - np.clip(step[1], -0.5, 0.5)
    # offset and slope enter the model itself, so that its probabilities are calibrated
    w, b = np.round(w * slope, 6), np.round(b * slope + offset, 6)
    w[np.abs(w) < 1e-3] = 0.0
    wrong = sorted((1 / (1 + np.exp(-np.clip(slope * odds[len(sets) :] + offset, -500, 500)))).tolist(), reverse=True)
    # without any n-gram of a template a paragraph is unknown in any case
    least = max(0.5, wrong[int(len(wrong) * FALSE_SHARE)] if wrong else 0.5, float(1 / (1 + np.exp(-np.clip(b.max() + 1e-3, -500, 500)))))
    asked = float(np.log(least / (1 - least))) if least < 1 else np.inf

    # trigger words, an n-gram's rarest, until without them no family reaches what calibration asks for
    triggers: list[str] = []
    gain, open_ = np.maximum(w, 0), np.ones(len(vocabulary), dtype=bool)
    while (b + gain[open_].sum(axis=0)).max() >= asked:
        worst = int(np.argmax(b + gain[open_].sum(axis=0)))
        weight: dict[str, float] = {}
        for i in np.flatnonzero(open_ & (gain[:, worst] > 0)):
            word = min(vocabulary[i].split(), key=lambda v: (spread[v], v))
            weight[word] = weight.get(word, 0.0) + gain[i, worst]
        word = max(sorted(weight), key=weight.__getitem__)
        triggers.append(word)
        open_ &= np.array([word not in v.split() for v in vocabulary])
    return Model(families, {v: w[i].tolist() for i, v in enumerate(vocabulary) if w[i].any()}, b.tolist(), triggers, least)


def _low(column: Column | str) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model, with the lines of at most SAMPLE_DOCS documents as what isn't a licence."""
    texts = picked(docs, doc_id=id_column, text=text_column).where("doc_id is not null and text is not null").withColumn("digest", F.xxhash64("text"))
    # first the rows by their hashes, then their texts: tasks send the driver no other text
    chosen = texts.select("doc_id", "digest").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(SAMPLE_DOCS)
    some = texts.join(F.broadcast(chosen), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return fit(sorted(line for r in some.select("text").collect() for line in r["text"].split("\n")))


def _holds(model: Model) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(model.triggers, key=lambda t: (-len(t), t))) + ")(?![a-z0-9])"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """A row for each paragraph that is predicted to be a licence notice.

    A paragraph is a line that holds a trigger word, or a longest stretch of lines
    that each hold two different ones, as those of a wrapped notice do; one other
    line may stand between two of them if it isn't blank.  doc_id;
    paragraph (the number of its first line, from 0); n_lines; text; family, of
    equally likely ones the first by name; probability, the model's (calibrated,
    against ``unknown``); template_share, the share of n-grams in common with the
    family's nearest template; confirmed, whether that is at least CONFIRM.  A
    document may have several rows or none; null and empty texts have none.  Rows
    of one id are scanned one by one, and a null id stays null.  Other columns of
    ``docs`` are ignored.
    """
    model = model or train(docs, id_column, text_column)
    texts = picked(docs, doc_id=id_column, text=text_column)
    holds = _holds(model)
    # the text itself is looked at first: few hold a trigger in any case
    few = texts.where(F.col("text").rlike("(?i)" + holds)).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    few = few.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _low(F.get("lines", i)).rlike(holds)))
    few = few.withColumn("rich", F.transform("at", lambda i: F.size(F.array_distinct(F.regexp_extract_all(_low(F.get("lines", i)), F.lit(holds), F.lit(0)))) > 1))

    def joins(k: Column) -> Column:
        """Whether the k-th line with a trigger continues the stretch of the one before."""
        here, before = F.get("at", k), F.get("at", k - 1)
        return (k > 0) & F.get("rich", k) & F.get("rich", k - 1) & ((here - before == 1) | ((here - before == 2) & (F.trim(F.get("lines", here - 1)) != "")))

    positions = F.sequence(F.lit(0), F.size("at") - 1)
    few = few.where(F.size("at") > 0).select(
        "doc_id",
        "lines",
        F.transform(F.filter(positions, lambda k: ~joins(k)), lambda k: F.get("at", k)).alias("first"),
        F.transform(F.filter(positions, lambda k: (k == F.size("at") - 1) | ~joins(k + 1)), lambda k: F.get("at", k)).alias("last"),
    )
    pieces = F.zip_with("first", "last", lambda a, b: F.struct(a.alias("paragraph"), (b - a + 1).alias("n_lines"), F.array_join(F.slice("lines", a + 1, b - a + 1), "\n").alias("text")))
    found = few.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.paragraph", "p.n_lines", "p.text")
    found = found.withColumn("words", F.regexp_extract_all(_low("text"), F.lit(f"({WORD})"), F.lit(1)))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    found = found.withColumn("grams", F.array_distinct(F.concat("words", pairs))).drop("words")
    weights = F.create_map(*[x for gram, row in model.weights.items() for x in (F.lit(gram), F.array(*map(F.lit, row)))])
    known = F.array_intersect("grams", F.array(*map(F.lit, model.weights)))
    bias = F.array(*map(F.lit, model.bias))
    found = found.withColumn("score", F.aggregate(known, bias, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda a, b: a + b)))
    # families are in order of their names, and the first of the greatest scores counts
    names = F.array(*map(F.lit, model.families))
    found = found.withColumn("best", F.array_max("score")).withColumn("family", F.element_at(names, F.array_position("score", F.col("best")).cast("int")))
    found = found.withColumn("probability", 1 / (1 + F.exp(-F.col("best")))).where(F.col("probability") >= model.least)
    templates = [(f, sorted(ngrams(t))) for f, ts in TEMPLATES.items() for t in ts]
    every = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, grams)).alias("grams")) for f, grams in templates])

    def share(t: Column) -> Column:
        return F.size(F.array_intersect(F.col("grams"), t["grams"])) / F.greatest(F.lit(LEAST_GRAMS), F.least(F.size("grams"), F.size(t["grams"])))

    found = found.withColumn("template_share", F.array_max(F.transform(F.filter(every, lambda t: t["family"] == F.col("family")), share)))
    return found.select("doc_id", "paragraph", "n_lines", "text", "family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"), (F.col("template_share") >= CONFIRM).alias("confirmed"))


__all__ = ["CONFIRM", "TEMPLATES", "Model", "fit", "ngrams", "scan", "template_share", "train"]
