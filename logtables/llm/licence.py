"""Licence scans: which paragraphs of a text are licence notices, and of which family.

A paragraph (a line) is a sparse vector of the word 2- and 3-grams that occur in known
notices. Multinomial logistic regression tells the families and an unknown class apart; it is
trained on the notices, whole, shortened and set among other words, and on paragraphs of the
corpus as the unknown class. A temperature fitted on left-out examples calibrates it. A
family other than unknown counts only if a template of it confirms it: enough of the
template's 2-grams stand in the paragraph.

Bounds: at most about ``UNKNOWN_TEXTS`` texts, chosen by hash of their id, give paragraphs of
the unknown class, at most ``UNKNOWN_EACH`` each. Every paragraph of every text is scanned.

Defined results: a null or empty text, or one without a confirmed notice, has family
``unknown``, score 0 and empty lists; without any text the model still knows the notices;
repeated rows are scanned alike; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, hash_key, unit

#: Usual short notices of licence families.
NOTICES = {
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without permission.", "Proprietary and confidential. All rights reserved."],
}
UNKNOWN = "unknown"
UNKNOWN_TEXTS, UNKNOWN_EACH = 1024, 4
#: Least probability of a family, and least part of a template that must stand in a paragraph.
LEAST_SCORE, LEAST_TEMPLATE = 0.5, 0.7
VARIANTS, STEPS, RIDGE = 24, 300, 1e-3
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str]) -> list[tuple[str, ...]]:
    return [*zip(words, words[1:]), *zip(words, words[1:], words[2:])]


class Model:
    def __init__(self, unknown: list[str]):
        self.families = [*sorted(NOTICES), UNKNOWN]
        self.templates = [(f, frozenset(zip(w, w[1:]))) for f in self.families[:-1] for w in map(words_of, NOTICES[f])]
        vocabulary = sorted({g for f in self.families[:-1] for n in NOTICES[f] for g in grams(words_of(n))})
        self.numbers = {g: i for i, g in enumerate(vocabulary)}
        self.pairs = frozenset(g for g in vocabulary if len(g) == 2)
        rng = np.random.default_rng(11)
        other = [w for p in unknown for w in words_of(p)] or ["lorem", "ipsum", "dolor"]
        texts, labels = [], []
        for number, family in enumerate(self.families[:-1]):
            for notice in map(words_of, NOTICES[family]):
                for variant in range(VARIANTS):
                    kept = [w for w in notice if variant == 0 or rng.random() > 0.04]
                    around = [other[i] for i in rng.integers(0, len(other), rng.integers(0, 12) if variant else 0)]
                    cut = rng.integers(0, len(around) + 1)
                    texts.append([*around[:cut], *kept, *around[cut:]])
                    labels.append(number)
        for paragraph in unknown:
            found = words_of(paragraph)
            if not any(self._covered(found) >= LEAST_TEMPLATE):
                texts.append(found)
                labels.append(len(self.families) - 1)
        # Halves and single words of notices mean nothing by themselves.
        for notice in (words_of(n) for f in self.families[:-1] for n in NOTICES[f]):
            for _ in range(VARIANTS // 2):
                at = rng.integers(0, len(notice))
                texts.append([*notice[at : at + 2], *[other[i] for i in rng.integers(0, len(other), 8)]])
                labels.append(len(self.families) - 1)
        x = np.stack([self._vector(t) for t in texts])
        y = np.eye(len(self.families))[labels]
        left_out = rng.random(len(x)) < 0.2
        self.weights = self._fit(x[~left_out], y[~left_out])
        self.temperature = self._calibrate(x[left_out], y[left_out])

    def _vector(self, words: list[str]) -> np.ndarray:
        x = np.zeros(len(self.numbers) + 1)
        for gram in grams(words):
            i = self.numbers.get(gram)
            if i is not None:
                x[i] = 1.0
        x[:-1] /= max(1.0, np.sqrt(x.sum()))
        x[-1] = 1.0
        return x

    def _fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # Families weigh alike; gradient steps with momentum.
        weigh = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)]
        weigh = weigh / weigh.sum()
        w, speed = np.zeros((x.shape[1], y.shape[1])), np.zeros((x.shape[1], y.shape[1]))
        for _ in range(STEPS):
            p = self._softmax(x @ w)
            speed = 0.9 * speed - 4.0 * (x.T @ ((p - y) * weigh[:, None]) + RIDGE * w / len(self.families))
            w += speed
        return w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> float:
        z = x @ self.weights
        loss = {t: -np.log(np.maximum((self._softmax(z * t) * y).sum(1), 1e-12)).mean() for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)}
        return min(loss, key=loss.get)

    def _covered(self, words: list[str]) -> np.ndarray:
        """Part of each template that stands in the words."""
        found = set(zip(words, words[1:]))
        return np.array([len(t & found) / len(t) if t else 0.0 for _, t in self.templates])

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """(paragraph, family, score) of the confirmed notices."""
        out = []
        if not text:
            return out
        for number, paragraph in enumerate(text.split("\n")):
            words = words_of(paragraph)
            # A paragraph without any 2-gram of a notice has no feature and no template.
            if self.pairs.isdisjoint(zip(words, words[1:])):
                continue
            covered = self._covered(words)
            if covered.max() < LEAST_TEMPLATE:
                continue
            chance = self._softmax((self._vector(words) @ self.weights)[None] * self.temperature)[0]
            best = int(chance.argmax())
            family = self.families[best]
            confirmed = max(c for c, (f, _) in zip(covered, self.templates) if f == family) if family != UNKNOWN else 0.0
            if confirmed >= LEAST_TEMPLATE and chance[best] >= LEAST_SCORE:
                out.append((number, family, float(chance[best])))
        return out


def train(docs: DataFrame, seed: str = "licence", texts: int = UNKNOWN_TEXTS) -> Model:
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    total = rows.count()
    share = 1.0 if total <= texts else texts / total
    lines = F.slice(F.shuffle(F.split("text", "\n"), 5), 1, UNKNOWN_EACH)
    chosen = rows.where(unit(hash_key(seed, F.col("doc_id"))) < share).select("doc_id", F.transform(lines, lambda x: F.substring(x, 1, 400)).alias("lines"))
    return Model([p for r in chosen.orderBy("doc_id").collect() for p in r["lines"] if p.strip()])


def scan(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds family and score of the likeliest notice, and all families and paragraphs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(part: pa.RecordBatch) -> list[pa.Array]:
            found = [shared.value.scan(t) for t in part.column("text").to_pylist()]
            best = [max(f, key=lambda n: (n[2], n[1], -n[0]), default=(0, UNKNOWN, 0.0)) for f in found]
            return [
                pa.array([b[1] for b in best], pa.string()),
                pa.array([b[2] for b in best], pa.float64()),
                pa.array([[n[1] for n in f] for f in found], pa.list_(pa.string())),
                pa.array([[n[0] for n in f] for f in found], pa.list_(pa.int32())),
            ]

        return step

    return arrow_pass(docs, "family string, score double, families array<string>, paragraphs array<int>", work, keep)
