"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Every paragraph (line) of a text is classified by a sparse logistic regression
over word 1- and 2-grams into licence families or 'unknown'.  It is trained here
on the templates below, seeded variants of them, and ordinary paragraphs of the
corpus (a bounded sample) as the unknown class.  A family is only reported if
the probability of not being unknown is one that hardly any ordinary paragraph
reaches (calibrated on held-out ones).  A prediction is confirmed if the paragraph holds a template of
its family, or the template holds the paragraph, by at least ``CONFIRM`` of the
five-word shingles, and if the words that tell licences apart (names and version numbers) agree: those of
the template occur in the paragraph, and where it matches there are no others.

In a long paragraph the words of a notice fade among the others.  So the model
also judges windows: stretches where word pairs of the vocabulary follow each
other, alone and joined over short gaps, cut in overlapping parts where they are
longer than a notice.  What it finds in a window counts only if the window holds
enough of a template, so windows add no unconfirmed findings.

Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import hash_sample, plain_text

UNKNOWN = "unknown"
SHINGLE = 5
CONFIRM = 0.8
SAMPLE = 4000
#: Share of held-out ordinary paragraphs that may exceed the accepted probability.
FALSE_ALARMS = 0.0005
NEAR_MISSES = 3000
#: A window is made of stretches of so many words or more, at most so many words apart.
STRETCH, GAP = 3, 4
SEED = 11
#: Short notices as their licences ask for them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is licensed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "All rights reserved. Redistribution is prohibited without written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Words of licence names that tell one from another; version numbers do so too.
NAMES = frozenset(
    "apache mit gnu gpl lgpl agpl lesser library affero bsd mozilla mpl eclipse epl isc zlib boost cc cc0 creative commons by nc sa nd "
    "attribution noncommercial sharealike noderivatives noderivs".split()
)
_WORD = re.compile(r"[a-z0-9]+")


def paragraph_words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def telling(words: list[str]) -> set[str]:
    """Names of licences and numbers among the words."""
    return {w for w in words if w in NAMES or w.isdigit()}


def _variants(words: list[str], rng: np.random.Generator, count: int) -> Iterator[list[str]]:
    """The words with some left out, cut off at the ends, or among others."""
    yield words
    for _ in range(count):
        kept = [w for w in words if rng.random() > 0.1]
        cut = max(3, int(len(kept) * rng.uniform(0.6, 1.0)))
        start = int(rng.integers(0, max(1, len(kept) - cut + 1)))
        yield kept[start : start + cut]


def _near_misses(rng: np.random.Generator, count: int) -> Iterator[list[str]]:
    """Ordinary text in words of the templates, so that a few common words don't decide: any of them, or a short piece among others."""
    texts = [paragraph_words(t) for ts in TEMPLATES.values() for t in ts]
    pool = [w for words in texts for w in words]
    for i in range(count):
        if i % 3 == 0:
            yield list(rng.choice(pool, int(rng.integers(1, 6))))
            continue
        words = texts[int(rng.integers(len(texts)))]
        size = int(rng.integers(1, 4 if len(words) >= 10 else 3))
        start = int(rng.integers(0, len(words) - size + 1))
        others = [f"other{k}" for k in range(int(rng.integers(0, 9)))]
        at = int(rng.integers(0, len(others) + 1))
        yield others[:at] + words[start : start + size] + others[at:]


class LicenceModel:
    """Vocabulary, weights and accepted probability; scores paragraphs."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, families: list[str], accept: float):
        self.vocabulary, self.weights, self.bias, self.families, self.accept = vocabulary, weights, bias, families, accept
        self.templates = {f: [shingles(paragraph_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
        self.telling = {f: [telling(paragraph_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
        #: Twice the words of the longest template, so that two overlapping windows share room for one.
        self.longest = 2 * max(len(paragraph_words(t)) for ts in TEMPLATES.values() for t in ts)

    def _pairs(self, words: list[str], known: list[int | None]) -> list[tuple[int, int]]:
        """(place, vocabulary number) of the word pairs that are in the vocabulary."""
        get = self.vocabulary.get
        return [
            (i, j) for i, (x, y) in enumerate(zip(known, known[1:]))
            if x is not None and y is not None and (j := get(f"{words[i]} {words[i + 1]}")) is not None
        ]

    def windows(self, words: list[str]) -> list[list[str]]:
        """Parts of a paragraph that may be a notice; see the module's text."""
        places = [i for i, _ in self._pairs(words, [self.vocabulary.get(w) for w in words])]
        runs: list[list[int]] = []
        for i in places:
            if runs and i == runs[-1][1] - 1:
                runs[-1][1] = i + 2
            else:
                runs.append([i, i + 2])
        alone = [(a, b) for a, b in runs if b - a >= STRETCH]
        joined: list[tuple[int, int]] = []
        for a, b in alone:
            if joined and a - joined[-1][1] <= GAP:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        spans = set(alone) | set(joined)
        step = max(1, self.longest // 2)
        cut = {(c, min(c + 2 * step, b)) for a, b in spans for c in (range(a, max(a + 1, b - step), step) if b - a > 2 * step else (a,))}
        return [words[a:b] for a, b in sorted(cut)]

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Unknown first, then the families."""
        known = [self.vocabulary.get(w) for w in words]
        found = {i for i in known if i is not None}
        found |= {j for _, j in self._pairs(words, known)}
        z = self.bias.copy()
        if found:
            z += self.weights[sorted(found)].sum(axis=0) / np.sqrt(max(len(set(words)), 1))
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, words: list[str], family: str) -> float:
        """Largest share of shingles that paragraph and template have in common, of the smaller set of the two."""
        own, best = shingles(words), 0.0
        for template in self.templates[family]:
            width = len(next(iter(template)))
            mine = own if own and len(next(iter(own))) == width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            if mine:
                best = max(best, len(mine & template) / min(len(mine), len(template)))
        return best

    def confirmation(self, words: list[str], family: str, whole: bool = False) -> float:
        """The similarity, counting only templates whose names and numbers agree with the paragraph's; with ``whole`` the template's share."""
        best, own = 0.0, telling(words)
        for template, needed in zip(self.templates[family], self.telling[family]):
            if not needed <= own:
                continue
            width = len(next(iter(template)))
            starts = [i for i in range(len(words) - width + 1) if tuple(words[i : i + width]) in template]
            if not starts:
                continue
            matched = words[starts[0] : starts[-1] + width]
            if telling(matched) <= needed:
                own_count = len(shingles(words)) if width == SHINGLE else len(words) - width + 1
                best = max(best, len({tuple(words[i : i + width]) for i in starts}) / (len(template) if whole else min(own_count, len(template))))
        return min(best, 1.0)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Family or 'unknown', its probability, and the similarity with the family's best template that may confirm it."""
        words = paragraph_words(paragraph)
        if not any(w in self.vocabulary for w in words):
            return UNKNOWN, 1.0, 0.0
        p = self.probabilities(words)
        best = int(p[1:].argmax())
        if 1 - p[0] < self.accept:
            return UNKNOWN, float(p[0]), 0.0
        return self.families[best], float(p[best + 1]), self.confirmation(words, self.families[best])

    def findings(self, paragraph: str) -> list[tuple[str, float, float]]:
        """(family, probability, similarity) of the paragraph as a whole, if any, and of further families confirmed in windows of it."""
        family, probability, similarity = self.classify(paragraph)
        best = {} if family == UNKNOWN else {family: (similarity, probability)}
        words = paragraph_words(paragraph)
        for window in self.windows(words):
            if len(window) == len(words):
                continue
            p = self.probabilities(window)
            at = int(p[1:].argmax())
            name = self.families[at]
            held = self.confirmation(window, name, whole=True) if 1 - p[0] >= self.accept else 0.0
            if held >= CONFIRM and (name not in best or best[name][0] < held):
                best[name] = (held, float(p[at + 1]))
        return [(f, p, s) for f, (s, p) in sorted(best.items())]


def _softmax_regression(rows: list[list[int]], norms: np.ndarray, target: np.ndarray, size: int, classes: int, rounds: int = 300):
    """Full-batch gradient descent with momentum on sparse rows; classes weigh the same in sum."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    features = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
    value = 1 / norms[at]
    share = 1 / (np.bincount(target, minlength=classes)[target] * classes)
    w, b = np.zeros((size, classes)), np.zeros(classes)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    goal = np.eye(classes)[target]
    for _ in range(rounds):
        z = np.zeros((len(rows), classes)) + b
        np.add.at(z, at, w[features] * value[:, None])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        error = (e / e.sum(axis=1, keepdims=True) - goal) * share[:, None]
        gradient = np.zeros_like(w)
        np.add.at(gradient, features, error[at] * value[:, None])
        speed_w = 0.9 * speed_w - 8.0 * (gradient + 1e-5 * w)
        speed_b = 0.9 * speed_b - 8.0 * error.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return w, b


def train(ordinary: list[str], seed: int = SEED) -> LicenceModel:
    """From the templates and ordinary paragraphs; those that hold a template's words are left out.

    A fifth of the ordinary paragraphs is held out to calibrate the accepted
    probability.  Without any, it is 0.5.
    """
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    positive = [(k + 1, v) for k, f in enumerate(families) for t in TEMPLATES[f] for v in _variants(paragraph_words(t), rng, 25)]
    vocabulary = {g: i for i, g in enumerate(sorted({g for f in TEMPLATES.values() for t in f for g in ngrams(paragraph_words(t))}))}
    unlike = LicenceModel(vocabulary, np.zeros((len(vocabulary), 1)), np.zeros(1), families, 0.5)
    negative = [w for w in map(paragraph_words, ordinary) if w and max(unlike.similarity(w, f) for f in families) < 0.5]
    negative += list(_near_misses(rng, NEAR_MISSES))
    order = rng.permutation(len(negative))
    held, used = [negative[i] for i in order[::5]], [negative[i] for k, i in enumerate(order) if k % 5]
    texts = positive + [(0, w) for w in used]
    rows = [sorted({vocabulary[g] for g in ngrams(w) if g in vocabulary}) for _, w in texts]
    norms = np.sqrt(np.array([max(len(set(w)), 1) for _, w in texts], dtype=np.float64))
    weights, bias = _softmax_regression(rows, norms, np.array([k for k, _ in texts]), len(vocabulary), len(families) + 1)
    model = LicenceModel(vocabulary, weights, bias, families, 0.5)
    if held:
        reached = np.array([1 - model.probabilities(w)[0] for w in held])
        model.accept = float(min(0.99, max(0.5, np.quantile(reached, 1 - FALSE_ALARMS))))
    return model


def sample_paragraphs(docs: DataFrame, count: int = SAMPLE) -> list[str]:
    """The first long line, cut to 2000 characters, of at most ``count`` documents; the bounded training sample.

    Lines are cut before they are chosen, by a hash of the line and the id, so rows without id are as likely as others
    and no whole text leaves its task.
    """
    longer = F.filter(F.split(plain_text(), "\n"), lambda x: F.length(x) > 20)
    line = F.substring(F.try_element_at(longer, F.lit(1)), 1, 2000)
    keyed = docs.select(F.struct(line.alias("line"), F.col("doc_id").cast("string").alias("of")).alias("key")).filter("key.line IS NOT NULL")
    return sorted(r.line for r in hash_sample(keyed, "key", count).select("key.line").collect())


def licence_scan(docs: DataFrame, model: LicenceModel | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_predicted, n_confirmed, families, findings.

    Needs ``doc_id`` and ``text``.  Paragraphs are the non-blank lines, numbered
    from 0 with blank ones counted.  ``families`` are the confirmed families,
    sorted, comma-joined; ``findings`` lists every predicted paragraph as
    number:family:probability:similarity (two decimals), one for each family of a
    paragraph.  A null text has no paragraphs.  Rows that repeat a document are
    scanned each.  Paragraphs of any length are scanned whole, and in windows.
    Other columns are not looked at.  No row in, no row out.
    """
    if model is None:
        model = train(sample_paragraphs(docs, sample))

    @F.pandas_udf("n_paragraphs long, n_predicted long, n_confirmed long, families string, findings string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [scan_text(t, model) for t in texts],
                columns=["n_paragraphs", "n_predicted", "n_confirmed", "families", "findings"],
            )

    return docs.select("doc_id", scan(plain_text()).alias("r")).select("doc_id", "r.*")


def scan_text(text: str, model: LicenceModel) -> tuple[int, int, int, str, str]:
    found, predicted, count = [], 0, 0
    for number, paragraph in enumerate(text.split("\n")):
        if not paragraph.strip():
            continue
        count += 1
        own = model.findings(paragraph)
        predicted += bool(own)
        found += [(number, *finding) for finding in own]
    confirmed = [(n, f) for n, f, _, s in found if s >= CONFIRM]
    return (
        count, predicted, len({n for n, _ in confirmed}), ",".join(sorted({f for _, f in confirmed})),
        ",".join(f"{n}:{f}:{p:.2f}:{s:.2f}" for n, f, p, s in found),
    )
