"""Licence scan by a trained paragraph classifier.

A multinomial logistic regression over hashed word n-grams (1 to 3) is trained on the driver from the notice templates
below, altered at random, and from paragraphs that are no notice: at most UNKNOWN_SAMPLE lines of about UNKNOWN_DOCS
documents (those whose ids have the smallest hash), among them lines that speak of licences without being near a
template, and pieces of templates that name no licence. Its weights are sparse: only n-grams of templates have any.
A temperature and an offset of the unknown class are then fitted on rows that training has not seen, notices and others,
so that a probability of p is right about p of the time.

A paragraph to judge is a stretch of words around n-grams of templates: windows as long as templates are, which run over
line ends but not over blank lines or texts. So a wrapped notice is one paragraph, and two notices on one line are two.
A window counts if a family has a probability of MIN_PROBABILITY and the window holds MIN_SIMILARITY of the n-grams of one
of its templates; of overlapping windows the most similar, then the most probable, then the shortest is kept.

Defined results: null and empty texts have no licence; repeated notices and rows count each; a text of any length is
read whole; an empty table gives no rows and trains without lines of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import bounded_batches
from loregraph.llm.words import ALNUM, U64, Segment, mix, odd_constants, segments

UNKNOWN_DOCS, UNKNOWN_SAMPLE = 200, 4000
MIN_PROBABILITY, MIN_SIMILARITY = 0.6, 0.6
GRAMS = 3
LINE = 2000
NOT_NEAR = 0.35
SLACK, GAP, CHUNK = 2, 8, 64

# Usual wordings of licence notices by SPDX family.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "distributed under the Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache Software License 2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    "LGPL": ("licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0"),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "ISC": ("Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("All rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"),
}
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def _grams(h: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each on; 0 where fewer are left."""
    out = np.full(len(h), n, U64)
    for j, c in enumerate(odd_constants(n, 200 + n)):
        if j < len(h):
            out[: len(h) - j] += h[j:] * c
    out = mix(out)
    out[left < n] = 0
    return out


def _paragraph_grams(s: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the n-gram hashes at each word, by n; the end of each word's paragraph; line ends before each word). n-grams stay in paragraphs."""
    lines = np.concatenate([[0], np.cumsum(s.data == 10)])
    before = lines[s.starts] if len(s.starts) else np.empty(0, int)
    new = np.zeros(len(before), bool)
    new[1:] = before[1:] - lines[s.ends[:-1]] >= 2
    new[s.bounds[:-1][s.bounds[:-1] < len(new)]] = True
    number = np.cumsum(new)
    last = np.searchsorted(number, number, side="right")
    h, left = s.hashes(lower=True), last - np.arange(len(number))
    return np.stack([_grams(h, left, n) for n in range(1, GRAMS + 1)]), last, before


def text_grams(texts: list[str]) -> list[np.ndarray]:
    """All n-gram hashes of each text, taken as one line."""
    out = []
    for s in segments(pa.array([t.replace("\n", " ") for t in texts], pa.string()), inside_word=ALNUM):
        g, _, _ = _paragraph_grams(s)
        for r in range(s.hi - s.lo):
            own = g[:, s.bounds[r] : s.bounds[r + 1]].ravel()
            out.append(own[own != 0])
    return out


@dataclass
class Classifier:
    """vocabulary: the n-grams of templates. members: which of them each template has; owners: its family; lengths: its words."""

    families: list[str]
    vocabulary: np.ndarray
    members: np.ndarray
    owners: np.ndarray
    lengths: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The numbers of n-grams in the vocabulary; -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == grams, at, -1)

    def features(self, grams: np.ndarray) -> np.ndarray:
        x = np.zeros(len(self.vocabulary))
        at = self.places(grams)
        x[at[at >= 0]] = 1
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.bias) / self.temperature

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def similarities(self, x: np.ndarray) -> np.ndarray:
        """The share of each template's n-grams that a row has."""
        return (x @ self.members.T) / self.members.sum(axis=1)

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family number, its probability, the largest share of a template of the family) of each row."""
        p, share = self.probabilities(x), self.similarities(x)
        best = p.argmax(axis=1)
        own = np.where(self.owners[None, :] == best[:, None], share, 0)
        return best, p[np.arange(len(p)), best], own.max(axis=1)

    def notices(self, grams: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, similarity) of the notices among windows from ``starts`` on, words of one stretch."""
        found = []
        reach = int(self.lengths.max()) + SLACK
        for lo in range(0, len(starts), CHUNK):
            own = starts[lo : lo + CHUNK]
            first, stop = int(own[0]), int(min(own[-1] + reach, ends[own[-1]]))
            n = stop - first
            counts = []
            for g in grams:
                at = self.places(g[first:stop])
                hot = np.zeros((n + 1, len(self.vocabulary)), np.int16)
                rows = np.flatnonzero(at >= 0)
                hot[rows + 1, at[rows]] = 1
                counts.append(np.cumsum(hot, axis=0, dtype=np.int16))
            a = np.repeat(own, len(self.lengths))
            b = np.minimum(np.tile(self.lengths + SLACK, len(own)) + a, np.minimum(ends[a], stop))
            a, b = np.unique(np.column_stack([a, b]), axis=0).T
            x = np.zeros((len(a), len(self.vocabulary)))
            for i, c in enumerate(counts):  # an n-gram is in the window if its last word is
                x += c[np.maximum(b - i, a) - first] - c[a - first]
            best, p, share = self.judge((x > 0).astype(float))
            for r in np.flatnonzero((best < len(self.families) - 1) & (p >= MIN_PROBABILITY) & (share >= MIN_SIMILARITY)):
                found.append((int(a[r]), int(b[r]), self.families[best[r]], float(p[r]), float(share[r])))
        found.sort(key=lambda f: (-round(f[4], 6), -round(f[3], 2), f[1] - f[0], f[0]))
        kept: list = []
        for f in found:
            if all(f[1] <= k[0] or k[1] <= f[0] for k in kept):
                kept.append(f)
        return sorted(kept)


def _altered(texts: tuple[str, ...], n: int, filler: list[str], rng: np.random.Generator) -> list[str]:
    """Templates with words around them, and now and then a word dropped or changed."""
    out = []
    for _ in range(n):
        words = texts[rng.integers(len(texts))].split()
        if len(words) > 6 and rng.random() < 0.3:
            words.pop(rng.integers(len(words)))
        if len(words) > 6 and rng.random() < 0.3:
            words[rng.integers(len(words))] = filler[rng.integers(len(filler))]
        pad = lambda: [filler[i] for i in rng.integers(len(filler), size=rng.integers(0, 8))]
        out.append(" ".join([*pad(), *words, *pad()] if rng.random() < 0.5 else words))
    return out


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    hot = np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) / len(x)
        w -= rate * (x.T @ g + decay * w)
        b -= rate * g.sum(axis=0)
    return w, b


def _pieces(n: int, filler: list[str], rng: np.random.Generator) -> list[str]:
    """Parts of templates of less than half their words, and words of notices in any order, among other words."""
    every = [t.split() for group in TEMPLATES.values() for t in group]
    loose = sorted({w for t in every for w in t})
    out = []
    for i in range(n):
        words = every[rng.integers(len(every))]
        if i % 2:
            size = int(rng.integers(1, max(2, (len(words) - 1) // 2 + 1)))
            at = int(rng.integers(len(words) - size + 1))
            part = words[at : at + size]
        else:
            part = [loose[j] for j in rng.integers(len(loose), size=rng.integers(2, 9))]
        pad = lambda: [filler[j] for j in rng.integers(len(filler), size=rng.integers(0, 6))]
        out.append(" ".join([*pad(), *part, *pad()]))
    return out


def labelled_texts(unknown: list[str], per_family: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Altered notices with their family's number, and texts that are none with the last number."""
    filler = sorted({w for t in unknown for w in tokens(t)})[:2000] or ["lorem", "ipsum"]
    texts, labels = [], []
    for k, family in enumerate(TEMPLATES):
        texts += _altered(TEMPLATES[family], per_family, filler, rng)
        labels += [k] * per_family
    others = [*_pieces(per_family * 8, filler, rng), *unknown]
    return texts + others, np.array(labels + [len(TEMPLATES)] * len(others))


def untrained() -> Classifier:
    groups = {f: text_grams(list(t)) for f, t in TEMPLATES.items()}
    vocabulary = np.unique(np.concatenate([g for group in groups.values() for g in group]))
    members = np.stack([np.isin(vocabulary, g) for group in groups.values() for g in group]).astype(float)
    owners = np.repeat(np.arange(len(groups)), [len(g) for g in groups.values()])
    lengths = np.unique([len(tokens(t)) for group in TEMPLATES.values() for t in group])
    return Classifier([*TEMPLATES, UNKNOWN], vocabulary, members, owners, lengths, np.empty(0), np.empty(0))


def train(unknown: list[str], seed: int = 7, per_family: int = 60) -> Classifier:
    """unknown: lines of documents; those that are near a template are left out, as they may be notices."""
    rng = np.random.default_rng(seed)
    model = untrained()
    features = lambda texts: np.stack([model.features(g) for g in text_grams(texts)])
    if unknown:
        near = model.similarities(features(unknown)).max(axis=1)
        unknown = [t for t, s in zip(unknown, near, strict=True) if s < NOT_NEAR]
    texts, labels = labelled_texts(unknown[::2], per_family, rng)
    texts += [t for group in TEMPLATES.values() for t in group]
    labels = np.concatenate([labels, model.owners])
    rows = features(texts)
    # A piece that holds most of a template is no example of the unknown class. Equal rows weigh alike however often the
    # corpus has them: most of its lines have no n-gram of a template.
    clear = (labels < len(TEMPLATES)) | (model.similarities(rows).max(axis=1) < MIN_SIMILARITY)
    _, kept = np.unique(np.column_stack([rows, labels])[clear], axis=0, return_index=True)
    model.weights, model.bias = _softmax_fit(rows[clear][kept], labels[clear][kept], len(model.families))
    return _calibrated(model, *_held(model, unknown[1::2], per_family // 2, rng))


def _held(model: Classifier, unknown: list[str], per_family: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    texts, labels = labelled_texts(unknown, per_family, rng)
    x = np.stack([model.features(g) for g in text_grams(texts)])
    clear = (labels < len(TEMPLATES)) | (model.similarities(x).max(axis=1) < MIN_SIMILARITY)
    some = x.any(axis=1)  # the scan judges no other
    return x[clear & some], labels[clear & some]


def _calibrated(model: Classifier, x: np.ndarray, labels: np.ndarray) -> Classifier:
    """The temperature and the offset of the unknown class with the least log loss on held-out rows, both kinds weighing alike."""
    z, last = x @ model.weights + model.bias, len(model.families) - 1
    weight = np.where(labels == last, 0.5 / max((labels == last).sum(), 1), 0.5 / max((labels < last).sum(), 1))

    def loss(t: float, offset: float) -> float:
        y = z / t
        y[:, last] += offset / t
        y = y - y.max(axis=1, keepdims=True)
        return float(-(weight * (y[np.arange(len(y)), labels] - np.log(np.exp(y).sum(axis=1)))).sum())

    grid = [(t, o) for t in np.geomspace(0.1, 5, 40) for o in np.linspace(-3, 3, 31)]
    t, offset = min(grid, key=lambda g: loss(*g))
    model.temperature = float(t)
    model.bias = model.bias + offset * (np.arange(last + 1) == last)
    return model


def reliability(model: Classifier, x: np.ndarray, labels: np.ndarray, bins: int = 10) -> tuple[float, float]:
    """(accuracy, mean gap between probability and accuracy over bins of probability, weighted by rows)."""
    p = model.probabilities(x)
    top, right = p.max(axis=1), p.argmax(axis=1) == labels
    at = np.minimum((top * bins).astype(int), bins - 1)
    gap = sum(abs(top[at == b].mean() - right[at == b].mean()) * (at == b).mean() for b in np.unique(at))
    return float(right.mean()), float(gap)


def _scan(shared):
    names = ["doc_id", "paragraph", "start", "words", "family", "probability", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        bits = np.zeros(1 << 20, bool)
        bits[model.vocabulary >> U64(44)] = True
        for batch in batches:
            for s in segments(batch["text"], inside_word=ALNUM):
                grams, ends, lines = _paragraph_grams(s)
                # Single words of notices are frequent anywhere; a template has n-grams of more, so those tell where to look.
                hits = np.flatnonzero(bits[grams[1:] >> U64(44)].any(axis=0))
                hits = hits[(model.places(grams[1:, hits]) >= 0).any(axis=0)]
                if not len(hits):
                    continue
                out = []
                apart = np.flatnonzero((np.diff(hits) > GAP) | (ends[hits[1:]] != ends[hits[:-1]])) + 1
                first_line = np.concatenate([[0], np.cumsum(s.data == 10)])[s.offsets[:-1]]
                for stretch in np.split(hits, apart):
                    row = int(np.searchsorted(s.bounds, stretch[0], side="right")) - 1
                    for a, b, family, p, share in model.notices(grams, ends, stretch):
                        out.append((row, int(lines[a] - first_line[row]), int(a - s.bounds[row]), b - a, family, p, share))
                if out:
                    row, *cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.array(row) + s.lo)), *map(pa.array, cols)], names)

    return run


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph (line number from 0), start and words (in tokens), family, probability and similarity of each notice."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(unknown_lines(d)))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scan(shared), f"doc_id {kind}, paragraph long, start long, words long, family string, probability double, similarity double")


def unknown_lines(docs: DataFrame) -> list[str]:
    """Lines of a bounded number of documents (doc_id, text): about UNKNOWN_DOCS, at most UNKNOWN_SAMPLE lines of at most LINE characters."""
    n = max(1, docs.count())
    some = docs if n <= UNKNOWN_DOCS else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < (UNKNOWN_DOCS << 30) // n)
    lines = some.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).where(f"trim(line) <> '' and length(line) <= {LINE}")
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(UNKNOWN_SAMPLE).collect()]


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
