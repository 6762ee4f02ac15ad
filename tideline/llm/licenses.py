"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line, or a run of lines between blank ones, so that a notice is found on
one line among others and wrapped over several.  Its features are word n-grams (one to
three words, case folded, by hash); a multinomial logistic regression tells licence
families from an unknown class.  It is trained here: on variants of the families'
templates (words dropped, ends cut), on their names and variants amid words of unknown
lines, so that wordings other than the templates' are told too, and on one line each of a bounded sample of the
corpus (``sample`` documents, ``line_chars`` characters a line) as unknown, those that
resemble a template left out.  Half of the training rows only calibrate: one temperature
scales the scores so that probabilities mean what they say, and a family counts only
above ``least``.  A prediction is confirmed if the paragraph's word pairs overlap a
template of the family enough (Dice coefficient over word pairs, or containment of the
whole template or of a name of the licence).

Only n-grams of templates have weights, so paragraphs with fewer than two words of any
template are unknown without being scored.  Texts of all documents are scanned whole.

Edge cases: null and empty texts have no paragraphs and no licence; blank lines have no
words; repeated lines count each; a run of lines adds nothing to a family that one of
them has shown; rows that repeat are scanned each; an empty table gives an empty result;
columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import hash_sample
from tideline.llm.textops import Block, blocks

#: size of the table that tells most other words at once
FILTER = 1 << 16

# Short public licence notices by family.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
# Names by which notices refer to a licence; each has two words or more.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "mit": ("MIT License", "MIT Licence"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3", "GNU GPL v3"),
    "bsd": ("BSD 3-Clause License", "3-Clause BSD License", "BSD License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "proprietary": ("All rights reserved",),
}
FAMILIES = (*TEMPLATES, "unknown")


def _lines_of(block: Block) -> tuple[Block, np.ndarray]:
    """The lines of a block as texts of their own, and each line's text."""
    ends = np.flatnonzero(block.data == 10) + 1
    offsets = np.unique(np.concatenate([block.offsets, ends]))
    if len(offsets) == 1:
        offsets = np.array([0, 0])
    lines = Block(block.data, offsets, 0)
    return lines, np.searchsorted(block.offsets, offsets[:-1], side="right") - 1


def _runs_of(lines: Block) -> tuple[Block, np.ndarray, np.ndarray]:
    """Runs of two or more lines that have words, as texts of their own; each run's first line, and its number of lines."""
    wordy = lines.n_words > 0
    # A run ends at a blank line and where another document begins: there the line before has no newline.
    ends = lines.offsets[1:]
    last = np.ones(lines.n, dtype=bool)
    last[lines.offsets[:-1] < ends] = lines.data[ends[lines.offsets[:-1] < ends] - 1] != 10
    begins = wordy.copy()
    begins[1:] &= ~wordy[:-1] | last[:-1]
    first = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    size = np.bincount(run[wordy], minlength=len(first))[: len(first)]
    first, size = first[size > 1], size[size > 1]
    pieces = [lines.data[lines.offsets[i] : lines.offsets[i + n]] for i, n in zip(first, size)]
    joined = np.concatenate([np.zeros(0, dtype=np.uint8), *pieces])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
    return Block(np.where(joined == 10, 32, joined).astype(np.uint8), offsets, 0), first, size


def _grams(lines: Block) -> tuple[np.ndarray, np.ndarray]:
    """(line, 64-bit hash) of runs of one to three words."""
    words = lines.word_hashes(fold_case=True)
    rows, hashes = [], []
    for n in (1, 2, 3):
        h, at = lines.windows(words, n)
        rows.append(lines.doc_of_word[at])
        hashes.append(h + np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes)


def _pairs(line: str) -> set[tuple[str, str]]:
    words = [w.strip(".,;:()\"'") for w in line.lower().split()]
    return set(zip(words, words[1:])) or {(w, "") for w in words}


def similarity(line: str, family: str) -> float:
    """How well a line matches the family's best template: Dice over word pairs, or containment of the template or of a name."""
    own = _pairs(line)
    best = 0.999 * any(_pairs(name) <= own for name in NAMES.get(family, ()))
    for template in TEMPLATES.get(family, ()):
        theirs = _pairs(template)
        common = len(own & theirs)
        best = max(best, 2 * common / max(1, len(own) + len(theirs)), 0.999 * (common == len(theirs)))
    return best


def _variants(rng: np.random.Generator, per_template: int) -> tuple[list[str], list[int]]:
    texts, y = [], []
    for i, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = template.split()
            for k in range(per_template):
                kept = [w for w in words if rng.random() > 0.1 * (k > 0)]
                cut = int(rng.integers(0, max(1, len(kept) // 4) + 1)) if k % 3 == 2 else 0
                texts.append(" ".join(kept[: len(kept) - cut] or words))
                y.append(i)
        for name in NAMES[family]:
            texts += [name] * per_template
            y += [i] * per_template
    return texts, y


def _amid(rng: np.random.Generator, texts: list[str], others: list[str]) -> list[str]:
    """Each text amid up to eight words before and behind it, of lines drawn from ``others``."""
    words = [t.split() for t in others] or [[]]
    some = lambda: " ".join(words[rng.integers(len(words))][: rng.integers(9)])
    return [f"{some()} {t} {some()}".strip() for t in texts]


class Classifier:
    """Weights over n-gram buckets, calibrated."""

    def __init__(self, unknown: list[str], seed: int = 3, per_template: int = 24) -> None:
        rng = np.random.default_rng(seed)
        texts, y = _variants(rng, per_template)
        resembles = lambda t: max(similarity(t, f) for f in TEMPLATES) >= 0.3
        others = [t for t in unknown if t.strip() and not resembles(t)]
        own = next(blocks(pa.array(texts), most_bytes=1 << 40))
        self.seen = np.unique(_grams(own)[1])
        texts += _amid(rng, texts, others) + others
        y = np.array(y + y + [len(FAMILIES) - 1] * len(others))
        block = next(blocks(pa.array(texts), most_bytes=1 << 40))
        rows, hashes = _grams(block)
        self.filter = np.zeros(FILTER, dtype=bool)
        self.filter[self.seen % np.uint64(FILTER)] = True
        hit, at = self.look_up(hashes)
        rows = rows[hit]
        hold = rng.random(len(y)) < 0.5
        x_rows, x_cols = rows[~hold[rows]], at[~hold[rows]]
        index = np.cumsum(~hold) - 1
        w = self._fit(index[x_rows], x_cols, len(self.seen), y[~hold])
        self.weights, self.bias = w[:-1], w[-1]
        scores = self.scores(rows, at, len(y))[hold]
        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: self._loss(scores / t, y[hold]))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of n-grams of templates, their columns)."""
        hit = np.flatnonzero(self.filter[hashes % np.uint64(FILTER)])
        at = np.searchsorted(self.seen, hashes[hit])
        same = self.seen[np.minimum(at, len(self.seen) - 1)] == hashes[hit]
        return hit[same], at[same]

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _loss(self, s: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(self._softmax(s)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 0.0

    def _fit(self, rows, cols, n_cols: int, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> np.ndarray:
        w = np.zeros((n_cols + 1, len(FAMILIES)))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            s = np.zeros((len(y), len(FAMILIES)))
            np.add.at(s, rows, w[cols])
            error = self._softmax(s + w[-1])
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            grad = ridge * w
            np.add.at(grad, cols, error[rows])
            grad[-1] += error.sum(axis=0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return w

    def scores(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        s = np.zeros((n, len(FAMILIES)))
        np.add.at(s, rows, self.weights[cols])
        return s + self.bias

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(line, probabilities) of the lines that have at least two words of some template."""
        words = block.word_hashes(fold_case=True)
        h, _ = block.windows(words, 1)
        hit, _ = self.look_up(h + np.uint64(1))
        lines = np.flatnonzero(np.bincount(block.doc_of_word[hit], minlength=block.n) >= 2)
        if not len(lines):
            return lines, np.zeros((0, len(FAMILIES)))
        raw = b"\n".join(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().strip(b"\n") for i in lines).decode("utf-8", "replace")
        some = next(blocks(pa.array(raw.split("\n")), most_bytes=1 << 40))
        rows, hashes = _grams(some)
        hit, cols = self.look_up(hashes)
        return lines, self._softmax(self.scores(rows[hit], cols, some.n) / self.temperature)


def _scan(model: Classifier, least: float, confirm: float):
    def families(block: Block) -> Iterator[tuple[int, dict]]:
        for i, probability in zip(*model.predict(block)):
            best = int(probability.argmax())
            if FAMILIES[best] != "unknown" and probability[best] >= least:
                text = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode("utf-8", "replace").strip()
                alike = similarity(text, FAMILIES[best])
                yield int(i), {"family": FAMILIES[best], "probability": round(float(probability[best]), 6), "similarity": round(alike, 6), "confirmed": alike >= confirm}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                lines, text_of = _lines_of(block)
                first = np.searchsorted(text_of, np.arange(block.n))
                found: list[list] = [[] for _ in range(block.n)]
                shown = set()  # (line, family) that a line alone confirms
                for i, what in families(lines):
                    found[text_of[i]].append({"paragraph": int(i - first[text_of[i]]), "lines": 1, **what})
                    if what["confirmed"]:
                        shown.add((i, what["family"]))
                runs, at, size = _runs_of(lines)
                for i, what in families(runs):
                    if what["confirmed"] and not any((line, what["family"]) in shown for line in range(at[i], at[i] + size[i])):
                        found[text_of[at[i]]].append({"paragraph": int(at[i] - first[text_of[at[i]]]), "lines": int(size[i]), **what})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(found, type=FOUND)], ["doc_id", "found"])

    return run


FOUND = pa.list_(
    pa.struct([("paragraph", pa.int32()), ("lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
)


def train(docs: DataFrame, sample: int = 2_000, seed: int = 3, line_chars: int = 2_000) -> Classifier:
    """A classifier whose unknown class comes from one line each (up to ``line_chars`` characters) of at most ``sample`` documents."""
    ids = hash_sample(docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id"), "doc_id", sample, seed)
    lines = F.split("text", "\n")
    one = F.substring(F.get(lines, F.pmod("o", F.size(lines)).cast("int")), 1, line_chars)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "o").agg(F.min(one).alias("line"))  # at most ``sample`` rows
    return Classifier([r["line"] or "" for r in rows.orderBy("o").collect()], seed)


def scan(docs: DataFrame, least: float = 0.6, confirm: float = 0.6, model: Classifier | None = None) -> DataFrame:
    """doc_id, found (array of paragraph: its first line, lines: how many, family, probability, similarity, confirmed) and licences (confirmed families) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    item = "struct<paragraph:int,lines:int,family:string,probability:double,similarity:double,confirmed:boolean>"
    found = docs.select("doc_id", "text").mapInArrow(_scan(model or train(docs), least, confirm), f"doc_id {kind}, found array<{item}>")
    confirmed = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"])))
    return found.select("doc_id", "found", confirmed.alias("licences"))
