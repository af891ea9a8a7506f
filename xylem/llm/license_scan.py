"""License scans: a paragraph classifier over sparse word n-grams, applied in DataFrame functions alone.

Notices of each licence family, of other licences (the unknown class) and
paragraphs of the corpus without any licence word train a multinomial logistic
regression over the notices' words and word pairs, on the driver. A temperature
fitted by cross-validation calibrates its probabilities. Short statements, made
of each family's names in usual frames, train it too. Every paragraph is scored
by summing its n-grams' weights, but for those of words whose weights, all taken
together, cannot outweigh nothing; a family is given if its calibrated probability is high enough, else ``unknown``. A notice of the
family whose word pairs the paragraph contains confirms the prediction.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import let

#: Standard notices by family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE for details.",
        "This project is distributed under the terms of the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL, version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution-NonCommercial license",
    ],
    "CC0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 1.0 Universal Public Domain Dedication license",
        "This is free and unencumbered software released into the public domain without any license.",
    ],
    "unknown": [
        "Licensed under the terms of the vendor's end user license agreement",
        "Released under the Zlib License",
        "Licensed under the Eclipse Public License",
        "This work is proprietary; a commercial license is required",
        "Distributed under the Artistic License",
        "Released under a custom license",
        "Licensed under the terms stated in the accompanying file",
        "See the license for terms of use",
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "Confidential and proprietary; unauthorized copying is prohibited",
        "No license is granted; all rights are reserved by the owner",
    ],
}
#: Names of the families in short statements, and the frames of these. They train, but confirm nothing.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT/X11", "Expat"],
    "Apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache 2", "Apache", "ASL 2.0", "Apache License 2.0"],
    "GPL": ["GPL", "GNU GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0", "GPLv3+", "GNU General Public License"],
    "LGPL": ["LGPL", "GNU LGPL", "LGPLv2.1", "LGPLv3", "LGPL v3", "LGPL-2.1", "LGPL-3.0", "GNU Lesser General Public License"],
    "BSD": ["BSD", "BSD-3-Clause", "BSD-2-Clause", "3-Clause BSD", "2-Clause BSD", "BSD 2-Clause", "simplified BSD", "new BSD"],
    "MPL-2.0": ["MPL", "MPL 2.0", "MPL-2.0", "MPLv2", "Mozilla Public License"],
    "CC-BY": ["CC BY", "CC BY 4.0", "CC BY 3.0", "CC-BY", "CC-BY-4.0", "CC-BY 4.0", "Creative Commons Attribution"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "CC-BY-SA-4.0", "CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC", "CC-BY-NC-4.0", "CC-BY-NC 4.0", "Creative Commons Attribution-NonCommercial"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "public domain", "Unlicense"],
    "unknown": ["Zlib", "EPL", "EUPL", "AGPL", "AGPLv3", "Artistic", "proprietary", "vendor", "custom", "ISC", "WTFPL", "open source"],
}
FRAMES = ["Released under {}", "Released under the {}", "Distributed under {}", "Licensed under the {}", "Licensed under {}", "{} license", "{} licensed", "License: {}", "available under the {} license"]
#: Frames that only some families have.
MORE = {"CC0": ["dedicated to the public domain", "This work is in the public domain", "placed in the public domain", "released into the public domain"], **{x: ["{}"] for x in ("Apache-2.0", "GPL", "LGPL", "BSD", "MPL-2.0", "CC-BY", "CC-BY-SA", "CC-BY-NC")}}
#: Statements of nothing that hold some of the same words.
ORDINARY = [
    "Mit.", "mit und", "mit der", "his driving was permitted", "a driving license is needed", "the license plate of the car", "she was released in May", "The film was released under a new title",
    "papers were distributed under the door", "an open source of water", "The general public was free to enter", "a work of art", "See the next page for details", "terms and conditions of the house",
    "all guests have reserved a room", "the rights of all people", "a domain of the public", "the Apache people", "a commercial success", "Creative people have much in common", "under the", "of the", "in the", "is", "by",
]
NOTHING = "none"
#: Words that a licence statement may hold: documents with one do not serve as examples of nothing.
HINTS = r"(?i)licen[cs]|gpl|\bapache\b|\bMIT\b|\bbsd\b|\bmpl|\bcc[- ]?(?:by|0)|creative commons|copyright|©|rights? reserved|public domain|warrant|proprietary|free software|redistribut|permission is"
#: Documents without a licence word that give examples of nothing, at most, and paragraphs of them, at most.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 200, 300
#: Comment signs before and after a line's text; longest line that a hard wrap makes; shortest, and before a capital.
BEFORE, AFTER, WIDEST, SHORTEST, FILLED = r"^\s*(?:(?://+[!/]?|/?\*+(?!/)|#+|--+|;+|%+|>+|<!--|dnl\b|rem\b|\"{3}|'{3})\s*)*", r"\s*(?:\*+/|-->|\"{3}|'{3})?\s*$", 160, 20, 40
#: A line that ends a statement before a capital, and the beginnings of statements.
STOPS, OPENS = r"[.!?:|]$", r"^(?:Copyright|©|\([cC]\)|SPDX|Licen[cs]ed|Released|Distributed|Permission is|Redistribution|All rights|This (?:work|project|program|library|software|file))\b"
#: A family needs this calibrated probability, and confirmation this share of a notice's word pairs.
SURE, CONFIRMED = 0.5, 0.75
WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower().replace("licenc", "licens"))


def pairs(found: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(found, found[1:], strict=False)]


def statements() -> dict[str, list[str]]:
    """Short statements of each family."""
    return {c: [f.format(x) for x in names for f in FRAMES + [m for m in MORE.get(c, []) if "{}" in m]] + [m for m in MORE.get(c, []) if "{}" not in m] for c, names in NAMES.items()}


@dataclass
class Classifier:
    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # n-gram, class
    bias: np.ndarray
    temperature: float
    common: list[str]  # words of the vocabulary that texts of nothing hold, most common first

    @classmethod
    def fit(cls, nothing: list[str], folds: int = 3) -> Classifier:
        classes = [*NOTICES, NOTHING]
        short = statements()
        texts = [(x, i) for i, (name, group) in enumerate(NOTICES.items()) for x in [*group, *short[name]]]
        known = len(texts)
        texts += [(x, len(NOTICES)) for x in [*nothing, *ORDINARY, ""]]
        found = [set(w) | set(pairs(w)) for w in (words(x) for x, _ in texts)]
        vocabulary = sorted(set().union(*found[:known]))
        number = {g: i for i, g in enumerate(vocabulary)}
        x = np.zeros((len(texts), len(vocabulary)))
        for i, grams in enumerate(found):
            x[i, [number[g] for g in grams if g in number]] = 1
        y = np.array([c for _, c in texts])
        w, b = cls._train(x, y, len(classes))
        fold = np.arange(len(y)) % folds
        logits = np.zeros((len(y), len(classes)))
        for f in range(folds):
            part = cls._train(x[fold != f], y[fold != f], len(classes))
            logits[fold == f] = x[fold == f] @ part[0] + part[1]
        loss = [(-_log_softmax(logits / t)[np.arange(len(y)), y].mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0)]
        held = {g: sum(g in x for x in found[known:]) for g in vocabulary if " " not in g}
        common = sorted((g for g, n in held.items() if n), key=lambda g: (-held[g], g))
        return cls(classes, vocabulary, w, b, min(loss)[1], common)

    @staticmethod
    def _train(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 150, rate: float = 2.0, decay: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
        """Gradient descent with momentum; classes weigh the same however many examples they have."""
        w, b = np.zeros((x.shape[1], k)), np.zeros(k)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        each = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y] / k
        target = np.eye(k)[y]
        for _ in range(rounds):
            error = (np.exp(_log_softmax(x @ w + b)) - target) * each[:, None]
            vw = 0.9 * vw - rate * (x.T @ error + decay * w)
            vb = 0.9 * vb - rate * error.sum(0)
            w, b = w + vw, b + vb
        return w, b

    def weak(self) -> set[str]:
        """Common words of which no text can be made that is more likely a licence than nothing, from the weights: even all
        that speaks for a class among these words and their pairs, together, does not make up for its bias."""
        gain = self.weights[:, :-1] - self.weights[:, -1:]
        left = self.bias[-1] - self.bias[:-1] - 1e-3  # weights are rounded
        out: set[str] = set()
        for word in self.common:
            new = [i for i, g in enumerate(self.vocabulary) if word in (x := g.split(" ")) and out.issuperset(set(x) - {word})]
            after = left - np.maximum(gain[new], 0).sum(0)
            if (after > 0).all():
                out.add(word)
                left = after
        return out

    def telling(self) -> str:
        """A pattern that every text matches in which a licence can be more likely than nothing."""
        if (self.bias[:-1] >= self.bias[-1]).any():
            return ""
        strong = sorted({w for g in self.vocabulary for w in g.split(" ")} - self.weak())
        return r"(?<![\p{L}\p{N}])(?:" + _branches(strong) + r")(?![\p{L}\p{N}])"

    def table(self) -> str:
        return json.dumps({g: [round(float(v), 6) for v in row] for g, row in zip(self.vocabulary, self.weights, strict=True)})


def _branches(sorted_words: list[str]) -> str:
    """A pattern of the words, with common beginnings written once."""
    out = []
    for first, group in itertools.groupby((w for w in sorted_words if w), lambda w: w[0]):
        rest = [w[1:] for w in group]
        more = _branches(rest)
        out.append(re.escape(first) + (f"(?:{more})" + "?" * ("" in rest) if more else ""))
    return "|".join(out)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _plain(text: Column) -> Column:
    """Lower case and one spelling, as in words()."""
    return F.replace(F.lower(text), F.lit("licenc"), F.lit("licens"))


def _ngrams(text: Column) -> tuple[Column, Column]:
    """A plain paragraph's distinct words and word pairs, and its pairs."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    two = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(found, two)), two


def _paragraphs(text: Column) -> Column:
    """(paragraph, line): the text's paragraphs and the numbers of their first lines. Lines without their comment signs
    that a hard wrap has parted are one paragraph: none is blank, the first is of a length that a wrap makes, and the second
    goes on in lower case or, unless it opens a statement or the first ends one or is short, with a capital."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.regexp_replace(x, BEFORE, ""), AFTER, ""))

    def opens(last: Column, line: Column) -> Column:
        parted = line.rlike(r"^[^\p{L}]*\p{Lu}") & (last.rlike(STOPS) | line.rlike(OPENS) | (F.length(last) < FILLED))
        return (line == "") | ~F.length(last).between(SHORTEST, WIDEST) | parted

    def made(x: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(x, 1, F.size(x) - 1))
        first = F.filter(F.transform(F.zip_with(before, x, opens), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        return let(first, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(x))), lambda a, b: F.struct(a.alias("paragraph"), F.array_join(F.slice(x, a + 1, b - a), " ").alias("line"))))

    return let(lines, made)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once for each row: filters do not move below a generator, nor copy its input."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("made")
    return df.select(*(c for c in df.columns if c not in columns), made).select(*(c for c in df.columns if c not in columns), "made.*")


def train(docs: DataFrame) -> Classifier:
    """A classifier from the notices and a bounded sample of documents without a word of licences."""
    hashed = docs.select("text", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"))
    plain = hashed.where(F.col("text").isNotNull() & ~F.col("text").rlike(HINTS))
    # first which documents they are, so that no task sends more than these one's texts
    first = [(r["a"], r["b"]) for r in plain.select("a", "b").orderBy("a", "b").limit(SAMPLE_DOCS).collect()]
    last = max(first, default=(0, 0))[0]
    rows = [r for r in plain.where(F.col("a") <= last).dropDuplicates(["a", "b"]).collect() if (r["a"], r["b"]) in set(first)] if first else []
    nothing = [p for r in rows for p in r["text"].split("\n") if p.strip()]
    return Classifier.fit(sorted(nothing, key=lambda p: (len(p), p))[:: -(-len(nothing) // SAMPLE_PARAGRAPHS) or 1])


def license_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Paragraphs of docs (doc_id, text) that state a licence: lines, with those that a hard wrap has parted joined.

    Returns doc_id, paragraph (the number of its first line, from 0), family (or ``unknown``), probability (calibrated), similarity (the largest share of
    a notice's word pairs that the paragraph holds) and confirmed. Every paragraph is judged; those where nothing is most
    likely give no row; so do null and empty texts. Repeated rows are scanned each; other columns are ignored; an
    empty table gives an empty result."""
    model = model or train(docs)
    k = len(model.classes)
    weights = F.from_json(F.lit(model.table()), "map<string,array<double>>")
    zeros = F.array(*[F.lit(0.0)] * k)
    telling = model.telling()
    found = docs.where(_plain(F.col("text")).rlike(telling)).select("doc_id", F.inline(_paragraphs(F.col("text")))).withColumn("line", _plain(F.col("line"))).where(F.col("line").rlike(telling))
    grams, two = _ngrams(F.col("line"))
    found = _once(found, grams=grams, pairs=two)
    # only n-grams that the classifier knows reach the sum
    found = _once(found, grams=F.array_intersect("grams", F.array(*map(F.lit, model.vocabulary))))
    logits = F.aggregate("grams", F.array(*map(F.lit, model.bias.tolist())), lambda total, g: F.zip_with(total, F.coalesce(F.element_at(weights, g), zeros), lambda a, b: a + b))
    scored = _once(found, logits=F.transform(logits, lambda x: x / F.lit(model.temperature)))
    scored = scored.withColumn("most", F.array_max("logits"))
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    scored = scored.withColumn("best", F.array_position("logits", F.col("most")).cast("int")).withColumn("probability", F.lit(1.0) / total)
    scored = scored.withColumn("label", F.element_at(F.array(*map(F.lit, model.classes)), F.col("best"))).where(F.col("label") != NOTHING)
    family = F.when((F.col("probability") >= SURE), F.col("label")).otherwise(F.lit("unknown"))
    share = lambda notice: F.size(F.array_intersect("pairs", F.array(*map(F.lit, notice)))) / F.lit(float(len(notice)))
    similarity = F.lit(0.0)
    for name, group in NOTICES.items():
        notices = [sorted(set(p)) for p in (pairs(words(x)) for x in group) if p]
        if name != "unknown":
            similarity = F.when(F.col("label") == name, F.greatest(F.lit(0.0), *map(share, notices))).otherwise(similarity)
    return scored.select("doc_id", "paragraph", family.alias("family"), "probability", similarity.alias("similarity")).withColumn("confirmed", (F.col("family") != "unknown") & (F.col("similarity") >= CONFIRMED))
