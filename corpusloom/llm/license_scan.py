"""License scans with a trained paragraph classifier.

The lines of a text between blank ones are a block; a paragraph is one or more adjacent lines of a block, long
lines parted into sentences. Two logistic regressions over hashed word n-grams are trained. The first tells
statements of licences from ordinary text. It scores every line of every text by sparse dot products, at the
``WINDOW`` words where it is highest, so that a statement inside a long line is found; n-grams reach across
the line breaks of a block, as in wrapped licence texts. Lines above ``GATE`` go to the second, a softmax over
ordinary text, licence families and licences of unknown kind. Its temperature is fitted on statements whose names
and sentences no part of their training set has, so that probabilities are calibrated. It is trained on
statements made from the families' names and sentences and fragments of these, on statements of unknown licences, and on at most
``PLAIN`` lines of the corpus, a sample by hash. Lines that hold a template, or that the first model itself takes for a
statement, as some in any corpus are, leave the sample and it is fitted anew.

A predicted family is confirmed by comparison with its templates: ``CONFIRM`` of the word trigrams of a template
must occur in the paragraph, which is extended line by line for that; a name of one or two words must occur
as it is. A statement that no family is confirmed for counts as unknown. Adjacent unknown paragraphs of a block
are one statement, and those that follow a confirmed one in its block are part of it.

Null and empty texts have no licence, and an empty table gives an empty result. Repeated rows are scanned alike;
other columns pass through, and one called like the result is replaced. Texts and lines may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import _words
from corpusloom.llm._shared import as_text, bounded_sample, quoted

BITS, EPOCHS, RATE, PLAIN = 14, 40, 1.0, 2000
ACCEPT, CONFIRM = 0.5, 0.8
#: The first model: slots, words at which a line is scored, and the probability from which a line is looked at.
GATE_BITS, WINDOW, GATE = 18, 12, 0.05
#: Lines of more words are parted into sentences.
LONG = 60
FOLDS = 2
#: Characters of a training line; the model is learned from samples, texts are scanned in full.
LINE = 600
NONE, UNKNOWN = "none", "unknown"

# --- fixed values: names and sentences of licence families, from the public licence texts ---
NAMES = {
    "AGPL": ["GNU Affero General Public License", "Affero GPL", "AGPL-3.0"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0 license"],
    "BSD": ["BSD License", "3-Clause BSD License", "BSD-3-Clause license", "2-Clause BSD License"],
    "CC-BY": ["CC BY", "CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["CC BY-ND", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL v2", "GPL-3.0 license"],
    "ISC": ["ISC License", "the ISC license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL v3"],
    "MIT": ["MIT License", "MIT license terms", "the MIT License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0 license"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
}
SENTENCES = {
    "Apache": ["You may obtain a copy of the License at http www apache org licenses LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "GPL": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "proprietary": ["All rights reserved", "This document is confidential and proprietary and may not be reproduced without written permission", "No part of this publication may be reproduced or transmitted in any form"],
    "public-domain": ["This work has been released into the public domain", "This work is dedicated to the public domain", "released into the public domain by its author"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
FRAMES = ["Licensed under {}", "Licensed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This program is free software under the {}", "This project is available under the {}", "See {} for details", "SPDX-License-Identifier: {}", "{}", "Code is published under {}"]
SPDX = {"AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache": ["Apache-2.0"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "CC-BY": ["CC-BY-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC0": ["CC0-1.0"], "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"], "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"], "MPL": ["MPL-2.0"], "Unlicense": ["Unlicense"]}
INVENTED = ["Foobar Public Agreement", "Sunrise Community Terms 1.2", "Example Corp Evaluation Agreement", "Harbor Shared Source Terms", "a custom agreement", "the terms of the vendor", "Open Meadow Licence 3", "terms agreed between the parties", "Zeta", "the Quill Software License", "Northwind Public License 1.0"]
UNKNOWNS = ["Use of this software is governed by the vendor agreement", "You may use this code only in accordance with the agreement", "You may not copy or redistribute this work without a license", "Usage is subject to the license agreement that comes with the product", "This software is provided under a separate license", "Permission to use this material is granted to members only", "This file is part of a product and subject to its terms of use", "See the LICENSE file for the terms of use", "Distribution of this document is subject to the terms below", "The code may be used free of charge for academic purposes only"]
# --- end of fixed values ---

_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_TOKEN = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)}


def templates() -> dict[str, list[set[tuple[str, ...]]]]:
    """For each family the trigrams of its templates; names of fewer than three words also stand in their frames."""
    out: dict[str, list[set[tuple[str, ...]]]] = {}
    for family, names in NAMES.items():
        for name in names:
            words = tokens(name)
            texts = [words] if len(words) >= 3 else [words] + [tokens(f.format(name)) for f in FRAMES if len(tokens(f.format(name))) >= 3]
            out.setdefault(family, []).extend(grams(w) for w in texts)
    for family, sentences in SENTENCES.items():
        out.setdefault(family, []).extend(grams(tokens(s)) for s in sentences)
    for family, ids in SPDX.items():
        out.setdefault(family, []).extend(grams(tokens(f"SPDX-License-Identifier: {i}")) for i in ids)
    return out


def examples() -> list[tuple[str, str, str]]:
    """(statement, class, what it was made of): held-out sets are drawn by the last."""
    out = [(f.format(name), family, name) for family, names in NAMES.items() for name in names for f in FRAMES]
    out += [(f"SPDX-License-Identifier: {i}", family, i) for family, ids in SPDX.items() for i in ids for _ in range(2)]
    out += [(f.format(name), UNKNOWN, name) for name in INVENTED for f in FRAMES if f != "{}"]
    out += [(text, UNKNOWN, u) for u in UNKNOWNS for text in (u, f"{u}.", f"Notice: {u}.")]
    for family, sentences in SENTENCES.items():
        for s in sentences:
            out += [(text, family, s) for text in (s, f"{s}.", f"Notice: {s}. Thank you.", f"Copyright 2020 the authors. {s}.")] * 2
            # lines of wrapped texts
            words = s.split()
            out += [(" ".join(words[i : i + n]), family, s) for n in (6, 10) for i in range(0, max(1, len(words) - n + 1), 3)]
    return out


class Sparse(NamedTuple):
    """Rows of slots, all values equal: the row and slot of each entry, and a scale by row."""

    row: np.ndarray
    slot: np.ndarray
    scale: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.scale), w.shape[1]))
        for c in range(w.shape[1]):
            out[:, c] = np.bincount(self.row, w[self.slot, c], len(self.scale))
        return out * self.scale[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def regress(rows: Sparse, kind: np.ndarray, classes: int, slots: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights by slot and class after EPOCHS steps of adaptive gradients over all rows."""
    used, at = np.unique(rows.slot, return_inverse=True)
    rows = rows._replace(slot=at)
    w, seen, steps = np.zeros((len(used), classes)), np.full((len(used), classes), 1e-6), np.eye(classes)[kind]
    weight = np.ones(len(kind)) if weight is None else weight
    for _ in range(EPOCHS):
        slope = (_softmax(rows.times(w)) - steps) * (rows.scale * weight)[:, None]
        g = np.stack([np.bincount(at, slope[rows.row, c], len(used)) for c in range(classes)], axis=1)
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    out = np.zeros((slots, classes))
    out[used] = w
    return out


def _slots(words: list[str]) -> np.ndarray:
    """Slots of the word uni-, bi- and trigrams, the intercept last."""
    found = {zlib.crc32(" ".join(words[i : i + n]).encode()) & ((1 << BITS) - 1) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.array([*sorted(found), 1 << BITS])


def _sparse(rows: list[np.ndarray]) -> Sparse:
    size = np.array([len(r) for r in rows])
    return Sparse(np.repeat(np.arange(len(rows)), size), np.concatenate(rows), 1 / np.sqrt(size))


def _plain(lines: pa.Array) -> pa.Array:
    """The words of tokens() parted by blanks: lower case, other characters than letters, digits and inner . + - are gaps."""
    plain = pc.replace_substring_regex(pc.ascii_lower(lines), r"[^a-z0-9.+-]+|[.+-]+(?:[^a-z0-9]|$)|[.+-]{2,}", " ")
    return pc.replace_substring_regex(plain, r"(^|\s)[.+-]+", " ")


def _gate_slots(lines: pa.Array, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Line number and slots of the n-grams that end in each word, uni-, bi- and trigram, in pieces; -1 for none.

    N-grams stay within a block of lines. Each piece repeats the last WINDOW words of the one before, so that every
    run of so many words is whole in some piece.
    """
    keep = WINDOW + 2
    h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for found in _words.words(_plain(lines)):
        new, line = found.hashes[found.carried :], found.text[found.carried :]
        h, at = np.concatenate([h[-keep:], new]), np.concatenate([at[-keep:], line])
        slots = np.full((3, len(h)), -1, np.int64)
        run = h * np.uint64(0)
        with np.errstate(over="ignore"):
            for n in range(3):
                mixed = run[: len(h) - n] * np.uint64(0)
                for k in range(n + 1):
                    mixed = mixed * np.uint64(11) + h[k : k + len(h) - n]
                same = block[at[n:]] == block[at[: len(h) - n]]
                slots[n, n:][same] = (_words.mix(mixed[same] + np.uint64(n)) & np.uint64((1 << GATE_BITS) - 1)).astype(np.int64)
        yield at, slots


def gate_scores(lines: pa.Array, block: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of each line that it is or holds a statement, at its best WINDOW words; the last of ``w`` is the intercept and
    counts for n-grams that are not there as well, with weight 0."""
    out = np.full(len(lines), -np.inf)
    known = np.append(w[:-1], 0.0)
    for at, slots in _gate_slots(lines, block):
        each = known[slots].sum(axis=0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        i = np.arange(1, len(each) + 1)
        # windows end in each word and begin some words before, within the block or the line
        first, own = (np.searchsorted(x, x, side="left") for x in (block[at], at))
        for n, least in ((WINDOW // 3, first), (WINDOW * 2 // 3, first), (WINDOW, first), (WINDOW, own)):
            begin = np.maximum(i - n, least)
            score = w[-1] + (total[i] - total[begin]) / np.sqrt(3 * np.maximum(i - begin, 4))
            line = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[line]] = np.maximum(out[at[line]], np.maximum.reduceat(score, line)) if len(line) else 0
    return out


def _gate_rows(texts: list[str]) -> Sparse:
    """The best a window can hold of each example: its first WINDOW words."""
    cut_off = pa.array([" ".join(tokens(t)[:WINDOW]) for t in texts])
    row, slot = [], []
    for at, slots in _gate_slots(cut_off, np.arange(len(texts))):
        for s in slots:
            row.append(at[s >= 0])
            slot.append(s[s >= 0])
    pairs = np.unique(np.stack([np.concatenate(row), np.concatenate(slot)]), axis=1)
    words = np.array([max(4, min(WINDOW, len(tokens(t)))) for t in texts])
    return Sparse(pairs[0], pairs[1], 1 / np.sqrt(3 * words))


def _short(line: str) -> str:
    """The first one to eight words of a line, as short lines are ordinary text as well."""
    return " ".join(tokens(line)[: 1 + zlib.crc32(line.encode()) % 8])


def gate(plain: list[str]) -> tuple[np.ndarray, list[str]]:
    """Weights of the first model, the intercept last, and the lines that it takes for ordinary text.

    Each half of the lines is judged by a model fitted on the other half; what is taken for a statement leaves.
    """
    made = sorted({text for text, _, _ in examples()})

    def fitted(lines: list[str]) -> np.ndarray:
        pieces = [" ".join(t[i : i + WINDOW]) for line in lines for t in [tokens(line)] for i in range(0, max(1, len(t)), WINDOW)]
        texts = [*made, *pieces, *map(_short, lines), ""]
        rows, n = _gate_rows(texts), len(texts)
        wide = Sparse(np.append(rows.row, np.arange(n)), np.append(rows.slot, np.full(n, 1 << GATE_BITS)), rows.scale)
        label = np.arange(n) < len(made)
        # both kinds count alike in sum
        weight = np.where(label, n / (2 * len(made)), n / (2 * (n - len(made))))
        w = regress(wide, label.astype(int), 2, (1 << GATE_BITS) + 1, weight)
        return w[:, 1] - w[:, 0]

    halves: list[list[str]] = [[], []]
    for line in plain:
        halves[zlib.crc32(line.encode()) % 2].append(line)
    kept = []
    for own, other in (halves, halves[::-1]):
        score = gate_scores(pa.array(own, pa.string()), np.arange(len(own)), fitted(other))
        kept += [line for line, z in zip(own, score) if z < 0]
    return fitted(kept), kept


class Model(NamedTuple):
    classes: list[str]
    weights: np.ndarray
    temperature: float
    templates: dict[str, list[set[tuple[str, ...]]]]
    gate: np.ndarray
    reach: int  # words of the longest template
    places: dict[tuple[str, ...], list[int]]  # the templates, by number, that hold a gram
    sizes: list[int]  # grams of each template

    def probabilities(self, words: list[str]) -> np.ndarray:
        slots = _slots(words)
        return _softmax(self.weights[slots].sum(axis=0, keepdims=True) / np.sqrt(len(slots)) / self.temperature)[0]

    def confirmed(self, name: str, words: list[str]) -> bool:
        """Whether the words hold a template of the family."""
        own = grams(words) | grams(words, 2) | grams(words, 1)
        return max(len(t & own) / len(t) for t in self.templates[name]) >= CONFIRM

    def holds_any(self, parts: Iterator[list[str]]) -> Iterator[bool]:
        """Whether the words of the parts up to each hold a template of any family; once they do, longer runs do as well."""
        tail, seen, hits, held = [], set(), dict.fromkeys(range(len(self.sizes)), 0), False
        for words in parts:
            run = tail + words
            for n in (1, 2, 3):
                # the grams that end in the new words
                for gram in () if held else zip(*(run[max(0, len(tail) - n + 1) + k :] for k in range(n))):
                    if gram in self.places and gram not in seen:
                        seen.add(gram)
                        for t in self.places[gram]:
                            hits[t] += 1
                            held |= hits[t] / self.sizes[t] >= CONFIRM
            tail = run[-2:]
            yield held

    def classify(self, paragraph: str) -> tuple[str, float]:
        """Class and probability; a family must be confirmed by a template."""
        words = tokens(paragraph)
        p = self.probabilities(words)
        for c in np.argsort(-p):
            name = self.classes[c]
            if name not in (NONE, UNKNOWN) and p[c] >= ACCEPT and self.confirmed(name, words):
                return name, float(p[c])
        none = float(p[self.classes.index(NONE)])
        return (NONE, none) if none >= ACCEPT else (UNKNOWN, 1 - none)

    def statements(self, lines: list[str], wanted: list[int]) -> Iterator[tuple[str, float, str]]:
        """(family, probability, paragraph) of the statements that begin in the wanted lines, blank lines parting."""
        parts, numbers, chosen = [], [], []
        want = set(wanted)
        for i, line in enumerate(lines):
            pieces = _SENTENCE.split(line) if i in want and len(tokens(line)) > LONG else [line]
            if i in want:
                chosen += range(len(parts), len(parts) + len(pieces))
            parts += pieces
            numbers += [i] * len(pieces)
        held: list[tuple[str, float, int, int]] = []
        known: dict[int, list[str]] = {}

        def words(k: int) -> list[str]:
            if k not in known:
                known[k] = tokens(parts[k])
            return known[k]

        after = 0
        for i in chosen:
            if i < after:
                continue
            family, p = self.classify(parts[i])
            end, read = i + 1, len(words(i))
            stop = i + 1
            holds = self.holds_any(words(k) for k in range(i, len(parts)))
            next(holds)
            while family in (NONE, UNKNOWN) and end < len(parts) and words(end) and read < 2 * self.reach:
                read += len(words(end))
                end += 1
                # without a template no family is confirmed
                if not next(holds):
                    continue
                joined, q = self.classify("\n".join(parts[i:end]))
                if joined not in (NONE, UNKNOWN):
                    # a statement of the later lines alone begins there
                    if self.confirmed(joined, tokens("\n".join(parts[i + 1 : end]))):
                        break
                    family, p, stop = joined, q, end
            after = stop
            if family == NONE:
                continue
            if family == UNKNOWN and held and all(words(k) for k in range(held[-1][3], i)):
                # the rest of a licence text, or one more line of an unknown one
                before = held.pop()
                held.append((before[0], max(before[1], p) if before[0] == UNKNOWN else before[1], before[2], stop))
            else:
                held.append((family, p, i, stop))
        for family, p, a, b in held:
            text = parts[a]
            for k in range(a + 1, b):
                text += ("\n" if numbers[k] != numbers[k - 1] else " ") + parts[k]
            yield family, p, text


def fit(plain: list[str]) -> Model:
    """Train on the fixed statements and the lines of ordinary text.

    The temperature is fitted on held-out parts, by what a statement was made of.
    """
    made = templates()
    held = lambda t: grams(t) | grams(t, 2) | grams(t, 1)
    plain = [line for line in plain if not any(len(t & own) >= CONFIRM * len(t) for own in [held(tokens(line))] for sets in made.values() for t in sets)]
    first, plain = gate(plain)
    rows = examples() + [(text, NONE, line) for line in plain for text in (line, _short(line))] + [("", NONE, "")]
    classes = [NONE, UNKNOWN, *sorted({c for _, c, _ in rows} - {NONE, UNKNOWN})]
    data = [_slots(tokens(text)[: 2 * WINDOW]) for text, _, _ in rows]
    kind = np.array([classes.index(c) for _, c, _ in rows])
    fold = np.array([zlib.crc32(group.encode()) % FOLDS for _, _, group in rows])
    z = np.zeros((len(rows), len(classes)))
    for k in range(FOLDS):
        old, new = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(old) and len(new):
            z[new] = _sparse([data[i] for i in new]).times(regress(_sparse([data[i] for i in old]), kind[old], len(classes), (1 << BITS) + 1))

    def loss(t: float) -> float:
        return float(-np.mean(np.log(_softmax(z / t)[np.arange(len(kind)), kind] + 1e-12)))

    best = min(np.geomspace(0.25, 8, 41), key=loss)
    w = regress(_sparse(data), kind, len(classes), (1 << BITS) + 1)
    longest = max(len(tokens(x)) for values in (*NAMES.values(), *SENTENCES.values()) for x in values)
    flat = [t for sets in made.values() for t in sets]
    places: dict[tuple[str, ...], list[int]] = {}
    for n, t in enumerate(flat):
        for gram in t:
            places.setdefault(gram, []).append(n)
    return Model(classes, w, float(best), made, first, longest, places, [len(t) for t in flat])


def _candidates(texts: pa.Array, w: np.ndarray) -> Iterator[tuple[int, list[str], list[int]]]:
    """(text number, its lines, numbers of the lines that the first model takes for statements)."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    lines = split.flatten()
    parent = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    # lines without words and new texts begin a block
    blank = ~pc.match_substring_regex(lines, r"[A-Za-z0-9]").to_numpy(zero_copy_only=False)
    block = np.cumsum(blank | np.diff(parent, prepend=-1).astype(bool))
    wanted = np.flatnonzero(gate_scores(lines, block, w) >= np.log(GATE / (1 - GATE)))
    begins = np.searchsorted(parent, np.arange(len(split)))
    owner = parent[wanted]
    for i in np.unique(owner):
        a, b = np.searchsorted(owner, [i, i + 1])
        yield int(i), split[int(i)].as_py(), (wanted[a:b] - begins[i]).tolist()


_FOUND = T.ArrayType(T.StructType([T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("paragraph", T.StringType())]))


def _scanner(model: Broadcast) -> Callable:
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("paragraph", pa.string())]))

    @F.arrow_udf(_FOUND)
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for i, lines, wanted in _candidates(texts, model.value.gate):
                for family, p, paragraph in model.value.statements(lines, wanted):
                    out[i].append({"family": family, "probability": p, "paragraph": paragraph})
            yield pa.array(out, kind)

    return scan_texts


def plain_lines(df: DataFrame, text_col: str = "text") -> list[str]:
    """At most PLAIN lines of the corpus, as examples of ordinary text: a sample by hash of the lines of a sample of texts."""
    texts = df.select(as_text(text_col).alias("text"))
    every = max(1, df.count() // (4 * PLAIN))
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).where("line rlike '[A-Za-z0-9]'")
    sample = bounded_sample(lines.select(F.substring("line", 1, LINE).alias("line"), F.xxhash64("line").alias("h")), "h", PLAIN, "line")
    return [r.line for r in sample.dropDuplicates(["line"]).orderBy("h", "line").collect()]


def scan(df: DataFrame, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """Add an array of (family, probability, paragraph), one for each licence statement in the order of the text."""
    model = df.sparkSession.sparkContext.broadcast(fit(plain_lines(df, text_col)))  # 5 MB of weights
    return df.withColumn(out_col, _scanner(model)(as_text(text_col)))


def summary(df: DataFrame, out_col: str = "licenses") -> DataFrame:
    """Add families (distinct, sorted), n_statements and the largest probability."""
    found = quoted(out_col)
    return (
        df.withColumn("families", F.array_sort(F.array_distinct(found["family"])))
        .withColumn("n_statements", F.size(found).cast("long"))
        .withColumn("probability", F.array_max(found["probability"]))
    )
