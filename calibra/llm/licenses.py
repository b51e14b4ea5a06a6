"""Licence scan: a trained paragraph classifier on sparse word n-grams, with DataFrame functions only.

Paragraphs end at blank lines, so that a wrapped notice is one. Those that name a term of licensing become the set of their word pairs and triples.
A softmax regression over these, kept sparse by an L1 penalty, gives the probabilities of licence families and of `none`
(talk about licences that grants nothing). It is trained on the driver, on built-in labelled lines: notices and texts of
the families, parts of them, and everyday lines that use the same terms. A held-out part of them sets the temperature
and the probability under which a paragraph is `unknown`. A prediction counts when a template of its family agrees:
the paragraph's n-grams that a template holds, over the smaller of the two sets, reach CONFIRM; else it is `unknown`.

A paragraph without any term of TERMS has no feature (all n-grams kept contain one), so it is `none` without being scored.
A null or empty text has no paragraphs: family `none`, probability 0. Texts are read whole; rows are independent, so
repeated rows repeat their results; extra columns are not looked at; an empty table gives an empty result.
"""
from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.arrays import let
from calibra.llm._common import free_name, table

NONE, UNKNOWN = "none", "unknown"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What lies between paragraphs: a blank line.
PARAGRAPH = r"\n[ \t\r]*\n"
CONFIRM, FALSE_ACCEPT, L1, STEPS = 0.5, 0.01, 2e-4, 400
#: Words that a licence notice cannot do without; every feature contains one of them.
TERMS = "license licensed licence licenced licenses licensor copyright copyleft permission warranty redistribution redistribute apache gnu gpl lgpl agpl mozilla mpl bsd creativecommons commons cc cc0 spdx unlicense proprietary reserved unencumbered sublicense merchantability noninfringement domain permitted".split()
#: Notices and opening sentences of the families, written as they appear in the wild (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0",
        "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the terms of the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
        "Released under the GPL version 2.",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Released under the LGPL version 3."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 3.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Released under CC BY-SA 3.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC 3.0."],
    "CC0": ["Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software under the Unlicense", "Dedicated to the public domain."],
    "proprietary": ["Copyright All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.", "Copyright 2020 Example Corporation. All rights reserved.", "This software is proprietary and may not be distributed without written permission of the copyright owner."],
}
#: Everyday lines with the same terms that grant nothing.
OTHER = [
    "She renewed her driving license at the office last week.", "The restaurant is licensed to serve wine until midnight.", "He asked for permission to leave the room early.", "The car still has three years of warranty left.",
    "Copyright law has changed a lot since the last century.", "The Apache people lived in the south west.", "The gnu crossed the river with the herd.", "The house of commons met to debate the bill.",
    "The seats in the front are reserved for guests.", "A fishing license costs twenty dollars a year.", "The engine holds 50 cc of oil.", "Please cc me on your answer.", "The redistribution of income was debated for years.",
    "All rights and duties of a citizen are listed here.", "The licensed doctor moved to the city.", "Mozilla wrote a browser.", "Students at MIT built a robot.", "He lost his licence after the accident.", "They asked the licensing board for a new license in March.",
    "The teacher gave permission for the trip.", "Parking is reserved for members of the public.", "This work took three years and a new license.", "Version 3 of the bill mentions a general warranty.",
    "The domain of the function is the set of real numbers.", "He registered a domain name for the shop.", "Smoking is not permitted in the house.", "No dogs are permitted on the beach in summer.", "The public domain of the king ended at the river.",
]


def grams(line: str) -> set[str]:
    """Word pairs and triples that contain a term, as the DataFrame form `_grams` makes them."""
    words = re.findall(WORD, line.lower())
    terms = set(TERMS)
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1) if terms & set(words[i : i + n])}


def _examples(seed: int = 5) -> list[tuple[str, str]]:
    """Labelled lines: templates whole and in part, and set among unrelated words; everyday lines the same."""
    rng = np.random.default_rng(seed)
    pool = [w for line in OTHER for w in re.findall(r"[A-Za-z]+", line) if w.lower() not in TERMS]
    out = []
    for family, lines in [*TEMPLATES.items(), (NONE, OTHER)]:
        for line in lines:
            words = line.split()
            out += [(family, line)] * 3
            for _ in range(12):
                size = max(min(5, len(words)), int(len(words) * rng.uniform(0.5, 1)))
                at = int(rng.integers(0, len(words) - size + 1))
                around = [list(rng.choice(pool, int(rng.integers(0, 8)))) for _ in range(2)]
                part = words[at : at + size] if family != NONE else words
                out.append((family, " ".join([*around[0], *part, *around[1]])))
    for _ in range(300):
        words = list(rng.choice(pool, int(rng.integers(3, 25))))
        words.insert(int(rng.integers(0, len(words))), str(rng.choice(TERMS)))
        out.append((NONE, " ".join(words)))
    return out


class Model:
    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float, least: float):
        self.families, self.weights, self.bias, self.temperature, self.least = families, weights, bias, temperature, least

    def predict(self, line: str) -> tuple[str, float]:
        """The same as the DataFrame form, for one paragraph."""
        z = self.bias + sum((self.weights[g] for g in grams(line) if g in self.weights), np.zeros(len(self.bias)))
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(p.argmax())
        if self.families[k] == NONE:
            return NONE, float(p[k])
        return (self.families[k] if p[k] >= self.least and confirmed(line, self.families[k]) >= CONFIRM else UNKNOWN), float(p[k])


def confirmed(line: str, family: str) -> float:
    own = grams(line)
    return max(len(own & t) / min(len(own), len(t)) for t in map(grams, TEMPLATES[family])) if own else 0.0


@functools.cache
def train() -> Model:
    """Softmax regression by proximal gradient steps on the built-in examples; the size of the model is theirs."""
    families = [NONE, *TEMPLATES]
    rows = [(families.index(f), grams(line)) for f, line in _examples()]
    vocab = {g: i for i, g in enumerate(sorted({g for _, s in rows for g in s}))}
    x, y = np.zeros((len(rows), len(vocab))), np.array([r[0] for r in rows])
    for i, (_, s) in enumerate(rows):
        x[i, [vocab[g] for g in s]] = 1
    held = np.arange(len(rows)) % 5 == 3
    w, b = np.zeros((len(vocab), len(families))), np.zeros(len(families))
    goal = np.eye(len(families))[y]
    xt, gt = x[~held], goal[~held]
    for _ in range(STEPS):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - gt) / len(xt)
        w -= 4.0 * (xt.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * L1, 0)
        b -= 1.0 * g.sum(axis=0)
    z, truth = x[held] @ w + b, y[held]

    def soft(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature = float(min(np.geomspace(0.1, 4, 60), key=lambda t: -np.log(soft(t)[np.arange(len(truth)), truth] + 1e-12).mean()))
    p = soft(temperature)
    wrong = np.sort(p.max(axis=1)[(p.argmax(axis=1) != truth) & (p.argmax(axis=1) != 0)])
    allowed = int(FALSE_ACCEPT * len(truth))
    least = float(np.clip(wrong[-allowed - 1] if len(wrong) > allowed else 0.0, 0.3, 0.9))
    kept = {g: np.round(w[i], 6) for g, i in vocab.items() if np.abs(w[i]).sum() > 0}
    return Model(families, kept, np.round(b, 6), temperature, least)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _grams(line: Column) -> Column:
    """The pairs and triples around each term of a paragraph; its words are made once."""

    def around(words: Column) -> Column:
        terms = F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(_strings(TERMS), w), i)))
        spans = F.flatten(F.transform(terms, lambda p: F.array(*(F.struct((p - back).alias("at"), F.lit(n).alias("n")) for n in (2, 3) for back in range(n)))))
        whole = F.filter(spans, lambda s: (s["at"] >= 0) & (s["at"] + s["n"] <= F.size(words)))
        return F.array_distinct(F.transform(whole, lambda s: F.array_join(F.slice(words, s["at"] + 1, s["n"]), " ")))

    return let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), around)


def findings(text: Column, model: Model | None = None) -> Column:
    """array<struct<paragraph, family, probability, template>>: the paragraphs of a text that are not `none`."""
    model = model or train()
    vocab = sorted(model.weights)
    slots = {g: i for i, g in enumerate(vocab)}
    table_of = F.array(*(F.array(*(F.lit(float(v)) for v in model.weights[g])) for g in vocab))
    place = F.create_map(*(c for g, i in slots.items() for c in (F.lit(g), F.lit(i))))
    families = _strings(model.families)
    templates = F.array(*(F.array(*(_strings(sorted(grams(t))) for t in TEMPLATES.get(f, []))) if f != NONE else F.array(F.array(F.lit(""))) for f in model.families))
    lines = F.transform(F.split(text, PARAGRAPH), lambda line, i: F.struct(i.alias("i"), F.lower(line).alias("line")))
    has_term = lambda x: x["line"].rlike(_ANY_TERM)
    own = F.transform(F.filter(lines, has_term), lambda x: F.struct(x["i"].alias("i"), _grams(x["line"]).alias("g")))
    hits = F.transform(own, lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.array_intersect(x["g"], _strings(vocab)).alias("h")))
    zero = F.array(*(F.lit(float(v)) for v in model.bias))
    logits = F.transform(F.filter(hits, lambda x: F.size(x["h"]) > 0), lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.aggregate(x["h"], zero, lambda acc, g: F.zip_with(acc, F.element_at(table_of, F.element_at(place, g) + 1), lambda a, b: a + b)).alias("z")))
    scored = F.transform(logits, lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.array_position(x["z"], F.array_max(x["z"])).cast("int").alias("k"), (F.lit(1.0) / F.aggregate(F.transform(x["z"], lambda v: F.exp((v - F.array_max(x["z"])) / model.temperature)), F.lit(0.0), lambda a, b: a + b)).alias("p")))
    likeness = lambda x: F.array_max(F.transform(F.element_at(templates, x["k"]), lambda t: F.size(F.array_intersect(x["g"], t)) / F.least(F.size(x["g"]), F.size(t))))
    named = F.transform(F.filter(scored, lambda x: x["k"] > 1), lambda x: F.struct(x["i"].alias("i"), F.element_at(families, x["k"]).alias("f"), x["p"].alias("p"), likeness(x).alias("t")))
    return F.transform(named, lambda x: F.struct(x["i"].alias("paragraph"), F.when((x["p"] >= model.least) & (x["t"] >= CONFIRM), x["f"]).otherwise(F.lit(UNKNOWN)).alias("family"), x["p"].alias("probability"), x["t"].alias("template")))


_ANY_TERM = rf"(?<![a-z0-9])(?:{'|'.join(TERMS)})(?![a-z0-9])"


def _needles() -> list[str]:
    """TERMS without those that contain another one: a line holds one of these if it holds any term."""
    return [t for t in TERMS if not any(o != t and o in t for o in TERMS)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with licences: the paragraphs found, their family, probability and agreement with a template.

    A column of that name in docs is an error.
    """
    free_name(docs, "licences")
    low = F.lower(F.col(text))
    some = functools.reduce(lambda a, b: a | b, (low.contains(t) for t in _needles())) & low.rlike(_ANY_TERM)
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double,template:double>>")
    return docs.withColumn("licences", F.when(some, findings(F.col(text))).otherwise(empty))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    best = F.when(F.size(known) > 0, F.element_at(F.array_sort(known, lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(a["paragraph"] - b["paragraph"])), 1))
    return found.withColumn("_b", best).select("doc_id", F.when(F.col("_b").isNotNull(), F.col("_b.family")).when(F.size("licences") > 0, F.lit(UNKNOWN)).otherwise(F.lit(NONE)).alias("family"), F.round(F.coalesce("_b.probability", F.lit(0.0)), 6).alias("probability"), F.size("licences").cast("long").alias("n_paragraphs"), "licences")


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES: dict[str, str] = {}
