"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms; SQL functions only.

A paragraph ends at a blank line; its lines are joined without comment marks, so a wrapped notice is read as a whole. Where the
whole paragraph is no notice, its pieces, which end at line ends and sentence ends, are judged one by one. Words and pairs of
words are the features of a sparse multinomial logistic regression over licence families and an unknown class. It is
trained on the driver: positives are cuts and noisy copies of the templates below; negatives are made-up prose, sentences that
speak of licences without granting one, and paragraphs of the corpus itself that share no two pairs of words with a
template, from a sample of documents whose size is a parameter. A temperature is fitted on held-out examples, and the least
probability for a family is set on the held-out unknown ones, corpus paragraphs among them. A family counts only where enough
of the text's pairs of words are pairs of that family's templates.
"""

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Notices by which each family is granted, paragraph by paragraph (fixed values).
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL version 3",
        "Licensed under the GNU AGPLv3",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0",
        "Distributed under the Apache 2.0 license",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
        "Use, modification and distribution are subject to the Boost Software License, Version 1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License",
        "Licensed under the BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Available under the Creative Commons Attribution License",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Text is available under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Available under CC BY-NC-SA 4.0 for non-commercial use",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released into the public domain under CC0 1.0 Universal",
        "Dedicated to the public domain under CC0",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, version 2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 2",
        "Licensed under the GNU GPL v3",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License",
        "Licensed under the ISC license",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/",
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL version 3",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license",
        "The MIT License (MIT)",
        "Distributed under the MIT License",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0",
    ),
    "reserved": (
        "Copyright. All rights reserved",
        "All rights reserved",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited",
        "This material may not be published, broadcast, rewritten, or redistributed without permission",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
        "Released under the zlib license",
    ),
}
#: Sentences that speak of licences and grant none; {} stands for a family's name (fixed values).
NEGATIVES = (
    "The driver must show a valid driving licence on request",
    "The city will not renew the liquor license of the club",
    "Her license plate was found near the road",
    "The committee discussed which license to choose",
    "He was licensed as a doctor in the spring",
    "The apache helicopter landed near the base",
    "Students at MIT built a small robot",
    "The gnu is a large animal of the savanna",
    "All seats are reserved for members",
    "Permission was granted to leave the room",
    "The warranty on the car is over",
    "A fishing licence costs ten euro a year",
    "Copyright law was the topic of the lecture",
    "The public domain of the river is wide",
    "You may not use this door",
    "The software was free of charge for a year",
    "Terms and conditions apply to this offer",
    "Redistribution of income was the aim of the tax",
    "He wrote an essay about software released under the {} license and its history",
    "The lecture compares the {} license with older licences of public software",
    "Many projects moved away from the {} license in the last ten years",
    "She asked why the {} license was chosen for the library",
    "Critics say that the {} license is hard to read",
)
NAMES = ("MIT", "Apache", "BSD", "GNU General Public", "Mozilla Public", "Creative Commons Attribution", "ISC", "Eclipse Public", "Boost Software", "zlib")  # fixed values
FAMILIES = tuple(TEMPLATES)
STOP = frozenset("a an and any are as at be by for from if in is it its of on one or that the this to was were which with you not may all no has her his he".split())
MARK = r"[\x20\t\r]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--)?[\x20\t\r]*"
BREAK = rf"\n(?:{MARK}\n)+"
PIECE = r"\n|(?<=[.!?;:])[\x20\t]+"
WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(line: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def grams(line: str) -> set[str]:
    t = tokens(line)
    return set(t) | {f"{a} {b}" for a, b in zip(t, t[1:])}


@lru_cache(maxsize=64)
def pairs(family: str) -> tuple[str, ...]:
    return tuple(sorted({g for s in TEMPLATES[family] for g in grams(s) if " " in g}))


@lru_cache(maxsize=1)
def gate() -> str:
    """A regex of all templates' pairs of words, but those of two stop words: a text without one can't be confirmed."""
    tree: dict = {}
    for f in FAMILIES:
        for a, b in (g.split() for g in pairs(f)):
            if not {a, b} <= STOP:
                at = tree
                for c in f"{a} {b}$":
                    at = at.setdefault(c, {})
    sign = {" ": "[^a-zA-Z0-9]+", "$": "(?![a-zA-Z0-9])"}

    def regex(t: dict) -> str:
        some = [sign.get(c, c) + (regex(u) if u else "") for c, u in sorted(t.items())]
        return some[0] if len(some) == 1 else f"(?:{'|'.join(some)})"

    return "(?i)(?<![a-zA-Z0-9])" + regex(tree)


def negatives() -> list[str]:
    return [s.format(n) for s in NEGATIVES for n in (NAMES if "{" in s else NAMES[:1])]


def vocabulary() -> list[str]:
    every = set().union(*(grams(s) for group in TEMPLATES.values() for s in group), *map(grams, negatives()))
    return sorted(g for g in every if g not in STOP)


def examples(n: int, seed: int, background: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """Made paragraphs and their classes; the last class is unknown, and a third of it comes from the background."""
    rng = np.random.default_rng(seed)
    filler = ["".join(rng.choice(list("aeionrstlh"), int(rng.integers(2, 9)))) for _ in range(200)] + sorted(STOP)
    noise = lambda k: [str(w) for w in rng.choice(filler, k)]
    out, wrong = [], negatives()
    for i in range(n):
        if i % 2:
            k = int(rng.integers(len(FAMILIES)))
            words = str(rng.choice(TEMPLATES[FAMILIES[k]])).split()
            if len(words) > 9 and rng.random() < 0.4:
                at = int(rng.integers(0, len(words) - 8))
                words = words[at : at + int(rng.integers(8, len(words) + 1))]
            words = [w for w in words if rng.random() > 0.04]
            words = noise(int(rng.integers(0, 6))) + words + noise(int(rng.integers(0, 6)))
        else:
            k, words = len(FAMILIES), noise(int(rng.integers(1, 40)))
            if background and rng.random() < 0.33:
                words = str(rng.choice(background)).split()
            elif rng.random() < 0.7:
                words = words[: len(words) // 3] + str(rng.choice(wrong)).split() + words[len(words) * 2 // 3 :]
            elif rng.random() < 0.5:  # single words of templates, out of their order
                pool = " ".join(TEMPLATES[str(rng.choice(FAMILIES))]).split()
                words += [str(w) for w in rng.choice(pool, min(4, len(pool)))]
        out.append((" ".join(words), k))
    return out


def _matrix(rows: list[str], vocab: list[str]) -> np.ndarray:
    at = {g: i for i, g in enumerate(vocab)}
    x = np.zeros((len(rows), len(vocab)), np.float32)
    for r, line in enumerate(rows):
        x[r, [at[g] for g in grams(line) if g in at]] = 1
    return x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=4)
def train(background: tuple[str, ...] = (), n: int = 3000, seed: int = 5, steps: int = 150, l1: float = 2e-4, false_rate: float = 0.002) -> tuple:
    """(vocabulary, weights, biases, temperature, least probability), by proximal gradient steps, which make weights sparse."""
    vocab, unknown = vocabulary(), len(FAMILIES)
    rows = examples(n, seed, background[::2])
    x, y = _matrix([s for s, _ in rows], vocab), np.eye(unknown + 1, dtype=np.float32)[[k for _, k in rows]]
    w, b = np.zeros((len(vocab), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, rate = w, 2.0
    for i in range(steps):
        g = (_softmax(x @ v + b) - y) / n
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        b = b - rate * g.sum(0)
        v, w = new + (i / (i + 3)) * (new - w), new
    held = examples(n, seed + 1, background[1::2]) + [(s, unknown) for s in background[1::2]]
    z, k = _matrix([s for s, _ in held], vocab) @ w + b, np.array([k for _, k in held])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(k)), k] + 1e-12).mean()
    t = min(np.linspace(0.3, 3, 28), key=loss)
    p = _softmax(z / t)[:, :-1].max(1)
    least = max(0.5, float(np.quantile(p[k == unknown], 1 - false_rate)))
    used = np.abs(w).max(1) > 1e-9
    return tuple(g for g, u in zip(vocab, used) if u), w[used].astype(float).round(6), b.astype(float).round(6), float(t), round(min(least, 0.95), 6)


def confirmed(same, n):
    """Whether `same` of a text's n pairs of words, those of a family's templates, are enough: half of them, or a quarter of many."""
    return (same >= 2) & ((2 * same >= n) | (same >= 12) & (4 * same >= n))


def judge(text: str, background: tuple[str, ...] = ()) -> tuple[str | None, float]:
    """(family or None, probability) of one text as a whole."""
    vocab, w, b, t, least = train(background)
    if not re.search(gate(), text, re.ASCII):
        return None, 0.0
    p = _softmax((_matrix([text], list(vocab)) @ w + b) / t)[0]
    k = int(p[:-1].argmax())
    own = {g for g in grams(text) if " " in g}
    return (FAMILIES[k] if p[k] >= least and confirmed(len(own & set(pairs(FAMILIES[k]))), len(own)) else None), float(p[k])


def background(df: DataFrame, documents: int = 400, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, ...]:
    """Paragraphs that share fewer than two pairs of words with every template, from about `documents` texts of at most `longest`
    characters, chosen by a hash, so the sample doesn't depend on partitions. Only training reads it; twice as many texts are the
    most that reach the driver."""
    text = text_of(text_col)
    rows = df.select(text.alias("text"), F.xxhash64(df[id_col], text).alias("h")).where(F.length("text").between(1, longest))
    some = rows.where(F.pmod("h", F.lit(max(1, df.count()))) < documents).limit(2 * documents).collect()
    known = [set(pairs(f)) for f in FAMILIES]
    out = []
    for r in sorted(some, key=lambda r: r["h"]):
        for p in re.split(BREAK, r["text"]):
            own = grams(p)
            if own and max(len(own & k) for k in known) < 2:
                out.append(" ".join(p.split()))
    return tuple(out[:2000])


def _scores(idx: Column, model: tuple) -> list[Column]:
    _, w, b, t, _ = model
    out = []
    for k in range(len(FAMILIES) + 1):
        weights = F.array(*[F.lit(float(v)) for v in w[:, k]])
        out.append((F.aggregate(idx, F.lit(float(b[k])), lambda a, i: a + F.get(weights, i)) / F.lit(t)).alias(f"z{k}"))
    return out


def units(text: Column) -> Column:
    """array<struct<par, off, t>>: the whole of each paragraph that shares a pair of words with a template (off -1), and the pieces
    of those that have several, by number."""
    whole = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, rf"^{MARK}", ""), rf"\n{MARK}", " "))
    paragraphs = F.filter(F.transform(F.split(text, BREAK, -1), lambda p, i: F.struct(i.alias("par"), p.alias("p"))), lambda x: x["p"].rlike(gate()))
    piece = lambda x: F.filter(F.transform(F.split(x["p"], PIECE, -1), lambda s, j: F.struct(x["par"].alias("par"), j.alias("off"), F.regexp_replace(s, rf"^{MARK}", "").alias("t"))), lambda y: y["t"].rlike(gate()))
    each = lambda x: F.concat(F.array(F.struct(x["par"].alias("par"), F.lit(-1).alias("off"), whole(x["p"]).alias("t"))), F.when(F.size(F.split(x["p"], PIECE, -1)) > 1, piece(x)).otherwise(F.array().cast("array<struct<par:int,off:int,t:string>>")))
    return F.flatten(F.transform(paragraphs, each))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each input row: (doc_id, n_paragraphs, found); found is an array of (paragraph, family, probability), in order.

    Paragraphs are numbered from 0. A paragraph has a family if it is a notice as a whole, else one for each of its pieces that
    is. Null and empty texts have no paragraphs, repeated rows and null ids are judged alike, equal probabilities go to the family
    first by name, and an empty table gives an empty one. Nothing is shuffled: texts that share a pair of words with a template
    are scored inside their row, whatever their length, and the others are unknown, as no template can confirm them. Further
    columns of any name are not read. `sample` are the background paragraphs; if not given, background() finds them.
    """
    model = train(background(df, id_col=id_col, text_col=text_col) if sample is None else sample)
    vocab, _, _, _, least = model
    none = F.array().cast("array<struct<par:int,off:int,t:string>>")
    d = df.select(df[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    n = F.size(F.filter(F.split("text", BREAK, -1), lambda x: x.rlike(WORD))).cast("long")
    d = d.select("doc_id", n.alias("n_paragraphs"), F.when(F.col("text").rlike(gate()), units(F.col("text"))).otherwise(none).alias("u"))

    def step(make) -> None:
        nonlocal d
        d = d.withColumn("u", F.transform("u", lambda x: F.struct(x["par"].alias("par"), x["off"].alias("off"), *make(x))))

    step(lambda x: [F.regexp_extract_all(F.translate(x["t"], UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)).alias("t")])
    step(lambda x: [x["t"].alias("t"), F.array_distinct(F.when(F.size(x["t"]) > 1, F.zip_with(F.slice(x["t"], F.lit(1), F.size(x["t"]) - 1), F.slice(x["t"], F.lit(2), F.size(x["t"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))).alias("g")])
    known = F.array(*map(F.lit, vocab))
    step(lambda x: [x["g"].alias("g"), F.transform(F.array_intersect(F.array_union(x["t"], x["g"]), known), lambda g: F.array_position(known, g).cast("int") - 1).alias("i")])
    step(lambda x: [x["g"].alias("g"), F.array(*_scores(x["i"], model)).alias("z")])
    top = lambda z: F.array_max(F.slice(z, 1, len(FAMILIES)))
    step(lambda x: [x["g"].alias("g"), (F.array_position(F.slice(x["z"], 1, len(FAMILIES)), top(x["z"])) - 1).cast("int").alias("k"), (F.lit(1.0) / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - top(x["z"])))).alias("p")])
    own = F.array(*[F.array(*map(F.lit, pairs(f))) for f in FAMILIES])
    step(lambda x: [x["k"].alias("k"), x["p"].alias("p"), F.size(x["g"]).alias("n"), F.size(F.array_intersect(x["g"], F.get(own, x["k"]))).alias("same")])
    d = d.withColumn("u", F.filter("u", lambda x: (x["p"] >= F.lit(least)) & confirmed(x["same"], x["n"])))
    d = d.withColumn("u", F.filter("u", lambda x: (x["off"] < 0) | ~F.exists("u", lambda y: (y["par"] == x["par"]) & (y["off"] < 0))))
    names = F.array(*map(F.lit, FAMILIES))
    return d.select("doc_id", "n_paragraphs", F.transform("u", lambda x: F.struct(x["par"].alias("paragraph"), F.get(names, x["k"]).alias("family"), F.round(x["p"], 4).alias("probability"))).alias("found"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat(x["paragraph"].cast("string"), F.lit(":"), x["family"])), ",").alias("paragraphs"),
    )
