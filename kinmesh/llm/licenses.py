"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line with a word, or several that were wrapped: a line of WRAPPED characters that doesn't end a sentence goes on in
the next line with a word right below it.  Sparse features (which word unigrams and bigrams of the known vocabulary
occur) go into a multinomial logistic regression over the licence families and the class unknown.  It is
trained on variations of the templates (words dropped, noise around, pieces) and on paragraphs that carry no
licence: ordinary sentences, sentences that only use licence words, and a bounded sample of the corpus's own
paragraphs.  A temperature and the least probability of a family are set on held-out variations, so that at most
FALSE_SHARE of held-out unknown paragraphs pass.  A predicted family is confirmed if its closest template holds
enough of the paragraph's known n-grams, or the paragraph enough of the template's; else it stays unknown.

The corpus sample: SAMPLE documents at most, by a hash of their ids, LINES lines in all; only lines without
an unmistakable licence word are taken.  Every paragraph of every document is classified, whole.

Null text: no paragraph.  Very long texts are scanned whole, a paragraph at a time.  Null ids, repeated rows and extra columns don't
matter: each row stands for itself.  Empty table: empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, LINES = 2000, 4000
VARIATIONS, EPOCHS, RATE, PENALTY = 30, 60, 0.5, 1e-5
FALSE_SHARE = 0.001
#: Share of the template's n-grams in the paragraph, or of the paragraph's words under the template, that confirm.
CONFIRM = 0.6
UNKNOWN = "unknown"
#: Characters of a line that may have been wrapped, at least and at most; what ends a sentence or a heading.
WRAPPED, ENDS = (40, 120), re.compile(r"[.!?:;\"')\]]\s*$")
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Lines of the corpus sample with these words are left out of the unknown class.
TELLING = re.compile(r"licen[sc]e|copyright|\bgpl\b|\bwarranty\b|all rights|redistribut|creative commons|\bcc[ -](?:by|0)|public domain", re.I)

# Notices and telling paragraphs of public licences, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "Released under the Creative Commons Zero license, CC0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under the Creative Commons Attribution license.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs License, for non-commercial use only.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Released under the zlib license.",
        "SPDX-License-Identifier: Zlib",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Licensed under the Boost Software License.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CDDL": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
        "Licensed under the Common Development and Distribution License, version 1.0.",
        "SPDX-License-Identifier: CDDL-1.0",
    ],
    "OFL": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "Artistic": [
        "This library is free software; you may redistribute it and/or modify it under the same terms as Perl itself, under the Artistic License.",
        "Licensed under the Artistic License 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "WTFPL": [
        "Do What The Fuck You Want To Public License, Version 2.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "SPDX-License-Identifier: WTFPL",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
# Sentences that use licence words and grant nothing.
ORDINARY = [
    "He lost his driving license on the way home and had to apply for a new one.",
    "The bar was refused a liquor license by the town council last year.",
    "Her version of the story was free of any conditions.",
    "The Apache helicopter landed in the field behind the school.",
    "Students at MIT published a paper on the use of software in schools.",
    "The general public was invited to the opening of the library.",
    "The copyright office is closed on Mondays.",
    "Please read the terms and conditions before you buy a ticket.",
    "The warranty covers parts and labour for two years.",
    "A creative work needs the common sense of its authors.",
    "The commission asked the public for comments on the new rules.",
    "All passengers have rights, and seats are reserved at the counter.",
    "Distribution of food started in the morning and went on without restriction.",
    "You may use the garden for any purpose, the owner said.",
    "The permission of the parents is needed for the trip.",
    "The source of the river lies in the hills; a binary star is above them.",
    "The foundation gave free lessons to children in the village.",
    "The library is open to any person from ten to six.",
]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def ngrams(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:]))]


class Model:
    def __init__(self, names: dict[str, int], weights: np.ndarray, bias: np.ndarray, families: list[str]):
        self.names, self.weights, self.bias, self.families = names, weights, bias, families
        self.temperature, self.least = 1.0, 0.5
        self.templates = [(f, frozenset(ngrams(words_of(t)))) for f in families[1:] for t in TEMPLATES[f]]
        # a paragraph without these can't be a family: nothing in it raises one above unknown
        gain = (weights[:, 1:] - weights[:, :1]).max(axis=1) if len(weights) else np.zeros(0)
        self.settled = bool((bias[1:] < bias[0]).all())
        self.cues = frozenset(n.split(" ")[0] for n, i in names.items() if gain[i] > 0)

    def logits(self, features: list[int]) -> np.ndarray:
        return self.bias + self.weights[features].sum(axis=0)

    def classify(self, words: list[str]) -> tuple[str, float, float]:
        """Family, its calibrated probability and the agreement with its closest template."""
        if self.settled and self.cues.isdisjoint(words):
            return UNKNOWN, 0.0, 0.0
        grams = set(ngrams(words))
        get = self.names.get
        x = self.logits([i for g in grams if (i := get(g)) is not None]) / self.temperature
        k = int(x.argmax())
        if k == 0:
            return UNKNOWN, 0.0, 0.0
        p = float(1 / np.exp(x - x[k]).sum())
        if p < self.least:
            return UNKNOWN, p, 0.0
        agreement = max((max(len(t & grams) / len(t), len(t & grams) / len(grams)) for f, t in self.templates if f == self.families[k]), default=0.0)
        return (self.families[k] if agreement >= CONFIRM else UNKNOWN), p, agreement


def _variations(rng: random.Random, text: str, noise: list[str]) -> list[str]:
    words = text.split()
    if len(words) > 12 and rng.random() < 0.4:  # a piece
        size = rng.randint(10, len(words))
        at = rng.randint(0, len(words) - size)
        words = words[at : at + size]
    words = [w for w in words if rng.random() > 0.04]
    if rng.random() < 0.3:
        words = [*rng.choice(noise).split()[: rng.randint(1, 6)], *words]
    if rng.random() < 0.3:
        words += rng.choice(noise).split()[: rng.randint(1, 6)]
    return words


def train(unknown: list[str], seed: int = 11) -> Model:
    """unknown: paragraphs without a licence.  The last fifth of the variations is held out for calibration."""
    rng = random.Random(seed)
    families = [UNKNOWN, *TEMPLATES]
    noise = ORDINARY + unknown
    rows = []  # (n-grams, label, held out)
    for k, f in enumerate(families[1:], 1):
        for t in TEMPLATES[f]:
            for n in range(VARIATIONS):
                rows.append((sorted(set(ngrams(words_of(t if n == 0 else " ".join(_variations(rng, t, noise)))))), k, n % 5 == 4))
    for n, t in enumerate(unknown + [" ".join(_variations(rng, t, noise)) for t in ORDINARY for _ in range(VARIATIONS)] + ORDINARY):
        rows.append((sorted(set(ngrams(words_of(t)))), 0, n % 5 == 4))
    rng.shuffle(rows)
    seen = Counter(g for grams, _, held in rows if not held for g in grams)
    names = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    data = [(np.array([names[g] for g in grams if g in names], dtype=np.int64), k, held) for grams, k, held in rows]
    fit = [(x, k) for x, k, held in data if not held]
    flat, at = np.concatenate([x for x, _ in fit]), np.repeat(np.arange(len(fit)), [len(x) for x, _ in fit])
    label = np.array([k for _, k in fit])
    share = np.bincount(label, minlength=len(families))
    rate = (len(label) / len(families) / share[label])[:, None] / len(label)  # families weigh alike
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    sw, sb = np.full(w.shape, 1e-8), np.full(b.shape, 1e-8)
    for _ in range(EPOCHS):
        x = np.zeros((len(fit), len(families)))
        np.add.at(x, at, w[flat])
        x += b
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(fit)), label] -= 1
        g = p * rate
        gw = PENALTY * w
        np.add.at(gw, flat, g[at])
        gb = g.sum(axis=0)
        sw += gw * gw
        sb += gb * gb
        w -= RATE * gw / np.sqrt(sw)
        b -= RATE * gb / np.sqrt(sb)
    model = Model(names, w, b, families)
    held = [(model.logits(x), k) for x, k, h in data if h]
    z, y = np.array([x for x, _ in held]), np.array([k for _, k in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    of_unknown = np.sort(p[y == 0, 1:].max(axis=1))[::-1] if (y == 0).any() else np.zeros(1)
    model.least = min(0.95, max(0.5, float(of_unknown[int(FALSE_SHARE * len(of_unknown))])))
    return model


def unknown_sample(docs: DataFrame) -> list[str]:
    """LINES lines at most of SAMPLE documents at most, in a fixed order."""
    some = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).orderBy("h", "doc_id", "t").limit(SAMPLE)
    key = F.broadcast(some.select(F.struct("doc_id", "t").alias("k")).distinct())
    line = docs.select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("k"), "text").join(key, "k").select(F.explode(F.split("text", "\n")).alias("line"))
    # long lines are shortened for training alone
    rows = line.where(F.trim("line") != "").select(F.substring("line", 1, 400).alias("line"), F.xxhash64("line").alias("h")).distinct().orderBy("h", "line").limit(LINES).collect()
    return [r.line for r in rows if not TELLING.search(r.line)]


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """(number of the first line, lines) of each paragraph."""
    out: list[tuple[int, list[str]]] = []
    goes_on = False
    for n, line in enumerate(text.split("\n")):
        if not line.split():
            goes_on = False
            continue
        if goes_on:
            out[-1][1].append(line)
        else:
            out.append((n, [line]))
        goes_on = WRAPPED[0] <= len(line.strip()) <= WRAPPED[1] and not ENDS.search(line)
    return out


def scan_text(text: str, model: Model) -> tuple[int, list[tuple[int, int, str, float, float]]]:
    """The number of paragraphs, and (first line, last line, family, probability, agreement) of each one of a known family.  A wrapped paragraph that is
    of none as a whole may hold notices in its lines: those are judged one by one."""
    every = paragraphs(text)
    if model.settled and model.cues.isdisjoint(words_of(text)):
        return len(every), []
    out = []
    for first, lines in every:
        words = [words_of(x) for x in lines]
        family, p, agreement = model.classify([w for x in words for w in x])
        if family != UNKNOWN:
            out.append((first, first + len(lines) - 1, family, p, agreement))
        elif len(lines) > 1:
            judged = [(n, n, *model.classify(x)) for n, x in enumerate(words, first)]
            out += [h for h in judged if h[2] != UNKNOWN]
    return len(every), out


def scan_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (distinct, sorted, comma-joined; empty if none) and
    hits (first line-last line:family:probability:agreement, comma-joined in order)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or train(unknown_sample(docs)))

    def run(batches):
        own = shipped.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, hits = scan_text(text, own)
                rows.append((n, len(hits), ",".join(sorted({h[2] for h in hits})), ",".join(f"{a}-{b}:{f}:{p:.3f}:{s:.3f}" for a, b, f, p, s in hits)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["doc_id", "n_paragraphs", "n_licences", "families", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_paragraphs long, n_licences long, families string, hits string")
