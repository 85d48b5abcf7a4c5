"""Licence scans with a trained paragraph classifier.

Features are the word 1- and 2-grams of a paragraph (a line) that occur in a licence notice; a multinomial logistic
regression over them tells the families and an *unknown* class apart. It is trained here: positives are notices
with words left out and with ordinary text around them, negatives are ordinary paragraphs (a bounded
sample of the corpus, without the ones that speak of licences) and mixtures of notice words. A temperature,
fitted on held-out examples, calibrates the probabilities, and the least probability that keeps 99 %
precision there is the bar below which a paragraph is unknown. A prediction stands only if the
comparison with the family's templates confirms it: enough of one notice's 2-grams occur in the paragraph.

Notices wrapped over several lines are met whole: besides each line, every run of consecutive non-blank lines
that could hold one notice is judged. Of claims on the same lines the best match stands, then the shortest.

Scanning reads whole texts; only n-grams of the model are looked at further, so the work is sparse.

Defined results: null or empty text has no paragraphs and no licence; blank lines are no paragraphs;
repeated rows are scanned each; ties go to the family first by name; input columns named like the
result's are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches, table

#: The usual short notices of each family.
NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Released under the BSD 3-Clause License", "licensed under the BSD 2-Clause license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "the author has dedicated this work to the public domain by waiving all rights under the CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "SPDX-License-Identifier: ISC"],
    "LGPL": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under The Unlicense", "SPDX-License-Identifier: Unlicense"],
}
FAMILIES = sorted(NOTICES)
COLUMNS = ("n_paragraphs", "n_licence", "families", "confidence", "notices")
_FOUND = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("match", T.DoubleType())]))


@dataclass
class Model:
    keys: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # (n-grams + bias, families + unknown)
    temperature: float
    bar: float
    templates: list[list[np.ndarray]]  # 2-gram hashes of each family's notices
    accuracy: float  # on held-out examples


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Hashes of the 1- and 2-grams of texts, and the text of each."""
    w = K.words(pa.array(texts, pa.string()), K.ALNUM, lower=True)
    at = K.whole_grams(w, 2)
    two = K.gram_hashes(w.hash, 2)[at] if len(at) else np.zeros(0, np.uint64)
    return np.concatenate([w.hash, two]), np.concatenate([w.doc, w.doc[at]]), w


def bigrams(text: str) -> np.ndarray:
    w = K.words(pa.array([text]), K.ALNUM, lower=True)
    return np.unique(K.gram_hashes(w.hash, 2))


def train(ordinary: list[str], copies: int = 60, seed: int = 11) -> Model:
    """Fit on the notices and a sample of ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    ordinary = [t for t in ordinary if t.strip() and "licen" not in t.lower()] or ["an ordinary line of text"]
    pool = np.array([w for t in ordinary for w in t.split()], object)
    texts, labels = [], []
    vary = lambda n, least: list(pool[rng.integers(0, len(pool), rng.integers(least, n))])
    for y, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            seq = notice.split()
            for c in range(copies):
                kept = [w for w in seq if rng.random() > 0.08] if c and len(seq) > 6 else seq
                texts.append(" ".join(vary(12, 0) + kept + vary(12, 0) if c % 3 else kept))
                labels.append(y)
    terms = [w for ns in NOTICES.values() for n in ns for w in n.split()]
    for _ in range(copies * len(FAMILIES)):
        texts.append(" ".join(rng.permutation(list(rng.choice(terms, rng.integers(1, 7))) + vary(25, 0))))
        labels.append(len(FAMILIES))
    texts += ordinary
    labels += [len(FAMILIES)] * len(ordinary)
    keys = np.unique(grams([n for ns in NOTICES.values() for n in ns])[0])
    h, doc, _ = grams(texts)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    on = keys[at] == h
    x = np.zeros((len(texts), len(keys) + 1), np.float32)
    x[doc[on], at[on]] = 1
    x[:, -1] = 1
    y = np.array(labels)
    test = rng.random(len(y)) < 0.2
    w = np.zeros((x.shape[1], len(FAMILIES) + 1), np.float32)
    one = np.eye(len(FAMILIES) + 1, dtype=np.float32)[y]
    fit = np.flatnonzero(~test)
    step = np.zeros_like(w)
    for _ in range(30):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            g = x[part].T @ (softmax(x[part] @ w) - one[part]) / len(part) + 1e-4 * w
            step = 0.9 * step - 0.5 * g
            w += step
    z, truth = x[test] @ w, y[test]
    nll = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 4, 33), key=nll))
    p = softmax(z / temperature)
    best = p.argmax(1)
    claimed = best < len(FAMILIES)
    bars = [b for b in np.arange(0.5, 1.0, 0.01) if (best == truth)[claimed & (p.max(1) >= b)].mean() >= 0.99] if claimed.any() else []
    return Model(keys, w, temperature, float(bars[0]) if bars else 0.99, [[bigrams(n) for n in NOTICES[f]] for f in FAMILIES], float((best == truth).mean()))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def spans(doc: np.ndarray, line: np.ndarray, begin: np.ndarray, finish: np.ndarray, hit: np.ndarray, wide: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line (indexes) of what is judged: each line, and each run of consecutive lines that could hold one notice.

    Line i has the words begin[i] to finish[i]; hit tells which 2-grams occur in a notice. In a run they begin in the first
    line and end in the last, ``least`` or more of them, and the lines between hold at most ``wide`` words."""
    n = len(begin)
    first, last = [np.arange(n)], [np.arange(n)]
    hits = np.concatenate([[0], np.cumsum(hit), [hit.sum()] if n else []]).astype(np.int64)  # one for each word, and an end
    joined = np.append((doc[1:] == doc[:-1]) & (line[1:] == line[:-1] + 1), False)[:n]  # with the next line
    i = np.flatnonzero(joined & (hits[finish] > hits[begin]))
    j = i + 1
    while len(i):
        ends = hits[finish[j] - 1] > hits[begin[j] - 1]
        good = ends & (hits[finish[j] - 1] - hits[begin[i]] >= least)
        first.append(i[good])
        last.append(j[good])
        on = joined[j] & (finish[j] - finish[i] <= wide)
        i, j = i[on], j[on] + 1
    return np.concatenate(first), np.concatenate(last)


def _scan(model, text_col: str, confirm: float, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        table_ = np.zeros(1 << 16, bool)
        table_[(m.keys >> np.uint64(48)).astype(np.int64)] = True
        sizes = [len(t) for ts in m.templates for t in ts]
        # the most words of a notice, and the fewest 2-grams that confirm one
        wide, least = max(len(K.words(pa.array([n]), K.ALNUM).doc) for ns in NOTICES.values() for n in ns), max(1, math.ceil(confirm * min(sizes)))

        def feature(h: np.ndarray) -> np.ndarray:
            """Number of each n-gram in the model, or -1."""
            out = np.full(len(h), -1, np.int64)
            keep = np.flatnonzero(table_[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(m.keys, h[keep]), len(m.keys) - 1)
            on = m.keys[at] == h[keep]
            out[keep[on]] = at[on]
            return out

        for whole in batches:
            for batch in K.slices(whole, text_col):
                texts = batch.column(text_col)
                w = K.words(texts, K.ALNUM, lower=True)
                _, offsets = K.text_buffer(texts)
                breaks = np.flatnonzero(w.data == 10)
                line = np.searchsorted(breaks, w.start) - np.searchsorted(breaks, offsets[:-1])[w.doc]
                new = np.append(True, (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1]))[: len(line)]
                para = np.cumsum(new) - 1
                begin = np.flatnonzero(new)
                finish = np.append(begin[1:], len(para))[: len(begin)]
                two = K.gram_hashes(w.hash, 2)
                one_, two_ = feature(w.hash), feature(two)
                first, last = spans(w.doc[begin], line[begin], begin, finish, two_ >= 0, wide, least)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                a, b = begin[first], finish[last]
                owner, at = [], []
                for ids, end in ((one_, b), (two_, b - 1)):
                    known = np.flatnonzero(ids >= 0)
                    x, y = np.searchsorted(known, a), np.searchsorted(known, end)
                    width = np.maximum(y - x, 0)
                    owner.append(np.repeat(np.arange(len(first)), width))
                    at.append(ids[known[np.arange(int(width.sum())) + np.repeat(x - (np.cumsum(width) - width), width)]])
                pair = np.unique(np.concatenate(owner) * len(m.keys) + np.concatenate(at))
                if len(pair):
                    some, inverse = np.unique(pair // len(m.keys), return_inverse=True)
                    z = np.zeros((len(some), m.weights.shape[1]), np.float32)
                    np.add.at(z, inverse, m.weights[pair % len(m.keys)])
                    p = softmax((z + m.weights[-1]) / m.temperature)
                    best = p.argmax(1)
                    sure = np.flatnonzero((best < len(FAMILIES)) & (p.max(1) >= m.bar))
                    claims = []
                    for i in sure.tolist():
                        k = int(some[i])
                        own = np.unique(two[a[k] : b[k] - 1])
                        match = max(float(np.isin(t, own).mean()) for t in m.templates[best[i]])
                        if match >= confirm:
                            claims.append((-match, int(last[k] - first[k]), int(first[k]), i))
                    taken: dict[int, set[int]] = {}
                    for lost, more, k, i in sorted(claims):
                        shared = [j for j in range(k, k + more + 1) if j in taken]
                        # notices of two families may meet in a line
                        if shared and not (more and shared in ([k], [k + more]) and best[i] not in taken[shared[0]]):
                            continue
                        for j in range(k, k + more + 1):
                            taken.setdefault(j, set()).add(int(best[i]))
                        found[int(w.doc[begin[k]])].append({"line": int(line[begin[k]]), "family": FAMILIES[best[i]], "probability": float(p[i, best[i]]), "match": -lost})
                    for x in found:
                        x.sort(key=lambda n: (n["line"], n["family"]))
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns |= {"n_paragraphs": pa.array(np.bincount(w.doc[begin], minlength=batch.num_rows)), "notices": pa.array(found, out.field("notices").type)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return run


def sample_paragraphs(docs: DataFrame, text_col: str = "text", texts: int = 300, paragraphs: int = 3000) -> list[str]:
    """At most ``paragraphs`` lines of about ``texts`` documents, chosen by a hash of the text."""
    n = docs.count()
    share = min(1.0, texts / max(1, n))
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    lines = some.select(F.explode(F.split(text_col, "\n")).alias("t")).where("trim(t) != ''")
    return sorted(r.t for r in lines.orderBy(F.xxhash64("t"), "t").limit(paragraphs).collect())


def scan_licences(docs: DataFrame, model: Model | None = None, text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """Every row of docs with n_paragraphs, n_licence (lines, or runs of lines, with a confirmed licence), families,
    confidence (the greatest probability, null if none) and notices (line, family, probability, match)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*COLUMNS)
    model = model or train(sample_paragraphs(docs, text_col))
    schema = T.StructType([*docs.schema, T.StructField("n_paragraphs", T.LongType()), T.StructField("notices", _FOUND)])
    small_batches(docs.sparkSession)
    found = docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(model), text_col, confirm, to_arrow_schema(schema)), schema)
    return found.select(*docs.columns, "n_paragraphs", F.size("notices").cast("long").alias("n_licence"), F.array_sort(F.array_distinct("notices.family")).alias("families"), F.array_max("notices.probability").alias("confidence"), "notices")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_paragraphs", "n_licence", F.concat_ws(",", "families").alias("families"), F.round("confidence", 4).alias("confidence"))
