"""License scan: TF-IDF cosine of statements and licence files to templates, then
inheritance from the nearest ancestor directory.

Every sentence and every line of a whole text is compared with the templates; weights are
term counts times idf over all files (document frequencies hashed into ``DF_BUCKETS``).  A
statement names a license for its own file if its best cosine is ``THRESHOLD`` or more.  A
licence file (by its name, or because statements make up ``FILE_SHARE`` of its words)
names it for its directory.  Files without a statement take the license of the nearest
directory above them that has one: directories are joined with licensed directories over
their ancestors, files with their directory.

Only units that hold a key word are compared.  That loses nothing: for a cosine of c, the
shared words must make up c squared of the template's squared weights, and each template's
words that are no key words make up less.

Defined results: null and empty texts state nothing but may inherit; a null path stands in
no directory; of several licence files in a directory the one with the highest cosine
counts, then the smallest path; of several statements in a file likewise, then the license
name first in order; repeated rows come out once each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DF_BUCKETS = 1 << 16
THRESHOLD = 0.7
FILE_SHARE = 0.3
FILE_NAME = r"(?i)^(un)?licen[cs]e(s)?([.\-_].*)?$|^copying([.\-_].*)?$|^notice([.\-_].*)?$"

TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style "
                     "license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                     "Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
                "Released under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
}

_UNIT_END = re.compile(r"(?<=[.!?])\s+|\n")


def word_ids(text: str) -> list[int]:
    return common.words_of(pa.array([text])).hash.tolist()


class Matcher:
    """Template vectors under given document frequencies."""

    def __init__(self, df: np.ndarray, total: int, templates: dict[str, list[str]], threshold: float):
        self.idf, self.threshold = np.log((1 + total) / (1 + df)) + 1, threshold
        self.vectors = [(name, self.vector(word_ids(t))) for name, texts in sorted(templates.items()) for t in texts]
        keys: set[int] = set()
        for _, v in self.vectors:
            mass = 0.0
            for w, x in sorted(v.items(), key=lambda i: (i[1], i[0])):
                mass += x * x
                if mass >= threshold * threshold:
                    keys.add(w)
        self.keys = np.array(sorted(keys), dtype=np.uint64)

    def vector(self, words: list[int]) -> dict[int, float]:
        v = {w: n * self.idf[w % len(self.idf)] for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, unit: str) -> tuple[float, str]:
        v = self.vector(word_ids(unit))
        return min(((-sum(x * v.get(w, 0.0) for w, x in t.items()), name) for name, t in self.vectors), default=(0.0, ""))

    def statements(self, text: str) -> tuple[float, str | None, int]:
        """Best cosine, its license, and how many words stand in statements."""
        cos, name, words = 0.0, None, 0
        for line in text.split("\n"):
            parts = _UNIT_END.split(line)
            for unit in {line, *parts}:
                c, n = self.best(unit)
                if -c >= self.threshold:
                    if unit in parts:
                        words += len(word_ids(unit))
                    if (c, n) < (-cos, name or "~"):
                        cos, name = -c, n
        return cos, name, words


def _frequencies(batches):
    df, n = np.zeros(DF_BUCKETS, np.int64), 0
    for batch in batches:
        texts = batch.column("text")
        for a, b in common.chunks(texts):
            w = common.words_of(texts.slice(a, b - a))
            key = np.unique(w.row() * DF_BUCKETS + (w.hash % np.uint64(DF_BUCKETS)).astype(np.int64))
            df += np.bincount(key % DF_BUCKETS, minlength=DF_BUCKETS)
        n += len(texts)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(np.arange(DF_BUCKETS), -1).astype(np.int32)),
                                      "n": pa.array(np.append(df, n))})


def statements(files: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """``files`` with ``_cos``, ``_name``, ``_share`` (of its words that stand in statements)."""
    freq = files.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    df, total = np.zeros(DF_BUCKETS), 0
    for bucket, n in freq:
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    matcher = Matcher(df, total, templates, threshold)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            cos, name, share = np.zeros(len(texts)), [None] * len(texts), np.zeros(len(texts))
            for a, b in common.chunks(texts):
                w = common.words_of(texts.slice(a, b - a))
                at = np.minimum(np.searchsorted(matcher.keys, w.hash), max(0, len(matcher.keys) - 1))
                hit = matcher.keys[at] == w.hash if len(matcher.keys) else np.zeros(len(w.hash), bool)
                for i in np.unique(w.row()[hit]).tolist():
                    cos[a + i], name[a + i], words = matcher.statements(texts[a + i].as_py())
                    share[a + i] = words / max(1, w.ptr[i + 1] - w.ptr[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(cos), pa.array(name, pa.string()), pa.array(share)],
                names=[*batch.schema.names[:-1], "_cos", "_name", "_share"])
    keys = files.drop("text").columns
    rows = files.select(F.struct(*map(common.col, keys)).alias("row"), "text")
    return rows.mapInArrow(run, rows.drop("text").schema.add("_cos", "double").add("_name", "string").add("_share", "double")) \
        .select("row.*", "_cos", "_name", "_share")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (``path``, ``text`` and any other columns but ``license``, ``how``, ``cosine`` and
    ``directory``) without ``text``, with ``license``, ``how`` (statement, licence file, inherited or
    null), ``cosine`` of the own statement, ``directory`` that it was inherited from."""
    names = [c for c in files.columns if c not in ("text", "license", "how", "cosine", "directory")]
    base = F.element_at(F.split("path", "/"), -1)
    # "a/b/c.txt" stands in "a/b", "c.txt" in "" (the root)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    found = common.checkpointed(statements(files.select(*map(common.col, names), "text"), templates, threshold)
                                .withColumn("_dir", folder)
                                .withColumn("_file", F.col("_name").isNotNull() & (base.rlike(FILE_NAME) | (F.col("_share") >= FILE_SHARE))))
    licensed = found.where("_file and _dir is not null").groupBy("_dir").agg(
        F.min(F.struct((-F.col("_cos")).alias("c"), "path", "_name")).alias("best")) \
        .select(F.col("_dir").alias("directory"), F.col("best._name").alias("_inherited"))
    dirs = found.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    up = dirs.select("_dir", F.posexplode(F.array_distinct(above)).alias("_depth", "directory"))
    nearest = up.join(licensed, "directory").groupBy("_dir").agg(
        F.max(F.struct("_depth", "directory", "_inherited")).alias("near"))
    out = found.join(nearest, "_dir", "left")
    own, near = F.col("_name"), F.col("near._inherited")
    return out.select(
        *map(common.col, names), F.coalesce(own, near).alias("license"),
        F.when(F.col("_file"), "licence file").when(own.isNotNull(), "statement").when(near.isNotNull(), "inherited").alias("how"),
        F.when(own.isNotNull(), F.round("_cos", 6)).alias("cosine"),
        F.when(own.isNull(), F.col("near.directory")).alias("directory"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: the table has no paths, so the source is the top directory and
    the digits of the id, by two, are the rest (9826 of src6: ``src6/98/26``)."""
    digits = F.regexp_replace(F.col("doc_id").cast("string"), "(..)(?=.)", "$1/")
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), digits).alias("path"), "text")


def op2(spark, sf_dir: str) -> DataFrame:
    return scan(document_files(common.documents(spark, sf_dir)))
