"""License scans: TF-IDF cosine of headers and licence files to templates, inherited down directories.

Texts are taken block by block (lines between blank ones; a licence file also as a whole). A block is
compared with a template through its windows of as many words as the template has, or all its words
if it has fewer, so that copyright lines and text beside a statement don't hide it and statements
may be broken over lines. A window's or template's vector has a component for each of its words:
count times weight. The weight is 1 + ln(1 / share), where share is that of the texts which have the
word, counted over all texts, and at least LEAST_SHARE: words of no template and words found nowhere
weigh as much as one of that share. So a verdict depends on how common words are, not on how many
texts there are.

Which texts and blocks have their windows compared is decided exactly. By Cauchy's inequality a
window that has only the words S of a template reaches at most |template restricted to S| /
|template|. So for each template the words that weigh least are set aside as long as they can't
reach the threshold by themselves; a text without any of the others can't either.

A file's own licence is its best template of cosine THRESHOLD or more. A file without one inherits
that of the licence file in its nearest ancestor directory: distinct directories are exploded to
their ancestors, joined with the directories that have a licence file, and the deepest wins.

Defined results: null and empty texts state no licence; ties go to the longer template, then
the first licence by name, then the first line; a null path has no directory and inherits nothing; rows
of one id are one file, rows of a null id one for each text; repeated rows are all returned; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, with_values

#: Short licence texts, as their authors publish them; fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
#: Statements by licence: headers, titles, SPDX lines and short texts.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": [BSD_2],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "BSD 3-Clause License", BSD_3],
    "CC-BY-4.0": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL-2.0": ["GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["ISC License", ISC],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "MIT License", MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Identifiers as SPDX lines write them, beside the licence's own name.
SPDX = {"AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"]}
for _name in TEMPLATES:
    TEMPLATES[_name] += [f"SPDX-License-Identifier: {x}" for x in [_name, *SPDX.get(_name, [])]]
THRESHOLD = 0.75
#: Words that fewer texts have weigh as if so many had them.
LEAST_SHARE = 1e-4
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
LICENCE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"


def terms(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def document_counts(files: DataFrame, words: list[str]) -> dict[str, float]:
    """Share of the files' texts that have each of the words (lower case)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, found, n = frozenset(words), Counter(), 0
        for b in batches:
            for text in b["text"]:
                found.update(wanted.intersection(terms(text)))
            n += len(b)
        yield pd.DataFrame([("", n), *found.items()], columns=["term", "n"])

    rows = files.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the templates' words
    n = {r["term"]: r["n"] for r in rows}
    return {w: n.get(w, 0) / max(n.get("", 0), 1) for w in words}


class Scanner:
    """Best template of a text, given the share of texts that have each word."""

    def __init__(self, templates: dict[str, list[str]], shares: dict[str, float], threshold: float):
        self.threshold = threshold
        self.weight = {w: 1 - float(np.log(min(1.0, max(s, LEAST_SHARE)))) for w, s in shares.items()}
        self.rare = 1 - float(np.log(LEAST_SHARE))
        self.templates, telling = [], set()
        for name in sorted(templates):
            for text in templates[name]:
                words = terms(text)
                vector = {t: c * self.weight[t] for t, c in Counter(words).items()}
                square = sum(x * x for x in vector.values())
                least = threshold * threshold * square
                light, sum_light = set(), 0.0
                for t in sorted(vector, key=lambda t: (vector[t], t)):
                    if sum_light + vector[t] ** 2 >= least * (1 - 1e-9):
                        break
                    sum_light += vector[t] ** 2
                    light.add(t)
                heavy = set(vector) - light
                telling |= heavy
                self.templates.append((name, len(words), vector, square**0.5, least, heavy))
        self.telling = frozenset(telling)

    def blocks(self, text: str, whole: bool) -> Iterator[tuple[list[str], list[int]]]:
        """Words of each block with the lines they stand in; the whole text too if it is a licence file."""
        words, lines, every, places = [], [], [], []
        for k, line in enumerate(text.split("\n")):
            own = terms(line)
            if own:
                words += own
                lines += [k] * len(own)
            if words and not line.strip():
                yield words, lines
                if whole:
                    every += words
                    places += lines
                words, lines = [], []
        if words:
            yield words, lines
        if every:
            yield [*every, *words], [*places, *lines]

    def best_window(self, words: list[str], size: int, vector: dict[str, float]) -> tuple[float, int]:
        """Highest product with vector over the norm of a window of so many words, and where it begins."""
        size = min(size, len(words))
        count: Counter = Counter()
        product = square = best = 0.0
        at = 0
        for k, t in enumerate(words):
            w = self.weight.get(t, self.rare)
            product += w * vector.get(t, 0.0)
            square += w * w * (2 * count[t] + 1)
            count[t] += 1
            if k >= size:
                t = words[k - size]
                w = self.weight.get(t, self.rare)
                product -= w * vector.get(t, 0.0)
                count[t] -= 1
                square -= w * w * (2 * count[t] + 1)
            if k + 1 >= size and product > 0 and product / square**0.5 > best + 1e-9:
                best, at = product / square**0.5, k + 1 - size
        return best, at

    def licence(self, text: str | None, whole: bool) -> tuple[str, float, int] | None:
        """(licence, cosine, line) that a text states, None for none."""
        low = (text or "").lower()
        if self.telling.isdisjoint(WORD.findall(low)):
            return None
        best: tuple[float, int, str, int] | None = None  # as ordered: least first
        for words, lines in self.blocks(low, whole):
            known = set(words)
            for name, size, vector, norm, least, heavy in self.templates:
                if not known.isdisjoint(heavy) and sum(vector[t] ** 2 for t in known.intersection(vector)) >= least * (1 - 1e-9):
                    product, at = self.best_window(words, size, vector)
                    cosine = product / norm
                    if cosine >= self.threshold:
                        found = (-round(cosine, 9), -size, name, lines[at])
                        best = found if best is None else min(best, found)
        return best and (best[2], -best[0], best[3])


def own_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, file_key, licence, cosine, line) of the files (file_id, text, is_licence) that state one; file_key is as in file_key()."""
    words = sorted({t for texts in templates.values() for x in texts for t in terms(x)})
    shares = document_counts(files, words)

    def start() -> Callable[[list], list[pa.Array]]:
        scanner = Scanner(templates, shares, threshold)

        def make(texts: list) -> list[pa.Array]:
            found = [scanner.licence(x["text"], x["whole"]) or (None, None, None) for x in texts]
            return [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.int32()), strict=True)]

        return make

    given = files.select("file_id", file_key(files).alias("file_key"), F.struct("text", F.coalesce("is_licence", F.lit(False)).alias("whole")).alias("given"))
    found = with_values(given, ["file_id", "file_key"], start, "licence string, cosine double, line int", "given").where("licence is not null")
    # Rows of one file state one licence together.
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("file_key").orderBy(F.desc("cosine"), "licence", "line")))
    return ranked.where("_n = 1").drop("_n")


def file_key(files: DataFrame) -> Column:
    """What tells files apart: their id; if that is null, their text."""
    by_id = F.col("file_id").cast("string")
    return F.coalesce(by_id, F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))) if "text" in files.columns else by_id


def licence_name(path: Column) -> Column:
    """Whether a file's name says that it holds the licence of its directory."""
    return F.coalesce(path.rlike(LICENCE_NAME), F.lit(False))


def directory(path: Column) -> Column:
    """All before the last slash; "" at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).when(path.isNotNull(), "")


def ancestors(folder: Column) -> Column:
    """The folder itself and all above it, "" last."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def inherit(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """(folder, inherited, inherited_from) of folders under licensed (folder, licence), each row distinct."""
    up = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
    met = up.join(licensed.select(F.col("folder").alias("above"), "licence"), "above")
    return met.groupBy("folder").agg(F.max_by("licence", F.length("above")).alias("inherited"), F.max_by("above", F.length("above")).alias("inherited_from"))


def scan(files: DataFrame, own: DataFrame, licensed: DataFrame) -> DataFrame:
    """files (file_id, path) with their own licence, else the inherited one."""
    placed = files.select("file_id", file_key(files).alias("file_key"), "path", directory(F.col("path")).alias("folder"))
    inherited = inherit(placed.where("folder is not null").select("folder").distinct(), licensed)
    out = placed.join(own.drop("file_id"), "file_key", "left").join(inherited, "folder", "left")
    kind = F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", F.coalesce("licence", "inherited").alias("licence"), kind.alias("basis"), "cosine", F.when(F.col("licence").isNull(), F.col("inherited_from")).alias("inherited_from"))


def licence_files(files: DataFrame, own: DataFrame) -> DataFrame:
    """(folder, licence) of licence files; files has file_id, path and is_licence. Least path wins."""
    stated = files.where("is_licence and path is not null").withColumn("file_key", file_key(files)).join(own.drop("file_id"), "file_key")
    return stated.groupBy(directory(F.col("path")).alias("folder")).agg(F.min_by("licence", "path").alias("licence"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or its directory's.

    The corpus has no paths. A document's is taken to be source/lang/d/.../name with a directory for
    each digit of doc_id over the last three. The name is LICENSE and the doc_id for documents that
    speak of a licence anywhere, else the doc_id; the former are licence files, so that the first of
    them that states one stands for its directory.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    digits = F.regexp_replace(F.floor(F.col("doc_id") / 1000).cast("string"), r"(\d)", "/$1")
    folder = F.concat(F.coalesce("source", F.lit("-")), F.lit("/"), F.coalesce("lang", F.lit("-")), F.when(F.col("doc_id") >= 1000, digits).otherwise(""))
    name = F.concat(F.when(F.col("text").rlike("(?i)licen[cs]e"), "LICENSE-").otherwise(""), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat(folder, F.lit("/"), name).alias("path"), "text")
    files = files.withColumn("is_licence", licence_name(F.col("path")))
    own = staged(own_licences(files), "licences")
    return scan(files, own, licence_files(files, own)).withColumnRenamed("file_id", "doc_id")
