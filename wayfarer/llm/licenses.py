"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance from ancestor directories.

A file's units are its sentences, its paragraphs (lines joined, comment marks left out), its leading comment and, where its name is
that of a licence file, its whole text. Units are compared with the templates by the cosine of their TF-IDF vectors (1 + ln of the
term count, times ln of the inverse share of files + 1); the best one of at least THRESHOLD names the file's licence, ties go to the
first id in order. A file without one takes the licence of the licence file in its nearest ancestor directory. Document frequencies
of the templates' words are counted over all files; other words weigh as words that no file has. Only units with an anchor word are
scored: of each template, anchors are its heaviest words, so many that the rest alone stays below THRESHOLD; no match is lost. Equal units are
scored once. Null and empty texts have no licence of their own; a null path has no ancestors; rows of one path and text
get the same result; an empty table gives an empty result. Input columns that are named like results are replaced, others pass through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of

THRESHOLD = 0.75
#: Names of licence files and, by SPDX id, statements, notices and texts of licences (of long ones their opening paragraphs).
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING", "COPYRIGHT", "LICENSE.TXT", "LICENSE.MD", "LICENCE.TXT", "LICENCE.MD", "COPYING.TXT", "COPYING.LESSER", "UNLICENSE")
TEMPLATES = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SENTENCE = r"[\n\r]+|(?<=[.!?])[ \t]+"
COMMENT = r"[ \t]*(?:#+|//+|/?\*+/?|--+|;+|<!--)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def units(text: Column, whole: Column) -> Column:
    """Sentences, paragraphs, leading comment and, if whole, all of a text."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), rf"(?m)^{COMMENT}[ \t]?", "")
    lines = F.split(text, r"\r\n?|\n")
    end = F.array_position(F.transform(lines, lambda x: x.rlike(f"^{COMMENT}")), False)  # the first line that is no comment
    header = F.when(end != 1, F.array_join(F.slice(lines, 1, F.when(end == 0, F.size(lines)).otherwise(end - 1).cast("int")), "\n"))
    found = F.concat(F.split(text, SENTENCE), F.split(plain, r"\n[ \t]*(?:\n[ \t]*)+"), F.array(header, F.when(whole, plain)))
    return F.array_distinct(F.array_compact(found))


def _vector_words(text: str) -> dict[str, float]:
    """The words of text with 1 + ln of their counts."""
    parts = re.findall(WORD, text.lower())
    return {x: 1 + math.log(parts.count(x)) for x in parts}


def _statements() -> list[tuple[str, dict[str, float]]]:
    return [(name, _vector_words(text)) for name, texts in TEMPLATES.items() for text in texts]


def frequencies(files: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Files, and how many of them have each word of the templates: one row for each such word."""
    vocabulary = sorted({x for _, s in _statements() for x in s})
    here = F.array_intersect(words(text_of(text)), F.array(*[F.lit(x) for x in vocabulary]))
    rows = files.select(here.alias("w")).select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    held = {w: n for w, n in rows}
    return held.pop("", 0), {x: held.get(x, 0) for x in vocabulary}


def _vectors(total: int, counts: dict[str, int]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    idf = {w: math.log((total + 1) / (n + 1)) + 1 for w, n in counts.items()}
    vectors = []
    for name, tf in _statements():
        raw = {w: x * idf[w] for w, x in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append((name, {w: x / norm for w, x in raw.items()}))
    return idf, math.log(total + 1) + 1, vectors


def anchors(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Words of which a sentence must have one to reach threshold with any statement."""
    found = set()
    for _, vector in vectors:
        rest = 1.0
        for word, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold * threshold * (1 - 1e-9):
                break
            found.add(word)
            rest -= weight * weight
    return sorted(found)


def score(sentences: DataFrame, total: int, counts: dict[str, int], threshold: float = THRESHOLD) -> DataFrame:
    """(unit, licence, cosine) of each different unit of sentences (unit: its digest, sentence) that matches a template; sparse dot products."""
    spark = sentences.sparkSession
    idf, rare, vectors = _vectors(total, counts)
    terms = sentences.select("unit", words(F.col("sentence")).alias("ws")).select("unit", F.explode("ws").alias("w")).groupBy("unit", "w").agg((1 + F.log(F.count("*"))).alias("tf"))
    values = ", ".join(f"('{w}', {idf[w]!r}D, array({', '.join(f"named_struct('t', {i}, 'x', {v[w]!r}D)" for i, (_, v) in enumerate(vectors) if w in v)}))" for w in idf)
    weights = spark.sql(f"SELECT * FROM VALUES {values} AS v(w, idf, held)")  # the templates' words: fixed size
    weighed = terms.join(F.broadcast(weights), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.select("unit", "x", F.explode("held").alias("h")).groupBy("unit", "h.t").agg(F.sum(F.col("x") * F.col("h.x")).alias("dot"))
    names = F.array(*[F.lit(name) for name, _ in vectors])
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norms, "unit").withColumn("cosine", cosine).where(F.col("cosine") >= threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.element_at(names, F.col("t") + 1).alias("licence")))
    return near.groupBy("unit").agg(best.alias("b")).select("unit", "b.licence", (-F.col("b.c")).alias("cosine"))


def licence_file(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r"([^/]*)$", 1)).isin(*LICENCE_FILES)


def own_licences(files: DataFrame, text: str, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep (which tell rows apart) of each file (__path, text) with a licence of its own, licence and cosine."""
    total, counts = frequencies(files, text)
    _, _, vectors = _vectors(total, counts)
    anchor = F.array(*[F.lit(x) for x in anchors(vectors, threshold)])
    has_anchor = lambda c: F.arrays_overlap(words(c), anchor)
    body = text_of(text)
    parts = F.filter(units(body, F.coalesce(licence_file(F.col("__path")), F.lit(False))), has_anchor)
    found = files.where(has_anchor(body)).select(*keep, F.explode(parts).alias("sentence")).withColumn("unit", F.md5("sentence"))
    found = materialize(found, "sentences")
    scored = materialize(score(found.groupBy("unit").agg(F.first("sentence").alias("sentence")), total, counts, threshold), "scores")
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    return found.drop("sentence").join(scored, "unit").groupBy(*keep).agg(best.alias("b")).select(*keep, "b.licence", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """files less text, with own_licence, cosine, licence and licence_from (path of the directory, null if its own).

    Input columns of these names are replaced.
    """
    named = files.drop("own_licence", "cosine", "licence", "licence_from").withColumns({"__path": F.col(path), "__hash": F.xxhash64(text_of(text))})
    own = materialize(own_licences(named, text, ["__path", "__hash"], threshold), "own").withColumnsRenamed({"__path": "o_path", "__hash": "o_hash"})
    folder = F.regexp_replace(F.col("__path"), r"/?[^/]*$", "")
    rows = named.drop(text).withColumn("__dir", folder)
    rows = rows.join(own, rows["__path"].eqNullSafe(own["o_path"]) & (rows["__hash"] == own["o_hash"]), "left").drop("o_path", "o_hash")
    rows = rows.withColumnsRenamed({"licence": "own_licence"})
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence"))
    owners = own.where(licence_file(F.col("o_path"))).withColumn("dir", F.regexp_replace("o_path", r"/?[^/]*$", "")).groupBy("dir").agg(best.alias("b"))
    owners = materialize(owners.select("dir", F.col("b.licence").alias("dir_licence")), "directories")
    # Each directory once, with its ancestors: the nearest that has a licence file.
    dirs = rows.where(F.col("__dir").isNotNull()).select("__dir").distinct()
    steps = F.split("__dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("dir")))
    up = F.concat(up, F.when(F.col("__dir") != "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("dir")))).otherwise(F.array().cast("array<struct<depth:int,dir:string>>")))
    lines = dirs.select("__dir", F.explode(up).alias("a")).select("__dir", "a.depth", "a.dir")
    near = lines.join(owners, "dir").groupBy(F.col("__dir").alias("n_dir")).agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("n"))
    near = materialize(near.select("n_dir", F.col("n.dir").alias("n_from"), F.col("n.dir_licence").alias("n_licence")), "nearest")
    out = rows.join(near, rows["__dir"] == near["n_dir"], "left")
    return out.withColumns({"licence": F.coalesce("own_licence", "n_licence"), "licence_from": F.when(F.col("own_licence").isNull(), F.col("n_from"))}).drop("__path", "__hash", "__dir", "n_dir", "n_from", "n_licence")


def made_up_path(key: Column, source: Column) -> Column:
    """A tree for rows without paths: source/hundreds/tens/doc-id; ids that 10 or 100 divide are the licence files."""
    hundreds, tens = F.floor(key / 100).cast("string"), F.floor(key / 10).cast("string")
    inner = F.concat(F.coalesce(source, F.lit("none")), F.lit("/"), hundreds, F.lit("/"))
    return F.when(key % 100 == 0, F.concat(inner, F.lit("LICENSE"))).when(key % 10 == 0, F.concat(inner, tens, F.lit("/LICENSE"))).otherwise(F.concat(inner, tens, F.lit("/doc-"), key.cast("string")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", made_up_path(F.col("doc_id"), F.col("source")).alias("path"))
    return scan(docs).select("doc_id", "path", "own_licence", "cosine", "licence", "licence_from")


QUERIES = {"op10_licenses": op10_licenses}
ORACLES: dict[str, str] = {}
