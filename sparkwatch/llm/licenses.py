"""Licence scan: sparse TF-IDF cosine of statements to templates, then inheritance from the nearest ancestor folder.

Spark functions alone. A file's statements are its lines, its sentences and its paragraphs (lines joined, comment marks
taken off, so wrapped headers are whole again), and the text as a whole; each is a TF-IDF vector, compared with templates
of licence notices, file headers and full texts. Document counts come from all files, those of the templates' words for the
prefilter and those of the other words of the statements that it leaves. Each licence that an SPDX tag names is a statement
too, whose template is that tag alone and must be met in full. A statement can only reach the threshold with a template if the words
that both hold make up enough of the template's vector. So files are left out that hold too few of every template's rarer
words, even if all its common ones are granted; only the statements of the others are split into words, each once however
many files make it. A file's licence is its best statement's; a file without one takes that of
the licence file in the nearest folder above it, found by joining folders with their ancestors.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, table

# Notices, file headers and full texts of licences, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


def _gnu(name: str, version: str) -> list[str]:
    text = _GNU.format(name=name, version=version)
    return [f"This work is licensed under the GNU {name}, version {version}.", text.split("\n\n")[0], text]


TEMPLATES = {
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", _BSD + _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_END],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0 Universal)."],
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": [*_gnu("General Public License", "3"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", _MIT.split("\n\n")[0], _MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; altered source versions must be plainly marked as such; this notice may not be removed or altered from any source distribution."""],
}
#: The number of the template that is a licence's SPDX tag, and how near a statement must be to it: the same words.
TAG, SAME = -1, 1 - 1e-6
#: Tasks that share a hot folder or path where a side is too large to be broadcast.
SALTS = 32


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _template_words() -> list[tuple[str, int, dict[str, int]]]:
    import re

    out = []
    for name, texts in TEMPLATES.items():
        for i, text in [(TAG, f"SPDX-License-Identifier: {name}"), *enumerate(texts)]:
            counts: dict[str, int] = {}
            for w in re.findall(r"[^\W_]+", text.lower()):
                counts[w] = counts.get(w, 0) + 1
            out.append((name, i, counts))
    return out


def _tags(text: Column) -> Column:
    """A tag for each id of each SPDX expression (ids joined by AND, OR and WITH, bracketed or not), without `+`, `-only` and `-or-later`."""
    one = r"\(*[A-Za-z0-9.+-]+\)*"
    expressions = F.regexp_extract_all(text, F.lit(rf"(?i)SPDX-License-Identifier:[ \t]*({one}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{one})*)"), F.lit(1))
    ids = F.flatten(F.transform(expressions, lambda e: F.regexp_extract_all(e, F.lit(r"([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)"), F.lit(1))))
    return F.transform(ids, lambda i: F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_replace(i, "(?i)-(?:only|or-later)$", "")))


def _statements(text: Column) -> Column:
    """Lines, paragraphs, their sentences, the whole text and its SPDX tags, each once."""
    marks = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|\*+|#+|;+|--+|%+|<!--+)?[ \t]*"
    paragraphs = F.split(F.regexp_replace(text, marks, ""), r"\n[ \t\r]*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?;])\s+")))
    return F.array_distinct(F.concat(F.split(text, "\n"), paragraphs, sentences, F.array(text), _tags(text)))


def weights(n: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[str, str, int, float]]]:
    """Inverse document frequencies of the templates' words, log((n + 1) / (files + 1)) + 1, and the templates' unit vectors."""
    templates = _template_words()
    idf = {w: log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in sorted({w for _, _, c in templates for w in c})}
    rows = []
    for name, i, counts in templates:
        norm = sqrt(sum((c * idf[w]) ** 2 for w, c in counts.items()))
        rows += [(w, name, i, c * idf[w] / norm) for w, c in counts.items()]
    return idf, rows


def _granted(rows: list[tuple[str, str, int, float]], df: dict[str, int], most: float) -> dict[tuple[str, int], tuple[float, set[str]]]:
    """Words that are taken as held by all files: the most frequent ones, as far as they make up no more than `most` of any template's squared vector. By template, their part and the words."""
    of: dict[str, list[tuple[tuple[str, int], float]]] = {}
    out: dict[tuple[str, int], tuple[float, set[str]]] = {(name, i): (0.0, set()) for _, name, i, _ in rows}
    for w, name, i, x in rows:
        of.setdefault(w, []).append(((name, i), x * x))
    for w in sorted(of, key=lambda w: (-df.get(w, 0), w)):
        if all(out[t][0] + part <= most for t, part in of[w]):
            for t, part in of[w]:
                out[t] = (out[t][0] + part, out[t][1] | {w})
    return out


def _least(template: int, threshold: float) -> float:
    return max(threshold, SAME) if template == TAG else threshold


def _candidates(held: DataFrame, rows: list[tuple[str, str, int, float]], granted: dict[tuple[str, int], tuple[float, set[str]]], threshold: float) -> DataFrame:
    """file of those whose words (held) could make up enough of some template's squared vector, if the granted words are there."""
    rare = [(w, name, i, x * x, granted[name, i][0], _least(i, threshold) ** 2) for w, name, i, x in rows if w not in granted[name, i][1]]
    rare = held.sparkSession.createDataFrame(rare, "w string, license string, template int, part double, granted double, least double")
    met = held.select("file", F.explode(F.array_distinct("w")).alias("w")).join(F.broadcast(rare), "w")  # broadcast: the templates' words
    return met.groupBy("file", "license", "template").agg((F.sum("part") + F.max("granted")).alias("most"), F.max("least").alias("least")).filter(F.col("most") >= F.col("least") - 1e-9).select("file").distinct()


def statement_licenses(files: DataFrame, threshold: float = 0.75, grant: float = 0.25) -> DataFrame:
    """file (its key), said (a hash of the statement), license, template, score: the best template of each statement that reaches the threshold.

    files has file and text; null texts have no statements. Ties go to the first name. `grant` (below threshold^2) is how
    much of a template its most frequent words may make up without being looked for, and changes no result.
    """
    spark = files.sparkSession
    known = F.array(*map(F.lit, sorted({w for _, _, c in _template_words() for w in c})))
    held = materialize(files.select("file", F.array_intersect(_words(F.col("text")), known).alias("w")), "held")
    n = files.count()
    df = {r["w"]: r["count"] for r in held.select(F.explode("w").alias("w")).groupBy("w").count().collect()}  # at most the templates' words
    _, rows = weights(n, df)
    granted = _granted(rows, df, grant)
    candidates = materialize(_candidates(held, rows, granted, threshold), "candidates")
    weighted = spark.createDataFrame([(*r, _least(r[2], threshold)) for r in rows], "w string, license string, template int, weight double, least double")
    telling = F.array(*map(F.lit, sorted({w for w, name, i, _ in rows if w not in granted[name, i][1]})))
    units = files.join(small(candidates, candidates.count()), "file", "left_semi").select("file", F.explode(_statements(F.col("text"))).alias("text"))
    units = materialize(units.filter(F.arrays_overlap(_words(F.col("text")), telling)).withColumn("said", F.xxhash64("text")), "statements")
    words = units.groupBy("said").agg(F.min("text").alias("text")).select("said", F.explode(_words(F.col("text"))).alias("w"))
    tf = materialize(words.groupBy("said", "w").agg(F.count("*").alias("tf")), "terms")
    counts = materialize(_counts(files, materialize(tf.select("w").distinct(), "vocabulary")), "counts")
    inverse = counts.select("w", (F.log((F.lit(float(n)) + 1) / (F.col("files") + 1)) + 1).alias("idf"))
    vector = tf.join(small(inverse, counts.count()), "w").withColumn("x", F.col("tf") * F.col("idf"))
    norms = vector.groupBy("said").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vector.join(F.broadcast(weighted), "w").groupBy("said", "license", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.max("least").alias("least"))  # broadcast: the templates' words
    scored = dots.join(norms, "said").select("said", "license", "template", "least", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).filter(F.col("score") >= F.col("least"))
    best = F.min_by(F.struct("license", "template", "score"), F.struct(-F.col("score"), "license", "template"))
    found = materialize(scored.groupBy("said").agg(best.alias("b")).select("said", "b.*"), "scored")
    return units.select("file", "said").join(small(found, found.count()), "said").select("file", "said", "license", "template", "score")


def _counts(files: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """w and files, the number of files that hold it, for the words of a vocabulary: looked up before words are counted where it is small enough, after that (a row a word) beyond."""
    held = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
    if vocabulary.count() <= BROADCAST_ROWS:
        return held.join(F.broadcast(vocabulary), "w", "left_semi").groupBy("w").agg(F.count("*").alias("files"))
    return held.groupBy("w").agg(F.count("*").alias("files")).join(vocabulary, "w", "left_semi")


def _lookup(rows: DataFrame, found: DataFrame, on: str, spread: str, how: str, most: int) -> DataFrame:
    """rows joined with found, which holds each `on` once and is broadcast up to `most` rows. Beyond that found goes to all of `SALTS` places and rows to one of them by `spread`, so that a hot (or null) key is shared by many tasks."""
    if found.count() <= most:
        return rows.join(F.broadcast(found), on, how)
    salted = found.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"], how).drop("salt")


def scan(files: DataFrame, threshold: float = 0.75, most: int = 1_000_000) -> DataFrame:
    """file, path, license, score, found (own, inherited or none), from_dir of each row of files (file, path, text).

    A licence file is one named LICENSE, LICENCE or COPYING, with or without a suffix. Its folder's licence is that of its
    best statement (ties: the first name). A null path has no folder; rows that repeat each get a row; an empty table none.
    Null and empty texts say nothing; very long lines and texts are statements as all others are.
    SPDX tags name a licence of the templates or none; of several (MIT OR Apache-2.0) the first name is taken.
    """
    own = materialize(statement_licenses(files.select("file", "text"), threshold).groupBy("file").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license")).alias("o")).select("file", "o.*"), "own")
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    paths = files.select("file", "path", folder.alias("dir"))
    named = paths.filter(name.rlike(r"^(?i:LICENSE|LICENCE|COPYING)(?:\.|$)"))
    at = named.join(own, "file").groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))
    dirs = paths.select("dir").filter("dir is not null").distinct()
    depth = F.size(F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, i), "/").alias("up")))).alias("a")).select("dir", "a.*")
    at = materialize(at.withColumnRenamed("dir", "up"), "folders")
    near = _lookup(above, at, "up", "dir", "inner", most).groupBy("dir").agg(F.max_by(F.struct("up", "license"), "depth").alias("n")).select("dir", F.col("n.up").alias("from_dir"), F.col("n.license").alias("near"))
    near = materialize(near, "near")
    out = _lookup(_lookup(paths, own, "file", "path", "left", most), near, "dir", "file", "left", most)
    found = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("file", "path", F.coalesce("license", "near").alias("license"), "score", found.alias("found"), F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files in folders of a thousand, of fifty and by source; the first document of a folder of a thousand or of fifty is its LICENSE."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    k, f = F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 50).cast("string")
    own = F.concat_ws("/", k, f, F.coalesce("source", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", k, F.lit("LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat_ws("/", k, f, F.lit("LICENSE"))).otherwise(own)
    return docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")
