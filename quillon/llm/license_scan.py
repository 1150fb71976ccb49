"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

In files that speak of a licence, the lines that do, the blocks that do (lines up to a blank one, joined, so that a
wrapped header is seen whole) and the file as a whole are compared with the templates by cosine of TF-IDF vectors;
the dot product is a join on terms with the small, fixed template table. A file whose matching part holds most of
its words is a licence file and speaks for its directory. A file without a
licence of its own takes that of its nearest ancestor directory, found by a join on ancestor paths.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices, titles and texts by SPDX id, as the licences word them; copyright lines are left out.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": [
        "BSD 2-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "BSD 3-Clause License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "CC0 1.0 Universal"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
}
#: Lines that are compared, the least cosine of a match, and the share of words that makes a licence file.
TRIGGER = "licen[sc]|copyright|spdx|public domain|permission|\\bcc0?\\b"
MIN_COSINE, FILE_SHARE = 0.8, 0.5


def templates_of() -> list[tuple[str, str]]:
    """(license, text) of every template, with an SPDX tag for each license."""
    return [(k, text) for k, texts in TEMPLATES.items() for text in (*texts, f"SPDX-License-Identifier: {k}")]


def template_rows() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(license, template, term, unit weight) of the templates, idf by term, and the idf of a term that none has."""
    tf = [(k, Counter(terms_of(v))) for k, v in templates_of()]
    df = Counter(t for _, c in tf for t in c)
    idf = {t: math.log((1 + len(tf)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, (k, c) in enumerate(tf):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, i, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(tf)) + 1


def terms_of(text: str) -> list[str]:
    return [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(" ") if t]


def scan(files: DataFrame, trigger: str = TRIGGER, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """Rows (id, repo, path, own_license, own_score, license, origin, from_dir) of files (id, repo, path, text).

    own_license is the best match of the file's licence lines, its blocks and itself (the cosine first, then the id in the alphabet);
    license is that, or of the nearest directory above that has a licence file (the best match among several);
    origin says `own`, `inherited` or `none`. Null and empty texts have none of their own; a null repo or path
    inherits nothing. Repeated rows each get a row; directories count equal licence files once.
    """
    spark = files.sparkSession
    rows, idf, far = template_rows()
    templates = F.broadcast(spark.createDataFrame(rows, "license string, template int, term string, w double"))  # fixed size
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    base = files.select("id", "repo", "path", F.coalesce("text", F.lit("")).alias("text"))
    # Null flags: the hash leaves nulls out, so a null repo and a null path would look alike.
    base = base.withColumn("key", F.xxhash64("id", F.col("repo").isNull(), "repo", F.col("path").isNull(), "path", "text"))
    base = base.withColumn("hit", F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(trigger)))
    base = base.withColumn("n_words", F.when(F.size("hit") > 0, F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))))
    tokens = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")
    blocks = F.filter(F.split("text", "\\n[ \\t]*\\n"), lambda x: F.lower(x).rlike(trigger))
    lines = base.where(F.size("hit") > 0).dropDuplicates(["key"])
    lines = lines.select("key", "n_words", F.posexplode(F.array_distinct(F.concat("hit", blocks, F.array("text")))).alias("pos", "line"))
    # Counted before the terms are dealt out: beside explode() it would be counted again for every term.
    lines = lines.withColumn("line_words", F.size(F.split(F.trim("line"), "\\s+")))
    terms = lines.select("key", "n_words", "pos", "line_words", F.explode(tokens(F.col("line"))).alias("term"))
    tf = terms.groupBy("key", "n_words", "pos", "line_words", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(weights, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(far)))
    norms = tf.groupBy("key", "pos").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.join(templates, "term").groupBy("key", "n_words", "pos", "line_words", "license", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosines = dots.join(norms, ["key", "pos"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= min_cosine)
    own = cosines.groupBy("key").agg(
        F.max_by("license", F.struct("score", _reverse(F.col("license")))).alias("own_license"), F.max("score").alias("own_score"),
        (F.max("line_words") >= file_share * F.max("n_words")).alias("speaks"),
    )
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    found = base.drop("text", "hit", "n_words").join(own, "key", "left").withColumn("dir", parent)
    declared = found.where("speaks and repo is not null and path is not null").groupBy("repo", "dir").agg(
        F.max_by("own_license", F.struct("own_score", _reverse(F.col("own_license")))).alias("dir_license")
    )
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("up")))
    bare = found.where("own_license is null and repo is not null and path is not null").select("key", "repo", "dir").distinct()
    climbing = bare.select("key", "repo", F.explode(F.array_distinct(F.transform(ups, lambda u: u["up"]))).alias("up"))
    near = climbing.join(declared.withColumnRenamed("dir", "up"), ["repo", "up"])
    near = near.groupBy("key").agg(F.max_by(F.struct("dir_license", "up"), F.length("up")).alias("n"))
    out = found.join(near, "key", "left")
    return out.select(
        "id", "repo", "path", "own_license", "own_score", F.coalesce("own_license", "n.dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"), F.col("n.up").alias("from_dir"),
    )


def _reverse(name: Column) -> Column:
    """Orders names backwards, so that a maximum takes the first in the alphabet."""
    return F.transform(F.split(name, ""), lambda c: -F.ascii(c))


def files_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as files of a source tree: the source is the repository, ids deal them into nested directories."""
    n = F.col("doc_id").cast("long")
    path = F.concat(F.lit("d"), F.floor(n / 1000).cast("string"), F.lit("/s"), F.floor(n / 100).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), path.alias("path"), "text")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(files_of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(F.col("id").alias("doc_id"), "repo", "path", "own_license", "own_score", "license", "origin", "from_dir")


def op8_sql() -> str:
    """The same in SQL, with the template table spelled out."""
    rows, idf, far = template_rows()
    templates = ", ".join(f"('{k}', {i}, '{t}', {w!r}::DOUBLE)" for k, i, t, w in rows)
    weights = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(idf.items()))
    trigger = TRIGGER.replace("'", "''")
    return rf"""
WITH t(license, tpl, term, w) AS (VALUES {templates}), i(term, idf) AS (VALUES {weights}),
f AS (SELECT doc_id, source AS repo, coalesce(text, '') AS text,
             'd' || (doc_id // 1000) || '/s' || (doc_id // 100) || '/f' || doc_id || '.txt' AS path, 'd' || (doc_id // 1000) || '/s' || (doc_id // 100) AS dir FROM documents),
h AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words,
             unnest(list_distinct(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{trigger}')), list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_matches(lower(x), '{trigger}')), [text]))) AS line
      FROM f WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{trigger}'))) > 0),
k AS (SELECT doc_id, n_words, line, len(regexp_split_to_array(trim(line), '\s+')) AS line_words, unnest(list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM h),
tf AS (SELECT doc_id, n_words, line, line_words, k.term, count(*) * coalesce(any_value(idf), {far!r}) AS x FROM k LEFT JOIN i ON k.term = i.term GROUP BY ALL),
nm AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM tf GROUP BY ALL),
ds AS (SELECT doc_id, n_words, line, line_words, license, tpl, sum(x * w) AS dot FROM tf JOIN t ON tf.term = t.term GROUP BY ALL),
c AS (SELECT ds.doc_id, n_words, line_words, license, round(dot / norm, 6) AS score FROM ds JOIN nm ON ds.doc_id = nm.doc_id AND ds.line = nm.line WHERE round(dot / norm, 6) >= {MIN_COSINE}),
own AS (SELECT doc_id, first(license ORDER BY score DESC, license) AS own_license, max(score) AS own_score, max(line_words) >= {FILE_SHARE} * max(n_words) AS speaks FROM c GROUP BY doc_id),
g AS (SELECT f.doc_id, repo, path, dir, own_license, own_score, coalesce(speaks, false) AS speaks FROM f LEFT JOIN own ON f.doc_id = own.doc_id),
dl AS (SELECT repo, dir, first(own_license ORDER BY own_score DESC, own_license) AS lic FROM g WHERE speaks AND repo IS NOT NULL GROUP BY repo, dir),
up AS (SELECT doc_id, repo, unnest(['', string_split(dir, '/')[1], dir]) AS u FROM g WHERE own_license IS NULL),
nr AS (SELECT doc_id, first(lic ORDER BY length(u) DESC) AS lic, first(u ORDER BY length(u) DESC) AS from_dir FROM up JOIN dl ON up.repo = dl.repo AND up.u = dl.dir GROUP BY doc_id)
SELECT g.doc_id, repo, path, own_license, own_score, coalesce(own_license, lic) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN lic IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, from_dir
FROM g LEFT JOIN nr ON g.doc_id = nr.doc_id
"""
