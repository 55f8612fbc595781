"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.components import cut_lineage, few

#: Notices and full texts by license, without names and years. Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
]
SIMILARITY = 0.8
#: A file is a licence file when the matching pieces hold this share of its words.
FILE_SHARE = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, str, dict[str, int]]]:
    """(name, license, words with counts) of each template, worked out once on the driver: templates are a parameter."""
    out = []
    for i, (license_id, text) in enumerate(templates):
        counts: dict[str, int] = {}
        for w in re.findall("[a-z0-9]+", text.lower()):
            counts[w] = counts.get(w, 0) + 1
        out.append((f"{i}", license_id, counts))
    return out


def needles(templates: list[tuple[str, str, dict[str, int]]], idf: dict[str, float], t: float) -> list[str]:
    """Words of which a piece of cosine t must hold at least one.

    Of each template the heaviest words, until the rest alone is shorter than t of
    the template: a piece that shares only words of the rest has a cosine below t.
    """
    out = set()
    for _, _, counts in templates:
        weights = sorted(((n * idf[w]) ** 2, w) for w, n in counts.items())
        total, rest = sum(x for x, _ in weights), 0.0
        for x, w in weights:
            rest += x
            if rest >= t * t * total * (1 - 1e-9):
                out.add(w)
    return sorted(out)


def pieces(text: Column) -> Column:
    """What of a text is compared: (piece, body) for each line from 0, its header (piece -1) and the whole of it (piece -2).

    The header is what stands before the first blank line. It and the whole are left out where they are one line, and the whole where it is the header.
    """
    lines = F.transform(F.split(text, "\n"), lambda body, i: F.struct(i.alias("piece"), body.alias("body")))
    header = F.regexp_extract(text, r"(?s)\A(.*?)(?:\n[ \t\r]*(?:\n|\z)|\z)", 1)
    none = F.array().cast("array<struct<piece:int,body:string>>")
    some = lambda kind, body, there: F.when(there, F.array(F.struct(F.lit(kind).alias("piece"), body.alias("body")))).otherwise(none)
    many = lambda x: F.contains(F.trim(x), F.lit("\n"))
    return F.concat(lines, some(-1, header, many(header)), some(-2, text, many(text) & (F.trim(header) != F.trim(text))))


def scan_pieces(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, t: float = SIMILARITY) -> DataFrame:
    """rid, piece, license, score and n_words of each piece whose cosine to a template is t or more. ``files`` has rid and text.

    A word weighs its count times ln((1 + files) / (1 + files with it)) + 1; the
    files with a word are counted over all files, for the templates' words and for all others of the pieces in question.
    Of several templates the nearest counts, then the last by license.
    """
    spark = files.sparkSession
    made = template_table(spark, templates)
    vocabulary = sorted({w for _, _, counts in made for w in counts})
    held = files.select(F.array_intersect(F.array_distinct(words(F.coalesce("text", F.lit("")))), F.array(*map(F.lit, vocabulary))).alias("w"))
    # one pass: a row for each word of the templates, and the number of files under the empty word
    counted = held.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in counted}
    n = df.pop("", 0)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    some = "|".join(needles(made, idf, t))
    pattern = rf"(?i)(^|[^a-z0-9])({some})([^a-z0-9]|$)"
    cut = (
        files.where(F.col("text").rlike(pattern)).select("rid", F.inline(pieces(F.col("text"))))
        .where(F.col("body").rlike(pattern)).select("rid", "piece", words(F.col("body")).alias("words"))
    )
    counts = cut_lineage(cut.select("rid", "piece", F.size("words").alias("n_words"), F.explode("words").alias("w")).groupBy("rid", "piece", "n_words", "w").agg(F.count("*").alias("tf")))
    # the other words of these pieces, counted over all files
    others = few(cut_lineage(counts.where(~F.col("w").isin(vocabulary)).select("w").distinct()), F.length("w"))
    seen = files.select(F.explode(F.array_distinct(words("text"))).alias("w")).join(others, "w", "left_semi").groupBy("w").agg(F.count("*").alias("files"))
    known = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])[F.col("w")]
    weight = F.coalesce(known, F.log(F.lit(1.0 + n) / (1 + F.coalesce("files", F.lit(0)))) + 1)
    counts = cut_lineage(counts.join(seen, "w", "left").withColumn("x", F.col("tf") * weight).drop("files"))
    values = ", ".join(
        f"('{name}', '{lid}', '{w}', {k * idf[w]!r}D / {math.sqrt(sum((c * idf[v]) ** 2 for v, c in ws.items()))!r}D)" for name, lid, ws in made for w, k in ws.items()
    )
    unit = spark.sql(f"SELECT * FROM VALUES {values} AS v(template, license, w, unit)")  # a literal: as large as the templates
    norms = counts.groupBy("rid", "piece").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counts.join(F.broadcast(unit), "w").groupBy("rid", "piece", "n_words", "template", "license").agg(F.sum(F.col("x") * F.col("unit")).alias("dot"))
    scored = dots.join(norms, ["rid", "piece"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= t)
    best = F.max(F.struct(F.round("score", 9).alias("score"), F.col("license"))).alias("best")
    return scored.groupBy("rid", "piece", "n_words").agg(best).select("rid", "piece", "n_words", "best.license", "best.score")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first, the root ('') last."""
    parts = F.split(directory, "/")
    return F.concat(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/")), F.array(F.lit("")))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES, t: float = SIMILARITY) -> DataFrame:
    """doc_id, path, license, score, origin and license_path for every row of ``files``.

    Each line of the whole text, its header (up to the first blank line) and the whole of it are compared with the templates; a file has its best
    piece's license ('own'). A file of which matching lines, or a matching header, hold half the words or
    more, or which matches as a whole, is a licence file and speaks for its directory and all below. A file without an own
    license takes the nearest ancestor directory's ('inherited'); of several licence
    files in a directory the best counts, then the smallest path. Others have nulls.
    Null texts count as empty; a null path has no directory and inherits nothing;
    repeated rows are all judged. No rows give no rows. Other columns are ignored.
    """
    rows = files.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")
    )
    found = cut_lineage(scan_pieces(rows.select("rid", "text"), templates, t))
    lines = F.sum(F.when(F.col("piece") >= 0, F.col("n_words")))
    own = found.groupBy("rid").agg(F.max(F.struct("score", "license")).alias("best"), F.greatest(lines, F.max(F.when(F.col("piece") < 0, F.col("n_words")))).alias("matched"))
    directory = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    # the word counts of whole texts only matter for files with a matching piece
    held = rows.join(few(own.select("rid")), "rid", "left_semi").select("rid", directory.alias("dir"), "path", F.size(words("text")).alias("n"))
    speaking = (
        own.join(held, "rid").where((F.col("path").isNotNull()) & (F.col("matched") >= FILE_SHARE * F.col("n")))
        .groupBy("dir").agg(F.max(F.struct("best")).alias("top"), F.min_by("path", F.struct(-F.col("best.score"), "path")).alias("license_path"))
        .select("dir", F.col("top.best").alias("best"), "license_path")
    )
    speaking = cut_lineage(speaking)
    light = rows.select("rid", "doc_id", "path", directory.alias("dir"))
    dirs = light.where("path IS NOT NULL").select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("above", "at"))
    over = speaking.select(F.col("dir").alias("at"), F.col("best").alias("from_best"), "license_path")
    near = dirs.join(over, "at").groupBy("dir").agg(F.min_by(F.struct("from_best", "license_path"), "above").alias("near"))
    joined = light.join(own.select("rid", "best"), "rid", "left").join(near, "dir", "left")
    mine = F.col("best").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.when(mine, F.col("best.license")).otherwise(F.col("near.from_best.license")).alias("license"),
        F.when(mine, F.col("best.score")).otherwise(F.col("near.from_best.score")).alias("score"),
        F.when(mine, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("near.license_path")).alias("license_path"),
    )
