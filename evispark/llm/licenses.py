"""Licence scans: TF-IDF cosine of headers and licence files to templates, inheritance from the nearest ancestor folder; DataFrame functions only."""

from __future__ import annotations

import json
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Full texts by SPDX name: the licences' own words (fixed values).
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")
#: Headers and short notices by which files name their licence (fixed values).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
     "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
     "https://www.gnu.org/licenses/."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
]
#: Names that SPDX tags give, besides the names above and those of the texts (fixed values).
SPDX = {"AGPL-3.0": "AGPL-3.0", "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0", "WTFPL": "WTFPL"} | {f"{x}-{y}": x for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for y in ("only", "or-later")}
#: A line that names none of these is no notice by itself. Whole licence files and leading comments need none.
MENTIONS = "licen[cs]e|copyright|spdx|rights reserved|permission is hereby|gpl|creative commons|public domain"
_HINTS = ["licen", "copyright", "spdx", "rights reserved", "permission is hereby", "gpl", "creative commons", "public domain"]
LEAST = 0.5
_OPENS, _COMMENT = r"\A\s*(?:#|//|/\*|--|;|%|<!--)", r"^\s*(?:#|//|--|;|%|$)"


def templates() -> list[tuple[str, str]]:
    """(name, text): the full texts, the notices and an SPDX tag for each name."""
    out = []
    for file in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, file), encoding="utf-8") as f:
            out.append((file.removesuffix(".txt"), f.read()))
    out += NOTICES
    named = {name: name for name, _ in out if name != "Proprietary"} | SPDX
    return out + [(name, f"SPDX-License-Identifier: {tag}") for tag, name in sorted(named.items())]


def tokens_of(known: list[tuple[str, str]]) -> list[dict]:
    """The counts of tokens of each template: what is compared, a few thousand numbers."""
    return [{"name": name, "id": i, "tf": dict(sorted(Counter(re.findall("[a-z0-9]+", text.lower())).items()))} for i, (name, text) in enumerate(known)]


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def notice_lines(text: Column) -> Column:
    """The distinct lines that name a licence. The plain search spares most texts the pattern."""
    low = F.lower(text)
    any_ = F.lit(False)
    for hint in _HINTS:
        any_ = any_ | low.contains(hint)
    return F.when(any_, F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?i){MENTIONS}")))).otherwise(F.array().cast("array<string>"))


def leading_comment(text: Column) -> Column:
    """The comment that a text opens with, up to its closing mark or the first line that is none; null without one."""
    lines = F.split(text, "\n")
    ends = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT)), True)
    by_line = F.array_join(F.slice(lines, 1, F.when(ends > 0, ends - 1).otherwise(F.size(lines)).cast("int")), "\n")
    found = F.when(F.ltrim(text).startswith("/*"), F.substring_index(text, "*/", 1)).when(F.ltrim(text).startswith("<!--"), F.substring_index(text, "-->", 1)).otherwise(by_line)
    return F.when(text.rlike(_OPENS), found)


def license_scan(df: DataFrame, path: str = "path", text: str = "text", licence_file: Column | None = None, known: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """All columns of `df` but the text, and `license`, `score`, `origin` (own, inherited, none) and `licensed_by` (a path) of each file.

    A file's passages are its header (the whole text of a licence file, the leading comment of another) and each line, from the whole text,
    that mentions a licence. Distinct passages, however many files share one, are compared once: weights are counts times
    ln((1 + N) / (1 + n)) + 1 over all N passages of the table, n of which have the token. The template of the highest cosine (6 digits;
    ties to the smaller name) of `least` or more is the passage's; the header's decides, without one the best line's. Files for
    which `licence_file` holds (default: names such as LICENSE or COPYING) license their folder (highest score, then licence
    and path in order), and files without their own take that of the nearest ancestor folder that has one.

    A null or empty text has no passage; a null path neither gives nor takes. Rows that repeat a path are scanned one by one. An empty
    table gives an empty result. Columns of the added names are replaced, names with `__` are kept for the operator. Very long texts are
    read whole; what is kept of a file is its passages.
    """
    spark = df.sparkSession
    df = df.drop("license", "score", "origin", "licensed_by")
    names = [c for c in df.columns if c != text]
    named = F.coalesce(F.col(path).rlike(r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$") if licence_file is None else licence_file, F.lit(False))
    whole = F.coalesce(F.col(text), F.lit(""))
    header = F.when(F.col("__file"), whole).otherwise(leading_comment(whole))
    passages = F.concat(F.when(header.rlike(r"(?i)[a-z0-9]"), F.array(F.struct(F.lit(0).alias("stage"), header.alias("passage")))).otherwise(F.array().cast("array<struct<stage:int,passage:string>>")), F.transform(notice_lines(whole), lambda x: F.struct(F.lit(1).alias("stage"), x.alias("passage"))))
    files = df.withColumn("__file", named).withColumns({"__passages": passages, "__dir": F.regexp_replace(F.col(path), "(^|/)[^/]*$", ""), "__row": F.monotonically_increasing_id()})
    files = cut(files.select(*[f"`{c}`" for c in names], "__file", "__passages", "__dir", "__row"))

    said = files.filter(F.size("__passages") > 0).select("__row", F.inline("__passages"))
    distinct = said.groupBy("passage").agg(F.count("*").alias("files"))
    total = distinct.agg(F.sum("files")).first()[0] or 0
    words = distinct.select("passage", "files", F.explode(_tokens(F.col("passage"))).alias("token")).groupBy("passage", "files", "token").agg(F.count("*").alias("tf"))
    words = cut(words)
    seen = words.groupBy("token").agg(F.sum("files").alias("seen"))
    idf = F.ln((1 + F.lit(total)) / (1 + F.coalesce("seen", F.lit(0)))) + 1
    listed = F.from_json(F.lit(json.dumps(tokens_of(templates() if known is None else known))), "array<struct<name:string,id:int,tf:map<string,int>>>")
    notices = spark.range(1).select(F.inline(listed)).select("name", "id", F.explode("tf").alias("token", "tf"))
    notices = notices.join(seen, "token", "left").select("name", "id", "token", (F.col("tf") * idf).alias("weight"))
    norms = notices.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("id_norm"))
    weighed = words.join(seen, "token").select("passage", "token", (F.col("tf") * idf).alias("w"))
    passage_norms = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(notices, "token").groupBy("passage", "id", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("id_norm")), 6)
    scored = dots.join(norms, "id").join(passage_norms, "passage").select("passage", "name", cosine.alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("passage").agg(F.min(F.struct((-F.col("score")).alias("less"), "name")).alias("b"))

    found = said.join(best, "passage").groupBy("__row").agg(F.min(F.struct("stage", "b.less", "b.name")).alias("f"))
    owned = files.join(found, "__row", "left").select(*[f"`{c}`" for c in names], "__file", "__dir", F.col("f.name").alias("__own"), (-F.col("f.less")).alias("__score"))
    givers = owned.filter(F.col("__file") & F.col("__own").isNotNull() & F.col(path).isNotNull())
    givers = givers.groupBy(F.col("__dir").alias("giver_dir")).agg(F.min(F.struct((-F.col("__score")).alias("less"), F.col("__own").alias("own"), F.col(path).alias("by"))).alias("g"))
    dirs = files.filter(F.col("__dir").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    ancestors = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("dir"))), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir"))))
    above = dirs.select("__dir", F.inline(ancestors)).join(givers, F.col("dir") == F.col("giver_dir"))
    near = above.groupBy("__dir").agg(F.max_by("g", "depth").alias("__g"))
    out = owned.join(near, "__dir", "left")
    own, given = F.col("__own").isNotNull(), F.col("__g").isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce("__own", "__g.own").alias("license"), F.when(own, F.col("__score")).when(given, -F.col("__g.less")).alias("score"),
        F.when(own, "own").when(given, "inherited").otherwise("none").alias("origin"), F.when(own, F.col(path)).when(given, F.col("__g.by")).alias("licensed_by"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents as files <source>/<hundred of doc_id>/<doc_id>; a text that is licence lines to a fifth of its
    characters or more serves as its folder's licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text")
    lines = notice_lines(F.coalesce("text", F.lit("")))
    share = (F.size(lines) > 0) & (5 * F.length(F.array_join(lines, " ")) >= F.length("text"))
    return license_scan(files, licence_file=share).select("doc_id", "path", "license", "score", "origin", "licensed_by")


def op4_sql() -> str:
    known = [(t["name"], t["id"], token, n) for t in tokens_of(templates()) for token, n in t["tf"].items()]
    rows = ", ".join(f"('{name}', {i}, '{token}', {n})" for name, i, token, n in known)
    return f"""
WITH raw AS (SELECT doc_id, coalesce(source, 'none') || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path,
    coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
noted AS (SELECT *, list_distinct(list_filter(lines, lambda x: regexp_matches(x, '(?i){MENTIONS}'))) AS ls,
    coalesce(list_position(list_transform(lines, lambda x: NOT regexp_matches(x, '^\\s*(#|//|--|;|%|$)')), true), 0) AS stops FROM raw),
files AS (SELECT doc_id, path, regexp_replace(path, '(^|/)[^/]*$', '') AS dir, ls, len(ls) > 0 AND 5 * (list_sum(list_transform(ls, lambda x: length(x))) + len(ls) - 1) >= length(text) AS is_file,
    CASE WHEN NOT regexp_matches(text, '^\\s*(#|//|/\\*|--|;|%|<!--)') THEN NULL WHEN starts_with(ltrim(text, ' '), '/*') THEN string_split(text, '*/')[1] WHEN starts_with(ltrim(text, ' '), '<!--') THEN string_split(text, '-->')[1]
        ELSE array_to_string(CASE WHEN stops > 0 THEN lines[1:stops - 1] ELSE lines END, chr(10)) END AS opening, text FROM noted),
said AS (SELECT doc_id, 0 AS stage, CASE WHEN is_file THEN text ELSE opening END AS passage FROM files WHERE regexp_matches(CASE WHEN is_file THEN text ELSE opening END, '(?i)[a-z0-9]')
    UNION ALL SELECT doc_id, 1, unnest(ls) FROM files),
headers AS (SELECT passage AS header, count(*) AS n FROM said GROUP BY passage),
total AS (SELECT coalesce(sum(n), 0) AS n FROM headers),
words AS (SELECT header, token, count(*) AS tf, any_value(n) AS n FROM (SELECT header, n, unnest(regexp_extract_all(lower(header), '[a-z0-9]+')) AS token FROM headers) GROUP BY header, token),
seen AS (SELECT token, sum(n) AS n FROM words GROUP BY token),
known(name, id, token, tf) AS (VALUES {rows}),
nw AS (SELECT name, id, w.token, w.tf * (ln((1 + t.n) / (1 + coalesce(s.n, 0))) + 1) AS weight FROM known w LEFT JOIN seen s ON s.token = w.token, total t),
hw AS (SELECT header, w.token, w.tf * (ln((1 + t.n) / (1 + s.n)) + 1) AS weight FROM words w JOIN seen s ON s.token = w.token, total t),
nn AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM nw GROUP BY id),
hn AS (SELECT header, sqrt(sum(weight * weight)) AS norm FROM hw GROUP BY header),
dots AS (SELECT header, id, name, sum(hw.weight * nw.weight) AS dot FROM hw JOIN nw ON hw.token = nw.token GROUP BY header, id, name),
scored AS (SELECT header, name, round(dot / (hn.norm * nn.norm), 6) AS score FROM dots JOIN nn USING (id) JOIN hn USING (header)),
best AS (SELECT * FROM (SELECT header, name, score, row_number() OVER (PARTITION BY header ORDER BY score DESC, name) AS k FROM scored WHERE score >= {LEAST}) WHERE k = 1),
found AS (SELECT * FROM (SELECT doc_id, name AS own, score, row_number() OVER (PARTITION BY doc_id ORDER BY stage, score DESC, name) AS k FROM said JOIN best ON header = passage) WHERE k = 1),
owned AS (SELECT f.*, b.own, b.score FROM files f LEFT JOIN found b ON f.doc_id = b.doc_id),
givers AS (SELECT * FROM (SELECT dir, own, score, path AS giver, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own, path) AS k FROM owned WHERE is_file AND own IS NOT NULL) WHERE k = 1),
near AS (SELECT * FROM (SELECT d.dir, g.own, g.score, g.giver, row_number() OVER (PARTITION BY d.dir ORDER BY length(g.dir) DESC) AS k
    FROM (SELECT DISTINCT dir FROM files) d JOIN givers g ON d.dir = g.dir OR starts_with(d.dir, g.dir || '/') OR g.dir = '') WHERE k = 1)
SELECT doc_id, path, coalesce(o.own, n.own) AS license, CASE WHEN o.own IS NOT NULL THEN o.score ELSE n.score END AS score,
    CASE WHEN o.own IS NOT NULL THEN 'own' WHEN n.own IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN o.own IS NOT NULL THEN path ELSE n.giver END AS licensed_by
FROM owned o LEFT JOIN near n ON o.dir = n.dir"""
