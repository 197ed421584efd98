"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down directories.

DataFrame functions only. Units of a text are its lines, pairs and whole runs of neighbouring lines that are made of template terms
(so headers wrapped over lines are put together again), and for licence files the whole text. Which texts and lines are looked at follows
from the cosine alone: a unit u reaches a cosine c with the unit vector of a template t only if
  * u has a term of t besides any set of t's terms whose norm is under c, so texts without such a term are left out, and
  * terms that some template has make up c^2 or more of u's squared norm, so other lines are no units and in no run.
Term counts meet the template terms in a broadcast join (the templates are a fixed list), and sums by unit
give dot products and norms. A row without a licence of its own takes that of the nearest directory above it that holds
a licence file: distinct directories are joined with their ancestors' licences, and rows with their directories.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let, stored

THRESHOLD = 0.6
BROADCAST_ROWS = 200_000
#: Words that any text may hold; they weigh as terms that all documents have.
ORDINARY = frozenset("a all an and any are as at be but by can do even for from has have if in into is it its may more must no not of on one or other out see shall so such that the their they this to under use used was way what which will with without you your".split())
# Public licence texts, headers and titles.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation{version}
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details."""
_GPL3 = _GPL.format(what="program", sign=":", kind="General Public", version=", either version 3 of the License, or (at your option) any later version.")
_GPL2 = _GPL.format(what="program", sign=";", kind="General Public", version="; either version 2 of the License, or (at your option) any later version.")
_LGPL = _GPL.format(what="library", sign=";", kind="Lesser General Public", version="; either version 2.1 of the License, or (at your option) any later version.")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT.split(", including")[0]),
    ("MIT", _MIT),
    ("MIT", _MIT + "\n" + _MIT_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL3.split("\n")[0]),
    ("GPL-3.0", _GPL3),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL2.split("\n")[0]),
    ("GPL-2.0", _GPL2),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", _LGPL.split("\n")[0]),
    ("LGPL-2.1", _LGPL),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD2 + "\n" + _BSD3),
    ("BSD-3-Clause", "\n".join((_BSD2, _BSD3, _BSD_END))),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", _BSD2 + "\n" + _BSD_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Released under the ISC License"),
    ("ISC", _ISC),
    ("ISC", _ISC + "\n" + _ISC_END),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("proprietary", "Copyright. All rights reserved."),
)
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), F.lit(1))


def template_terms(templates=TEMPLATES) -> tuple[list[tuple[str, float, int, str, float]], float]:
    """(term, idf, template, licence, weight in the unit template vector) of all templates, and the idf of other terms."""
    counts = []
    for _, text in templates:
        own: dict[str, int] = {}
        for t in re.findall(_TERM, text.lower()):
            own[t] = own.get(t, 0) + 1
        counts.append(own)
    n = len(templates)
    idf = lambda t: 1.0 if t in ORDINARY else log((1 + n) / (1 + sum(t in c for c in counts))) + 1
    out = []
    for k, ((name, _), own) in enumerate(zip(templates, counts, strict=True)):
        raw = {t: (1 + log(c)) * idf(t) for t, c in own.items()}
        norm = sum(v * v for v in raw.values()) ** 0.5
        out += [(t, idf(t), k, name, v / norm) for t, v in raw.items()]
    return out, log(1 + n) + 1


@lru_cache(maxsize=8)
def needed_terms(templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Terms of which a unit has at least one if its cosine to any template is ``threshold`` or more.

    All other terms of a template have a norm under the threshold together, and no cosine of a unit that has only those is larger.
    """
    weights: dict[int, dict[str, float]] = {}
    for term, _, k, _, w in template_terms(templates)[0]:
        weights.setdefault(k, {})[term] = w
    out: set[str] = set()
    for own in weights.values():
        left = 0.0
        for term in sorted(own, key=lambda t: (t not in ORDINARY, own[t], t)):
            left += own[term] ** 2
            if left >= threshold**2 * (1 - 1e-9):
                out.add(term)
    return tuple(sorted(out))


def _any_of(terms: list[str]) -> str:
    """A regular expression for any of these strings in which common beginnings are shared, so that it fails within a step or two."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[:1], []).append(t[1:])
    out = [re.escape(c) + ("" if rest == [""] else _any_of(rest)) for c, rest in sorted(by.items()) if c]
    return ("(?:" + "|".join(out) + ")" + ("?" if "" in by else "")) if out else ""


def _known(spark: SparkSession, templates) -> tuple[DataFrame, DataFrame]:
    """Constant tables (term, idf) and (term, template, license, weight)."""
    rows, _ = template_terms(templates)
    quoted = lambda v: "'" + v.replace("'", "\\'") + "'"
    idf = ", ".join(f"({quoted(t)}, {v!r}D)" for t, v in sorted({(r[0], r[1]) for r in rows}))
    uses = ", ".join(f"({quoted(t)}, {k}, {quoted(name)}, {w!r}D)" for t, _, k, name, w in rows)
    return spark.sql(f"SELECT * FROM VALUES {idf} AS t(term, idf)"), spark.sql(f"SELECT * FROM VALUES {uses} AS t(term, template, license, weight)")


def directory(path: Column) -> Column:
    """The directory of a path without slashes around it; empty for the root."""
    return F.btrim(F.regexp_replace(path, r"[^/]*$", ""), F.lit("/"))


def is_license_file(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "").rlike(r"(?i)^(licen[sc]e|copying|copyright|notice|unlicense)")


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: (id, path, license, score, origin, from_dir).

    license is the best template's of the row's own units at ``threshold`` or more (origin ``file`` for licence files by name, else
    ``header``), or else that of the nearest directory at or above the row's that holds a licence file (``inherited``, its score and
    directory given), or null. Ties go to the earlier template; between files of one directory to the higher score, then the name.
    Null and empty texts have no units; a null path lies in the root; repeated rows stay repeated.

    Lines in which template terms make up threshold^2 of the squared norm are units, as are each two of them one behind the other and each run of them; up to one other
    line may stand in between, which is left out.
    """
    idf, uses = _known(docs.sparkSession, templates)
    unknown = template_terms(templates)[1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    based = docs.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    wanted = F.lower("text").rlike(r"(?<![a-z0-9])" + _any_of(list(needed_terms(templates, threshold))) + r"(?![a-z0-9])")
    rows = stored(
        based.select(F.monotonically_increasing_id().alias("row"), "id", "path", directory(F.col("path")).alias("dir"), is_license_file(F.col("path")).alias("is_file"), F.when(wanted, F.split("text", "\n", -1)).alias("lines")), "rows"
    )
    # dealt by row, all sums up to those by line need no other shuffle
    cut = rows.where("lines is not null").select("row", "is_file", "lines").repartition("row").select("row", "is_file", F.posexplode("lines").alias("line", "u"))
    counted = cut.select("row", "is_file", "line", F.explode(terms_of(F.col("u"))).alias("term")).groupBy("row", "is_file", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counted.join(F.broadcast(idf), "term", "left")
    squared = F.pow((1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown)), 2)
    of_line = W.partitionBy("row", "line")
    shares = known.withColumns({"a": F.sum(F.when(F.col("idf").isNotNull(), squared).otherwise(0.0)).over(of_line), "b": F.sum(squared).over(of_line)})
    like = F.col("a") >= F.lit(threshold**2) * F.col("b")
    kept = stored(shares.withColumn("like", like).where("like or is_file").select("row", "is_file", "line", "like", "term", "tf", "idf"), "kept")
    in_row = W.partitionBy("row").orderBy("line")
    near = kept.where("like").select("row", "line").distinct().withColumn("before", F.lag("line").over(in_row))
    near = near.withColumn("joins", F.coalesce(F.col("line") - F.col("before") <= 2, F.lit(False)))
    near = near.withColumns({"run": F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(in_row), "follows": F.coalesce(F.lead("joins").over(in_row), F.lit(False))})
    unit = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.col(k).cast("long").alias("k"))
    none = F.array().cast("array<struct<kind:int,k:bigint>>")
    # a pair is named by its first line
    places = F.concat(F.array(unit(0, "line"), unit(2, "run")), F.when(F.col("follows"), F.array(unit(1, "line"))).otherwise(none), F.when(F.col("joins"), F.array(unit(1, "before"))).otherwise(none))
    near = near.select("row", "line", places.alias("units"))
    whole = F.when(F.col("is_file"), F.array(F.struct(F.lit(3).alias("kind"), F.lit(0).cast("long").alias("k")))).otherwise(none)
    dealt = kept.join(near, ["row", "line"], "left").select("row", "term", "tf", "idf", F.explode(F.concat(F.coalesce("units", none), whole)).alias("unit"))
    by = ["row", "unit"]
    weighed = dealt.groupBy(*by, "term").agg(((1 + F.log(F.sum("tf"))) * F.coalesce(F.max("idf"), F.lit(unknown))).alias("w"))
    norms = weighed.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(uses), "term").groupBy(*by, "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, by).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    own = scored.groupBy("row").agg(F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("best"))
    own = stored(own.select("row", F.col("best.license").alias("license"), F.col("best.score").alias("score")), "own")
    merged = stored(rows.drop("lines").join(own, "row", "left"), "merged")
    files = merged.where("is_file and license is not null").groupBy("dir").agg(F.max(F.struct("score", "license")).alias("best"))
    held = files.select(F.col("dir").alias("up"), F.col("best.license").alias("got"), F.col("best.score").alias("got_score"))
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(
        let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(p, F.lit(1), k), "/").alias("up"))))
    )
    dirs = merged.select("dir").distinct().select("dir", F.explode(ups).alias("x")).select("dir", "x.depth", "x.up")
    above = dirs.join(held, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "got", "got_score")).alias("near"))
    above = stored(above.select(F.col("dir").alias("_dir"), "near"), "above")
    side = F.broadcast(above) if above.count() <= BROADCAST_ROWS else above
    out = merged.join(side, F.col("dir") == F.col("_dir"), "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "id", "path",
        F.coalesce("license", "near.got").alias("license"), F.coalesce("score", "near.got_score").alias("score"),
        F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("dir")).otherwise(F.col("near.up")).alias("from_dir"),
    )


def document_path() -> Column:
    """A path for each of ``documents``, which have none: by source, language and runs of 64 ids; texts that name a licence in their first line are licence files."""
    titled = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).rlike(r"(?i)licen[sc]e|copyright|public domain")
    name = F.when(titled, "LICENSE-").otherwise("text-")
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 64).cast("string"), F.concat(name, F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """(doc_id, path, license, score, origin, from_dir) of every document.

    Null and empty texts have no licence of their own; null ids, sources and languages make paths of "none"; repeated rows each have their result; an
    empty table gives an empty result; other columns are not looked at.
    """
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_path())
    return found.withColumnRenamed("id", "doc_id")


def _oracle_sql() -> str:
    """DuckDB text of op10: all terms of all lines of all texts, without the bounds' first filter."""
    known, unknown = template_terms()
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(t)}, {idf!r}::DOUBLE, {k}, {quoted(name)}, {w!r}::DOUBLE)" for t, idf, k, name, w in known)
    part = lambda c: f"coalesce({c}, 'none')"
    titled = "regexp_matches(split_part(text, chr(10), 1), '(?i)licen[sc]e|copyright|public domain')"
    return f"""
WITH k(term, idf, template, license, weight) AS (VALUES {table}),
i AS (SELECT DISTINCT term, idf FROM k),
t AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
p AS (SELECT *, concat_ws('/', {part('source')}, {part('lang')}, CAST(CAST(floor(doc_id / 64) AS BIGINT) AS VARCHAR), CASE WHEN {titled} THEN 'LICENSE-' ELSE 'text-' END || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt') AS path FROM t),
f AS (SELECT *, trim(regexp_replace(path, '[^/]*$', ''), '/') AS dir, regexp_matches(regexp_replace(path, '^.*/', ''), '(?i)^(licen[sc]e|copying|copyright|notice|unlicense)') AS is_file FROM p),
l AS (SELECT r, is_file, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS u FROM f),
x AS (SELECT r, is_file, line, term, count(*) AS tf FROM (SELECT r, is_file, line, unnest(regexp_extract_all(lower(u), '{_TERM}')) AS term FROM l) GROUP BY ALL),
y AS (SELECT x.*, idf, pow((1 + ln(tf)) * coalesce(idf, {unknown!r}::DOUBLE), 2) AS q FROM x LEFT JOIN i ON x.term = i.term),
z AS (SELECT r, line FROM y GROUP BY r, line HAVING coalesce(sum(q) FILTER (idf IS NOT NULL), 0) >= {THRESHOLD**2!r}::DOUBLE * sum(q)),
g AS (SELECT *, lag(line) OVER (PARTITION BY r ORDER BY line) AS before FROM z),
j AS (SELECT *, coalesce(line - before <= 2, false) AS joins FROM g),
h0 AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY line) AS run, coalesce(lead(joins) OVER (PARTITION BY r ORDER BY line), false) AS follows FROM j),
u AS (SELECT r, line, 0 AS kind, line AS k FROM h0 UNION ALL SELECT r, line, 1, line FROM h0 WHERE follows UNION ALL SELECT r, line, 1, before FROM h0 WHERE joins
      UNION ALL SELECT r, line, 2, run FROM h0 UNION ALL SELECT r, line, 3, 0 FROM l WHERE is_file),
w AS (SELECT y.r, kind, u.k, term, (1 + ln(sum(tf))) * coalesce(max(idf), {unknown!r}::DOUBLE) AS w FROM y JOIN u ON y.r = u.r AND y.line = u.line GROUP BY ALL),
n AS (SELECT r, kind, k, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
s AS (SELECT w.r, template, license, round(sum(w.w * k.weight) / any_value(n.norm), 6) AS score FROM w JOIN k ON w.term = k.term JOIN n ON w.r = n.r AND w.kind = n.kind AND w.k = n.k GROUP BY w.r, w.kind, w.k, template, license),
b AS (SELECT r, arg_max(license, (score, -template)) AS license, max(score) AS score FROM s WHERE score >= {THRESHOLD}::DOUBLE GROUP BY r),
m AS (SELECT f.r, doc_id, path, dir, is_file, license, score FROM f LEFT JOIN b ON f.r = b.r),
h AS (SELECT dir, arg_max(license, (score, license)) AS license, max(score) AS score FROM m WHERE is_file AND license IS NOT NULL GROUP BY dir),
a AS (SELECT d.dir, arg_max(h.dir, length(h.dir)) AS up, arg_max(h.license, length(h.dir)) AS license, arg_max(h.score, length(h.dir)) AS score FROM (SELECT DISTINCT dir FROM m) d JOIN h ON h.dir = '' OR h.dir = d.dir OR starts_with(d.dir, h.dir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(m.license, a.license) AS license, coalesce(m.score, a.score) AS score,
       CASE WHEN m.license IS NOT NULL AND is_file THEN 'file' WHEN m.license IS NOT NULL THEN 'header' WHEN a.license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN m.license IS NOT NULL THEN m.dir ELSE a.up END AS from_dir
FROM m LEFT JOIN a ON m.dir = a.dir
"""


ORACLE_SQL = _oracle_sql()
