"""Licence notices, by the Dice coefficient over word bigrams, with DataFrame functions only.

A text is compared paragraph by paragraph (split at empty lines, so that wrapped notices, headers and the paragraphs of licence
bodies are whole), in paragraphs that match nothing line by line, and in lines that match nothing sentence by sentence. A unit
is lower-cased, and what isn't a letter or digit counts as a space, comment signs too. A template is a candidate only where the
unit's number of distinct bigrams lies within the bounds that the threshold t allows, m * t / (2 - t) to m * (2 - t) / t for
a template of m. Units without any of the templates' telling words are left out first: the other bigrams of no template reach
the threshold.

Defined results: a null, empty or wordless text has no licence; a unit matches the template of the largest coefficient,
the first by name of equals; a paragraph that repeats one notice is one match, other repeats and rows count each; an empty table has no rows; texts of any length are read whole;
null ids are kept; further columns are ignored.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Where a text is cut into paragraphs, these into lines, and lines into sentences.
CUTS = [r"\n[ \t\r]*\n", r"\n", r"[.!?] +"]
#: Notices as they stand in texts: standard short forms of public licences, their file headers, and the paragraphs of their bodies.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Released under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Words that tell nothing of a licence by themselves.
COMMON = frozenset(
    "a above action all an and any appear applicable arising as associated at be but by can charge claim code conditions connection contract copies copy deal dealings dedicated derived distribute distributed documentation"
    " either event except express fee file files following for form found free from general governing granted http https if implied in included including international into is it its kind language later law limitation limitations limited"
    " may merge modify name names neither no nor not notice obtain obtaining of on one only option or org other otherwise out particular person persons portions prior product products program promote provided publish published purpose"
    " released required restriction rights s see sell shall so source specific style subject substantial terms than that the this to under universal unless use used v version was whether which who whom with without work writing written www you your 0 1 2 3 4".split()
)


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def telling(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words one of which a unit needs: without them its coefficient stays under the threshold for every template. Where
    COMMON holds too much of a template, its longest words count as telling."""
    words = {w for texts in templates.values() for t in texts for w in words_of(t)} - COMMON
    for texts in templates.values():
        for t in texts:
            own, m = sorted(set(words_of(t)) - words, key=lambda w: (-len(w), w)), len(bigrams_of(t))
            while 2 * (rest := sum(not set(b.split()) & words for b in bigrams_of(t))) / (rest + m) >= threshold:
                words.add(own.pop(0))
    return sorted(words)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_notices (long, lines that match), licences (sorted names), licence and score (of the best line)."""
    templates = templates or TEMPLATES
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, bigrams_of(t))).alias("bigrams"), F.lit(len(bigrams_of(t))).alias("m")) for name, texts in templates.items() for t in texts))
    hint = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(telling(templates, threshold))})(?![\p{{L}}\p{{N}}])"

    def bigrams(line: Column) -> Column:
        words = F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        return F.transform(F.array(words), lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))))[0]

    def best(own: Column) -> Column:
        n = F.size(own)
        fits = F.filter(table, lambda t: (n * (2 - threshold) >= t["m"] * threshold - 1e-9) & (n * threshold <= t["m"] * (2 - threshold) + 1e-9))
        rated = F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (n + t["m"])).alias("minus"), t["name"].alias("name")))
        return F.array_min(F.filter(rated, lambda r: r["minus"] <= -threshold))

    once = lambda value, use: F.transform(F.array(value), use)[0]
    told = lambda units: F.filter(units, lambda u: u.rlike(hint))
    rate = lambda unit: once(bigrams(unit), best)
    none = F.array().cast("array<struct<minus:double,name:string>>")

    def hits(unit: Column, cuts: list[str]) -> Column:
        """The hit of a unit, or else those of its parts."""
        parts = lambda: F.flatten(F.transform(told(F.split(unit, cuts[0])), lambda part: hits(part, cuts[1:]))) if cuts else none
        return once(rate(unit), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(parts()))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    paragraphs = told(F.when(text.rlike(hint), F.split(text, CUTS[0])).otherwise(F.array().cast("array<string>")))
    rows = docs.select("doc_id", paragraphs.alias("paragraphs")).select("doc_id", F.flatten(F.transform("paragraphs", lambda p: hits(p, CUTS[1:]))).alias("hits"))
    top = F.array_min("hits")
    return rows.select("doc_id", F.size("hits").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("licences"), top["name"].alias("licence"), (-top["minus"]).alias("score"))


def op8_licences(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_notices", F.array_join("licences", ",").alias("licences"), "licence", "score")


def oracle() -> str:
    """The same result, template by template, in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quote(name)}, [{', '.join(map(quote, bigrams_of(t)))}])" for name, texts in TEMPLATES.items() for t in texts)
    return f"""
WITH templates(name, own) AS (VALUES {table}),
paragraphs AS (SELECT doc_id, row_number() OVER () AS p, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{CUTS[0]}')) AS unit FROM documents)),
lines AS (SELECT doc_id, p, row_number() OVER () AS l, unit FROM (SELECT doc_id, p, unnest(string_split(unit, chr(10))) AS unit FROM paragraphs)),
sentences AS (SELECT doc_id, p, l, row_number() OVER () AS s, unit FROM (SELECT doc_id, p, l, unnest(regexp_split_to_array(unit, '{CUTS[2]}')) AS unit FROM lines)),
every AS (SELECT doc_id, p, NULL AS l, NULL AS s, unit FROM paragraphs UNION ALL SELECT doc_id, p, l, NULL, unit FROM lines UNION ALL SELECT doc_id, p, l, s, unit FROM sentences),
worded AS (SELECT *, list_filter(string_split_regex(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM every),
units AS (SELECT doc_id, p, l, s, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM worded WHERE len(words) > 1),
rated AS (SELECT doc_id, p, l, s, name, 2.0::DOUBLE * len(list_intersect(bigrams, own)) / (len(bigrams) + len(own)) AS score FROM units, templates WHERE list_has_any(bigrams, own)),
matched AS (SELECT doc_id, p, l, s, name, score FROM rated WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY p, l, s ORDER BY score DESC, name) = 1),
best AS (SELECT m.* FROM matched m WHERE (m.l IS NULL OR NOT EXISTS (FROM matched x WHERE x.p = m.p AND x.l IS NULL)) AND (m.s IS NULL OR NOT EXISTS (FROM matched x WHERE x.p = m.p AND x.l = m.l AND x.s IS NULL)))
SELECT d.doc_id, count(b.name)::BIGINT AS n_notices, coalesce(string_agg(DISTINCT b.name, ',' ORDER BY b.name), '') AS licences,
  arg_min(b.name, (-b.score, b.name)) AS licence, max(b.score) AS score
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""
