"""Licence scans: Dice coefficient over word bigrams against licence templates.

A document is scanned by line, by paragraph (lines between blank lines) and as a whole.  Each such
unit is normalised (lower case; words are runs of a-z and 0-9) and its set of word bigrams is
compared with each template's.  A template of b bigrams can reach a coefficient of t only with
units of b*t/(2-t) to b*(2-t)/t bigrams, so others are never compared.

Before that, documents without any of a few key words are skipped, and nothing is lost: a match
holds at least t/(2-t) of the template's bigrams, and the key words of a template touch more than
the rest of its bigrams.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What both BSD licences begin and end with.
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Fixed value: the GNU licences' request to look further.
GNU_START = "This program is free software: you can redistribute it and/or modify it under the terms of the "

#: Short notices and texts of public licences, in their usual wording.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "bsd-2-clause-text": BSD_START + BSD_END,
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "bsd-3-clause-text": (
        BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission. " + BSD_END
    ),
    "bsl-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
        "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-sentence": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-sentence": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "Released into the public domain under CC0 1.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        GNU_START + "GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-notice": (
        GNU_START + "GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}


#: Words so frequent in any text that they are key words last.
FREQUENT = frozenset("a an and any at be by for from if in is it of on or that the this to with you https www".split())


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def key_words(templates: Mapping[str, str], threshold: float) -> list[str]:
    """Words of which every text within ``threshold`` of a template has one at least."""
    chosen: set[str] = set()
    for text in templates.values():
        left = bigrams_of(text)
        may_miss = len(left) * (1 - threshold / (2 - threshold))
        missed = {b for b in left if not chosen & set(b.split())}
        for word in sorted({w for b in left for w in b.split()}, key=lambda w: (w in FREQUENT, -len(w), w)):  # long words are rare ones
            if len(missed) < len(left) - may_miss - 1e-9:
                break
            if any(word in b.split() for b in missed):
                chosen.add(word)
                missed = {b for b in missed if word not in b.split()}
    return sorted(chosen)


def _words(text: Column) -> Column:
    """Words of lower-case text."""
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, unit_no, license, dice, bigrams): each unit's best template at ``threshold`` or above.

    ``unit`` is line, paragraph (of several lines, if there are several paragraphs) or document (of
    several lines); ``unit_no`` counts from 0 among the document's units of that kind.  Equal
    coefficients go to the template first by name.  Null, empty and one-word units match nothing;
    each of repeated rows is reported, under its id, null as well; an empty table gives no rows;
    columns beside id and text are ignored, whatever their names.  Runs without a shuffle.
    """
    grams = {name: sorted(bigrams_of(text)) for name, text in sorted(templates.items())}
    keys = key_words(templates, threshold)
    # through a generator, so that lower() runs once and not again for each key word
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.lower(F.col(text_col)))).alias("__tw_text"))
    holds = F.lit(False)
    for k in keys:  # a plain search first: most documents need not be split into words
        holds = holds | F.contains("__tw_text", F.lit(k))
    rows = rows.where(holds).where(F.arrays_overlap(_words(F.col("__tw_text")), F.array(*[F.lit(k) for k in keys])))
    text = F.regexp_replace(F.col("__tw_text"), "\r\n?", "\n")
    rows = rows.select("doc_id", text.alias("__tw_text"))
    lines, paragraphs = F.split("__tw_text", "\n"), F.split("__tw_text", "\n[ \t]*\n")
    as_units = lambda kind, parts: F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), p.alias("part")))
    several = F.when(F.size(paragraphs) > 1, F.filter(as_units("paragraph", paragraphs), lambda u: u["part"].contains("\n"))).otherwise(F.array().cast("array<struct<unit:string,unit_no:bigint,part:string>>"))
    whole = F.when(F.size(lines) > 1, as_units("document", F.array("__tw_text"))).otherwise(F.array().cast("array<struct<unit:string,unit_no:bigint,part:string>>"))
    units = rows.select("doc_id", F.explode(F.concat(as_units("line", lines), several, whole)).alias("__tw_u")).select("doc_id", "__tw_u.unit", "__tw_u.unit_no", _words(F.col("__tw_u.part")).alias("__tw_w"))
    fewest = min(len(g) for g in grams.values()) * threshold / (2 - threshold)
    units = units.where((F.size("__tw_w") - 1 >= F.lit(fewest)) & F.arrays_overlap("__tw_w", F.array(*[F.lit(k) for k in keys])))
    pairs = F.zip_with(F.slice("__tw_w", F.lit(1), F.greatest(F.size("__tw_w") - 1, F.lit(0))), F.slice("__tw_w", F.lit(2), F.greatest(F.size("__tw_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    # through a generator, so that the bigrams are made once and not again for each template
    units = units.select("doc_id", "unit", "unit_no", F.explode(F.array(F.array_distinct(pairs))).alias("__tw_g"))
    units = units.select("doc_id", "unit", "unit_no", "__tw_g", F.explode(F.array(F.size("__tw_g").cast("long"))).alias("bigrams"))

    def score(name: str, own: list[str]) -> Column:
        n = len(own)
        in_bounds = (F.col("bigrams") >= n * threshold / (2 - threshold)) & (F.col("bigrams") <= n * (2 - threshold) / threshold)
        dice = F.lit(2.0) * F.size(F.array_intersect("__tw_g", F.array(*[F.lit(g) for g in own]))) / (F.col("bigrams") + F.lit(n))
        return F.when(in_bounds, F.struct((-dice).alias("against"), F.lit(name).alias("license")))

    scored = units.withColumn("__tw_best", F.array_min(F.array(*[score(k, g) for k, g in grams.items()])))
    return scored.where(F.col("__tw_best.against") <= -threshold).select("doc_id", "unit", "unit_no", F.col("__tw_best.license").alias("license"), (-F.col("__tw_best.against")).alias("dice"), "bigrams")


def oracle_sql(templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.7) -> str:
    """The same in DuckDB, every unit against every template, without bounds or key words."""
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in sorted(bigrams_of(text)))}])" for name, text in sorted(templates.items()))
    return f"""
WITH templates(license, own) AS (VALUES {values}),
docs AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, t, string_split(t, chr(10)) AS l, regexp_split_to_array(t, '\\n[ \\t]*\\n') AS p FROM docs),
units AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS unit_no, l[i] AS part FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines)
  UNION ALL SELECT doc_id, 'paragraph', i - 1, p[i] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM lines WHERE len(p) > 1) WHERE contains(p[i], chr(10))
  UNION ALL SELECT doc_id, 'document', 0, t FROM lines WHERE len(l) > 1),
worded AS (SELECT doc_id, unit, unit_no, regexp_extract_all(lower(part), '[a-z0-9]+') AS w FROM units),
grammed AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
scored AS (SELECT doc_id, unit, unit_no, license, len(g) AS bigrams, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grammed, templates WHERE list_has_any(g, own)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) AS k FROM scored WHERE dice >= {threshold})
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, dice, bigrams::BIGINT AS bigrams FROM best WHERE k = 1"""
