"""License scans with DataFrame functions only.

A text's lines, its paragraphs of several lines, the whole text and windows of its words
are normalised (lower case, runs of letters and digits, single spaces) and compared to
licence templates by the Dice coefficient over their sets of word bigrams. As Dice is at
least ``least`` only if the smaller set has least/(2-least) of the larger one, a template
is a candidate for a text only if the text has that part of its bigrams anywhere, and is
compared with a segment only if the segment's size is within its bounds. Windows are as
long as the template, and begin at a bigram of it from which on enough others follow
within that length; they find notices that are wrapped, inside a longer line, or directly
followed by other text, and the heads of whole licence files. Everything is worked out
within a row, so nothing is shuffled.

Defined results: null and empty texts match nothing; a segment of one word has that word
as its only gram; equal scores go to the template first in the list, and of a template's
equal windows to the first; for each text and template the best window is given;
repeated rows are scanned each; an empty table gives an empty one; extra columns are not
carried.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public notices and grants of common licences, as their stewards publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_grams(text: str) -> list[str]:
    """The sorted set of a template's word bigrams, normalised as segments are."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words))


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes of sets that can have Dice ``least`` or more with one of ``n``."""
    ratio = least / (2 - least)
    return math.ceil(n * ratio - 1e-9), math.floor(n / ratio + 1e-9)


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \n]+", " "))


def _pairs(words: Column) -> Column:
    """The grams of an array of words, in order."""
    both = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, both).otherwise(words)


def _segments(clean: Column) -> Column:
    """(kind, position, set of grams) of each line, paragraph of several lines and text of several lines."""
    piece = lambda kind: lambda s, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("position"), _flat(s).alias("segment"), F.contains(s, F.lit("\n")).alias("many"))
    lines = F.transform(F.split(clean, "\n"), piece("line"))
    paragraphs = F.filter(F.transform(F.split(clean, r"\n *\n"), piece("paragraph")), lambda x: x["many"])
    whole = F.filter(F.transform(F.array(clean), piece("text")), lambda x: x["many"])
    known = F.filter(F.concat(lines, paragraphs, whole), lambda x: x["segment"] != "")
    # an array of one binds the words, which are split once so
    grams = lambda x: F.get(F.transform(F.array(F.split(x["segment"], " ")), lambda w: F.array_distinct(_pairs(w))), F.lit(0))
    return F.transform(known, lambda x: F.struct(x["kind"].alias("kind"), x["position"].alias("position"), grams(x).alias("grams")))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with columns that later steps use without working them out again (a generator keeps steps apart)."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("_c")).select(*keep, *[F.col(f"_c.{n}").alias(n) for n in columns])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``id_col``, ``kind``, ``position``, ``license_id``, ``template`` and ``dice`` of each matching segment.

    ``position`` is a line's, paragraph's or window's first word's number. ``templates``
    (licence, text) are literals of the plan, so there should be some hundred at most.
    """
    grams = [template_grams(t) for _, t in templates]
    bounds = [size_bounds(len(g), least) for g in grams]
    anywhere = sorted({x for g in grams for x in g})
    df = docs.select(F.col(id_col).alias("_id"), F.lower(F.regexp_replace(F.col(text_col), r"[^\p{L}\p{N}\n]+", " ")).alias("_clean"))
    df = _once(df.filter("_clean IS NOT NULL"), ["_id", "_clean"], words=F.split(_flat(F.col("_clean")), " "))
    df = _once(df, ["_id", "_clean"], pairs=_pairs(F.col("words")))
    df = _once(df, ["_id", "_clean", "pairs"], hits=F.array_distinct(F.filter("pairs", lambda g: g.isin(anywhere)))).filter(F.size("hits") > 0)
    shared = lambda own: F.size(F.filter("hits", lambda g: g.isin(own)))
    fits = [F.when(shared(own) >= lo, F.lit(k)) for k, (own, (lo, _)) in enumerate(zip(grams, bounds, strict=True))]
    df = _once(df, ["_id", "_clean", "pairs"], fit=F.array_compact(F.array(*fits))).filter(F.size("fit") > 0)

    df = _once(df, ["_id", "pairs", "fit"], segments=_segments(F.col("_clean")))
    sizes = [max(1, len(template_words(t)) - 1) for _, t in templates]  # grams in a window
    chosen = lambda k: F.array_contains("fit", F.lit(k))

    def dice(g: Column, k: int) -> Column:
        """Of a template and a set of grams. Templates are written out one by one, so their grams are constant sets."""
        return 2 * F.size(F.filter(g, lambda x: x.isin(grams[k]))) / (F.size(g) + len(grams[k]))

    def best(g: Column) -> Column:
        fitting = [F.when(chosen(k) & F.size(g).between(*bounds[k]), F.struct(dice(g, k).alias("dice"), F.lit(-k).alias("k"))) for k in range(len(templates))]
        return F.array_max(F.array_compact(F.array(*fitting)))

    def window(k: int) -> Column:
        """The best window of a template, as a segment."""
        near = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.get("pairs", i).isin(grams[k]))
        dense = F.flatten(F.transform(F.array(near), lambda p: F.filter(p, lambda at, i: F.get(p, i + (bounds[k][0] - 1)) < at + sizes[k])))
        of = lambda at: F.get(F.transform(F.array(F.array_distinct(F.slice("pairs", at + 1, sizes[k]))), lambda g: dice(g, k)), F.lit(0))
        top = F.array_max(F.transform(dense, lambda at: F.struct(of(at).alias("dice"), (-at).alias("at"))))
        said = F.transform(F.array(top), lambda x: F.struct(F.lit("window").alias("kind"), (-x["at"]).cast("long").alias("position"), F.struct(x["dice"].alias("dice"), F.lit(-k).alias("k")).alias("best")))
        return F.when(chosen(k), F.get(said, F.lit(0)))

    lines = F.transform("segments", lambda x: F.struct(x["kind"].alias("kind"), x["position"].alias("position"), best(x["grams"]).alias("best")))
    windows = F.array_compact(F.array(*[window(k) for k in range(len(templates))]))
    df = _once(df, ["_id"], found=F.concat(lines, windows))
    df = df.select("_id", F.explode("found").alias("_s")).filter(F.col("_s.best.dice") >= least)
    k = -F.col("_s.best.k")
    named = F.element_at(F.array(*[F.lit(t[0]) for t in templates]), k + 1)
    return df.select(F.col("_id").alias(id_col), "_s.kind", "_s.position", named.alias("license_id"), k.cast("long").alias("template"), F.col("_s.best.dice").alias("dice"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(t[0])}, [{', '.join(map(quoted, template_grams(t[1])))}], {max(1, len(template_words(t[1])) - 1)})" for k, t in enumerate(templates))
    return f"""
WITH template(k, license_id, grams, long) AS (VALUES {rows}),
clean AS (SELECT row_number() OVER () AS r, doc_id, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
part AS (
  SELECT r, doc_id, 'line' AS kind, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS position FROM clean
  UNION ALL SELECT r, doc_id, 'paragraph', unnest(string_split_regex(t, '\\n *\\n')), generate_subscripts(string_split_regex(t, '\\n *\\n'), 1) - 1 FROM clean
  UNION ALL SELECT r, doc_id, 'text', t, 0 FROM clean),
seg AS (SELECT r, doc_id, kind, CAST(position AS BIGINT) AS position, string_split(trim(regexp_replace(s, '[ \\n]+', ' ', 'g')), ' ') AS w FROM part WHERE kind = 'line' OR contains(s, chr(10))),
gram AS (SELECT r, doc_id, kind, position, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM seg WHERE w <> ['']),
scored AS (SELECT r, doc_id, kind, position, license_id, k, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM gram, template
  WHERE 2.0 * least(len(g), len(grams)) >= {least} * (len(g) + len(grams))),
whole AS (SELECT r, doc_id, string_split(trim(regexp_replace(t, '[ \\n]+', ' ', 'g')), ' ') AS w FROM clean),
pairs AS (SELECT r, doc_id, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END AS p FROM whole),
hit AS (SELECT r, k, pos FROM (SELECT r, unnest(p) AS gram, generate_subscripts(p, 1) AS pos FROM pairs) JOIN (SELECT k, unnest(grams) AS gram FROM template) USING (gram)),
dense AS (SELECT r, k, pos FROM (SELECT r, k, pos, lead(pos, CAST(ceil(len(grams) * {least} / (2 - {least}) - 1e-9) AS INT) - 1) OVER (PARTITION BY r, k ORDER BY pos) AS far, long FROM hit JOIN template USING (k)) WHERE far < pos + long),
wide AS (SELECT r, doc_id, k, pos, license_id, grams, list_distinct(p[pos : pos + long - 1]) AS g FROM dense JOIN pairs USING (r) JOIN template USING (k)),
windows AS (SELECT r, doc_id, license_id, k, pos, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM wide)
SELECT doc_id, kind, position, license_id, CAST(k AS BIGINT) AS template, CAST(dice AS DOUBLE) AS dice
FROM scored WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY r, kind, position ORDER BY dice DESC, k) = 1
UNION ALL SELECT doc_id, 'window', CAST(pos - 1 AS BIGINT), license_id, CAST(k AS BIGINT), CAST(dice AS DOUBLE)
FROM windows WHERE dice >= {least} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, pos) = 1"""
