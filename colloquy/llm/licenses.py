"""Licence scan: Dice coefficient over word bigrams against licence templates. DataFrame functions only.

Rows in: doc_id and text, further columns ignored. Units of a text are its lines, its paragraphs
(parted by blank lines) of more than one line, the whole text if it has more than one paragraph, and
runs of two or more neighbouring paragraphs about as long as a complete licence. Runs are compared
with complete licences only; of runs that overlap, that of highest coefficient is a match (ties: the first, then the shortest).
A unit is normalised (A-Z lower-cased, everything but a-z and 0-9 a blank) and its distinct word
bigrams are compared with those of each template whose size allows a coefficient of `least`:
2 min / (a + b) >= least bounds the sizes. Texts without any of the words that every matching unit must hold
one of are passed over at once. A match is the template of highest coefficient (ties: the
name first in order). Null and empty texts, and units of fewer than two words, match nothing;
repeated rows match each for itself.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import let

# Short notices and opening texts of public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-notice": "Licensed under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}

# The complete licences of which TEMPLATES has the openings; the SQL below knows the openings only.
COMPLETE = {
    "BSD-2-Clause": TEMPLATES["BSD-2-Clause"] + " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": TEMPLATES["ISC"] + " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": TEMPLATES["MIT"].removesuffix(".") + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.8


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return "".join(c if c in LOWER or c in "0123456789" else " " for c in lowered).split()


def template_bigrams(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = template_words(text)
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
    return out


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))


def _bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of unit bigram sets that may reach the least coefficient with a template of a size."""
    fits = [n for n in range(1, int(size * (2 - least) / least) + 2) if 2 * min(n, size) >= least * (n + size)]
    return min(fits), max(fits)


#: Clauses that are checked for each template; more of them let fewer texts pass.
CLAUSES = 4


def _telling(grams: list[str], least: float) -> list[list[str]]:
    """Lists of words, long ones first; a unit that reaches the least coefficient with a template of
    these bigrams has a word of each list, for without them it lacks more bigrams than it may."""
    lo = _bounds(len(grams), least)[0]
    words = sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w))
    out: list[list[str]] = []
    while len(out) < CLAUSES:
        clause: list[str] = []
        lacking = len(grams)
        while lacking >= lo and words:
            clause.append(words.pop(0))
            lacking = sum(not set(clause) & set(g.split()) for g in grams)
        if lacking >= lo:
            break
        out.append(clause)
    return out


def _may_match(templates: list[list[str]], least: float) -> Column:
    """Whether a text holds a word of every list of some template. Lower-casing all letters finds at least what
    lower-casing A-Z does."""

    def holds(t: Column) -> Column:
        some = lambda clause: functools.reduce(lambda a, b: a | b, [t.contains(w) for w in clause])
        return functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, map(some, _telling(g, least)), F.lit(True)) for g in templates])

    return let(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), holds)


def scan(docs: DataFrame, least: float = LEAST, notices: dict[str, str] = TEMPLATES, licences: dict[str, str] = COMPLETE) -> DataFrame:
    """One row for each matching unit: doc_id, kind (line, paragraph, paragraphs or text), unit (its number
    from 0, of paragraphs the first one's), license, n_unit, n_template, n_shared (bigrams) and dice.
    notices are compared with all units but runs of paragraphs, licences with all units."""
    templates, complete = template_bigrams(notices), template_bigrams(licences)
    docs = docs.where(_may_match([*templates.values(), *complete.values()], least))
    least_words = min(_bounds(len(b), least)[0] for b in templates.values()) + 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    paragraphs = F.split(F.col("_t"), r"\n[ \t\r]*\n", -1)

    def numbered(kind: str, units: Column) -> Column:
        return F.transform(units, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("unit"), x.alias("body")))

    several = F.filter(numbered("paragraph", paragraphs), lambda p: F.trim(p["body"]).contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, numbered("text", F.array("_t"))).otherwise(F.filter(numbered("text", F.array("_t")), lambda x: F.lit(False)))
    units = F.concat(numbered("line", F.split("_t", "\n", -1)), several, whole)
    order = sorted(templates)
    entries = [(name, templates[name]) for name in order] + [(name, complete[name]) for name in sorted(complete)]

    def listed(some: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(-i).alias("order"), F.lit(entries[i][0]).alias("license"), F.array(*[F.lit(x) for x in entries[i][1]]).alias("grams"), *[F.lit(x).alias(c) for c, x in zip(("lo", "hi"), _bounds(len(entries[i][1]), least), strict=True)]) for i in some])

    known, whole_known = listed([*range(len(entries))]), listed([*range(len(order), len(entries))])

    def rated(b: Column, t: Column) -> Column:
        # ordered so that the maximum is the highest coefficient, then the first name
        n, shared = F.size(t["grams"]), F.size(F.array_intersect(b, t["grams"]))
        return let(shared, lambda s: F.struct((2.0 * s / (F.size(b) + n)).alias("dice"), t["order"].alias("order"), t["license"].alias("license"), F.size(b).cast("long").alias("n_unit"), n.cast("long").alias("n_template"), s.cast("long").alias("n_shared")))

    def best(w: Column, known: Column = known) -> Column:
        return F.when(F.size(w) >= least_words, let(_bigrams(w), lambda b: F.array_max(F.transform(F.filter(known, lambda t: F.size(b).between(t["lo"], t["hi"])), lambda t: rated(b, t)))))

    # exploding the matches, not filtering them, has each unit rated once
    flat = docs.select("doc_id", text.alias("_t")).select("doc_id", F.explode(units).alias("u"))
    found = F.filter(F.array(let(_words(F.col("u.body")), lambda w: best(w))), lambda m: m["dice"] >= least)
    single = flat.select("doc_id", "u.kind", "u.unit", F.explode(found).alias("m"))

    # runs of paragraphs, in texts that have words without which no complete licence is reached
    sizes = [len(template_words(t)) for t in licences.values()]
    lo, hi = min(_bounds(len(b), least)[0] for b in complete.values()) + 1, int(max(sizes) * (2 - least) / least)

    def runs(p: Column) -> Column:
        n = F.transform(p, F.size)
        ends = F.transform(F.sequence(F.lit(0), F.size(n)), lambda i: F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x))
        # paragraphs without words neither begin nor end a run
        full = F.filter(F.sequence(F.lit(0), F.size(n) - 1), lambda i: F.get(n, i) > 0)
        near = lambda i: F.filter(full, lambda j: (j > i) & (F.get(ends, j + 1) - F.get(ends, i)).between(lo, hi))
        words = lambda i, j: F.flatten(F.slice(p, i + 1, j - i + 1))
        return let(ends, lambda ends: F.flatten(F.transform(full, lambda i: F.transform(near(i), lambda j: F.struct(i.alias("i"), j.alias("j"), words(i, j).alias("w"))))))

    def apart(rated: Column) -> Column:
        meets = lambda x: lambda y: (y["i"] <= x["j"]) & (y["j"] >= x["i"])
        return F.aggregate(F.array_sort(rated), F.filter(rated, lambda _: F.lit(False)), lambda kept, x: F.when(F.exists(kept, meets(x)), kept).otherwise(F.concat(kept, F.array(x))))

    split = docs.where(_may_match(list(complete.values()), least)).select("doc_id", text.alias("_t"))
    listed_words = F.transform(paragraphs, lambda x: F.filter(_words(x), lambda w: w != ""))
    def rated_runs(r: Column) -> Column:
        # in order of the array: the highest coefficient, then the first, then the shortest
        each = F.transform(r, lambda x: let(best(x["w"], whole_known), lambda m: F.struct((-m["dice"]).alias("order"), x["i"].alias("i"), x["j"].alias("j"), m.alias("m"))))
        return F.filter(each, lambda x: x["m"]["dice"] >= least)

    rated_all = let(let(listed_words, runs), rated_runs)
    several_found = split.select("doc_id", F.explode(let(rated_all, apart)).alias("r")).select("doc_id", F.lit("paragraphs").alias("kind"), F.col("r.i").cast("long").alias("unit"), F.col("r.m").alias("m"))
    return single.unionByName(several_found).select("doc_id", "kind", "unit", "m.license", "m.n_unit", "m.n_template", "m.n_shared", "m.dice")


def oracle(least: float = LEAST) -> str:
    """The same in DuckDB's SQL over the table documents."""
    rows = ", ".join("('" + name + "', " + str(-k) + ", [" + ", ".join(f"'{b}'" for b in template_bigrams()[name]) + "])" for k, name in enumerate(sorted(TEMPLATES)))
    return f"""
WITH templates(license, place, grams) AS (VALUES {rows}),
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS (
  SELECT doc_id, 'line' AS kind, string_split(t, chr(10)) AS parts FROM texts
  UNION ALL SELECT doc_id, 'paragraph', string_split_regex(t, '\\n[ \\t\\r]*\\n') FROM texts
  UNION ALL SELECT doc_id, 'text', [t] FROM texts WHERE len(string_split_regex(t, '\\n[ \\t\\r]*\\n')) > 1),
units AS (SELECT doc_id, kind, unnest(range(len(parts))) AS unit, unnest(parts) AS body FROM pieces),
words AS (
  SELECT doc_id, kind, unit, string_split(trim(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM units WHERE kind <> 'paragraph' OR contains(trim(body), chr(10))),
grams AS (
  SELECT doc_id, kind, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM words WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, kind, unit, license, place, len(b) AS n_unit, len(grams) AS n_template, len(list_intersect(b, grams)) AS n_shared
  FROM grams JOIN templates ON 2 * least(len(b), len(grams)) >= {least} * (len(b) + len(grams))),
rated AS (SELECT *, 2.0::DOUBLE * n_shared / (n_unit + n_template) AS dice FROM scored)
SELECT doc_id, kind, unit, license, n_unit, n_template, n_shared, dice FROM rated WHERE dice >= {least}
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, place DESC) = 1
"""
