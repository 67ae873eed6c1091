"""Operator 1 [native]: licence scan by sparse TF-IDF cosine, then directory inheritance.

1. One pass over all texts notes which vocabulary terms each holds; document frequencies are sums of that (a bounded number of terms, so the
   weights fit in the plan).
2. Frequent terms of a template are left out as long as their part of its vector is lighter than ``threshold``; what is left are its
   *anchors*. By Cauchy-Schwarz a unit with a cosine of ``threshold`` or more holds one. Only texts and units with an anchor are scored; the filter is exact.
3. Each line, each paragraph of several lines (headers, also wrapped over comment lines) and
   each whole text (a licence file) is a unit. It meets the templates that it holds an anchor of in a broadcast join, one row a
   template; a cosine is a sum over the unit's terms there. Words outside the vocabulary only lengthen the unit.
4. Licences of one family share most of their wording, so some terms (``marks``: a version, "Lesser", "NonCommercial") must be
   in the unit if they are in the template, and must not be if they are not. What several licences word alike names their family (``FAMILIES``), which counts only where no member
   fits; "All rights reserved." counts only where nothing else fits, at the start of a unit or beside a copyright mark.
5. A file without a licence of its own takes that of the licence file (by its name; with
   ``notices_give`` also of any file that opens with a notice) in its nearest
   ancestor directory: directories are reduced first, join on their ancestors' paths, and
   files join their directory's answer.

All steps are DataFrame functions; no Python code runs in tasks.

Defined cases: null and empty texts have no licence of their own; a null path is
the root directory; rows with one doc_id are one file (its best unit counts for
each of its rows); rows with a null doc_id stay and only inherit; ties of a score
go to the licence whose name sorts first, ties of a directory to the smallest doc_id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.common import broadcast_keys, checkpoint

_GNU = (
    "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
)
_LIBRARY = _GNU.replace("This program", "This library")
_ONLY = (
    "This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} {version} as published by "
    "the Free Software Foundation."
)
_CC = "This work is licensed under a Creative Commons {name} International License."
_NO_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software."
)
_MIT_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
    "this permission notice appear in all copies."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License "
    "at http://www.apache.org/licenses/LICENSE-2.0"
)
#: Licence notices, headers and short licence texts as their publishers word them. What follows # tells texts of one licence apart.
TEMPLATES = {
    "AGPL-3.0#work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0": _GNU.format(mark=":", comma=",", name="Affero General Public License", version="3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#first": _APACHE.split(" You may obtain")[0],
    "Apache-2.0#notice": _APACHE,
    "Apache-2.0#title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": _BSD_2,
    "BSD-2-Clause#text": _BSD_2 + _BSD_END,
    "BSD": _BSD_2.split(" 1. ")[0],
    "BSD#released": "Released under the BSD license.",
    "BSD#style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause": _BSD_3,
    "BSD-3-Clause#conditions": _BSD_2 + _BSD_3,
    "BSD-3-Clause#text": _BSD_2 + _BSD_3 + _BSD_END,
    "CC-BY-4.0": "This work is licensed under CC BY 4.0.",
    "CC-BY-4.0#notice": _CC.format(name="Attribution 4.0"),
    "CC-BY-4.0#title": "Attribution 4.0 International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#notice": _CC.format(name="Attribution-NonCommercial 4.0"),
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0#notice": _CC.format(name="Attribution-NonCommercial-NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0#notice": _CC.format(name="Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0#notice": _CC.format(name="Attribution-NoDerivatives 4.0"),
    "CC-BY-SA-4.0": "This work is licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0#notice": _CC.format(name="Attribution-ShareAlike 4.0"),
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "GPL-2.0": _GNU.format(mark=";", comma=";", name="General Public License", version="2"),
    "GPL-2.0#only": _ONLY.format(mark=";", name="General Public License", version="version 2"),
    "GPL-2.0#work": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0#title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#header": _GNU.format(mark=":", comma=",", name="General Public License", version="3"),
    "GPL-3.0#only": _ONLY.format(mark=":", name="General Public License", version="version 3"),
    "GPL-3.0#notice": _GNU.format(mark=":", comma=",", name="General Public License", version="3") + " " + _NO_WARRANTY.format(name="General Public License"),
    "GPL-3.0#title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC": _ISC,
    "ISC#text": _ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1": _LIBRARY.format(mark=";", comma=";", name="Lesser General Public License", version="2.1"),
    "LGPL-2.1#program": _GNU.format(mark=";", comma=";", name="Lesser General Public License", version="2.1"),
    "LGPL-2.1#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-2.1#work": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0#library": _LIBRARY.format(mark=":", comma=",", name="Lesser General Public License", version="3"),
    "LGPL-3.0#program": _GNU.format(mark=":", comma=",", name="Lesser General Public License", version="3"),
    "LGPL-3.0#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT#first": _MIT.split(" (the")[0],
    "MIT#notice": _MIT,
    "MIT#text": _MIT + _MIT_END,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0#notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "proprietary": "All rights reserved.",
}
#: Identifiers of licences as SPDX writes them; GNU ones also come with a suffix.
IDENTIFIERS = (
    "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 "
    "ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {f"{i}#spdx{end}": f"SPDX-License-Identifier: {i}{end}" for i in IDENTIFIERS for end in (("", "-only", "-or-later") if "GPL" in i else ("",))}
#: Says little by itself: counts only where no other template fits, and only in a unit like this.
LAST_RESORT = "proprietary"
RESERVED = r"^[^a-z0-9]*all rights reserved|copyright|\(c\)|©"
#: Names for what several licences word alike.
FAMILIES = ("BSD",)
#: Terms that tell licences of a family apart; a template's own must be in the unit, the others must not.
GNU_MARKS = "affero lesser 2 2.1 3".split()
CC_MARKS = (
    "by-nc by-nc-nd by-nc-sa by-nd by-sa attribution-noderivatives attribution-noncommercial attribution-noncommercial-noderivatives "
    "attribution-noncommercial-sharealike attribution-sharealike nc nd noderivatives noderivs noncommercial sa sharealike 1.0 2.0 2.5 3.0 4.0"
).split()
VERSION_MARKS = "1.0 1.1 2.0".split()
#: Paragraphs: runs of lines with a letter or digit, so that comment marks do not join them.
PARAGRAPH_BREAK = r"\n[^a-zA-Z0-9\n]*\n"
THRESHOLD = 0.7
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Weight of a word outside the vocabulary, each occurrence for itself.
OTHER_WEIGHT = 1.0
LICENCE_FILE = r"^(licen[cs]e|copying|notice)(\..*)?$"


def template_terms(templates: dict[str, str] = TEMPLATES) -> dict[str, dict[str, int]]:
    return {name: dict(Counter(re.findall(TERM, text.lower()))) for name, text in sorted(templates.items())}


def licence_of(template: str) -> str:
    return template.partition("#")[0]


def marks(template: str, terms: Iterable[str]) -> tuple[list[str], list[str]]:
    """Terms that a unit of this template must hold, and that it must not hold."""
    name, own = licence_of(template), set(terms)
    if "#spdx" in template:
        return sorted(own), []
    family = GNU_MARKS if "GPL" in name else CC_MARKS if name.startswith("CC") else VERSION_MARKS if name.startswith(("Apache", "MPL", "EPL")) else []
    return sorted((own & set(family)) | ({"gnu"} & own)), sorted(set(family) - own)


def vocabulary(templates: dict[str, str] = TEMPLATES) -> list[str]:
    return sorted({t for terms in template_terms(templates).values() for t in terms} | {*GNU_MARKS, *CC_MARKS, *VERSION_MARKS})


def rank_of(licence: str) -> int:
    return 2 if licence == LAST_RESORT else int(licence in FAMILIES)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def held_terms(files: DataFrame, vocab: list[str]) -> DataFrame:
    """doc_id, held: the vocabulary terms of each text, written out; the one pass over all texts."""
    held = F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocab)))
    return checkpoint(files.select("doc_id", held.alias("held")))


def inverse_frequencies(held: DataFrame, vocab: list[str]) -> dict[str, float]:
    """ln((1 + n) / (1 + df)) + 1 of every vocabulary term over all texts; one row a term reaches the driver."""
    counted = held.select(F.explode(F.array_append("held", F.lit(""))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    found = {r["t"]: r["df"] for r in counted.collect()}
    n = found.get("", 0)
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocab}


def template_weights(idf: dict[str, float], templates: dict[str, str] = TEMPLATES) -> dict[str, dict[str, float]]:
    """Unit-length TF-IDF vectors."""
    out = {}
    for name, terms in template_terms(templates).items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        out[name] = {t: n * idf[t] / norm for t, n in terms.items()}
    return out


def anchors(weights: dict[str, dict[str, float]], idf: dict[str, float], threshold: float = THRESHOLD) -> dict[str, list[str]]:
    """Terms by template of which a unit at the threshold holds at least one: its most frequent terms stay out while together they are lighter than the threshold.

    Where a unit must hold some terms anyway, the rarest of them stands alone.
    """
    found: dict[str, list[str]] = {}
    for name, terms in weights.items():
        must = marks(name, terms)[0]
        if must:
            found[name] = [max(must, key=lambda t: (idf[t], t))]
            continue
        left_out, found[name] = 0.0, []
        for t, w in sorted(terms.items(), key=lambda x: (idf[x[0]], x[0])):
            left_out += w * w
            if left_out >= (threshold - 1e-9) ** 2:
                found[name].append(t)
    return found


def _literal_map(pairs: Iterable[tuple[str, float]]) -> Column:
    return F.create_map(*(x for t, w in pairs for x in (F.lit(t), F.lit(w))))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mark_rows(templates: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """(template, term, must, must_not) of all marks."""
    found = []
    for name, terms in template_terms(templates).items():
        must, must_not = marks(name, terms)
        found += [(name, t, 1, 0) for t in must] + [(name, t, 0, 1) for t in must_not]
    return found


def template_table(files: DataFrame, weights: dict[str, dict[str, float]], templates: dict[str, str]) -> DataFrame:
    """template (its number by name), licence, rank, weights, must, must_not: one row a template."""
    array = lambda items: f"cast(array({', '.join(map(_quoted, items))}) as array<string>)"
    rows = []
    for k, (name, terms) in enumerate(sorted(weights.items())):
        must, must_not = marks(name, template_terms(templates)[name])
        weight = ", ".join(f"{_quoted(t)}, {w!r}D" for t, w in sorted(terms.items()))
        rows.append(f"({k}, {_quoted(licence_of(name))}, {rank_of(licence_of(name))}, map({weight}), {array(must)}, {array(must_not)})")
    return files.sparkSession.sql(f"select * from values {', '.join(rows)} as v(template, licence, rank, weights, must, must_not)")


def score_units(units: DataFrame, idf: dict[str, float], weights: dict[str, dict[str, float]], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """units with a column unit -> their other columns, licence, rank and score for every template that the unit holds an anchor of and whose marks agree; one projection after another, no array twice."""
    keep = [c for c in units.columns if c != "unit"]
    at: dict[str, list[int]] = {}
    for k, (_, own) in enumerate(sorted(anchors(weights, idf, threshold).items())):
        for t in own:
            at.setdefault(t, []).append(k)
    templates_of = F.create_map(*(x for t, ks in sorted(at.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    df = units.withColumn("_all", tokens(F.col("unit")))
    df = df.withColumn("_held", F.sort_array(F.filter("_all", lambda t: t.isin(*idf)))).withColumn("_own", F.array_distinct("_held"))
    counted = F.transform("_own", lambda t: F.struct(t.alias("t"), ((F.array_size(F.filter("_held", lambda x: x == t))) * F.element_at(_literal_map(idf.items()), t)).alias("w")))
    hits = F.array_distinct(F.flatten(F.transform(F.array_intersect("_own", F.array(*map(F.lit, at))), lambda t: F.element_at(templates_of, t))))
    df = df.withColumns({"_w": counted, "_other": (F.size("_all") - F.size("_held")) * (OTHER_WEIGHT**2), "_reserved": F.lower("unit").rlike(RESERVED), "_hits": hits})
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]) + F.col("_other"))
    tried = df.select(*keep, "_own", "_w", "_reserved", norm.alias("_norm"), F.explode("_hits").alias("template"))
    met = tried.join(F.broadcast(template_table(units, weights, templates)), "template")  # one row a template
    agree = (F.size(F.array_intersect("_own", "must")) == F.size("must")) & ~F.arrays_overlap("_own", "must_not") & (F.col("_reserved") | (F.col("rank") < 2))
    dot = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at("weights", x["t"]), F.lit(0.0)))
    return met.where(agree).select(*keep, "licence", "rank", F.round(dot / F.greatest("_norm", F.lit(1e-12)), 6).alias("score"))


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, licence, score, opens: the best line, paragraph or whole text of each file that reaches the threshold.

    opens is true if the best unit is the first line with text, the first paragraph or the whole text.
    """
    vocab = vocabulary(templates)
    held = held_terms(files, vocab)
    idf = inverse_frequencies(held, vocab)
    weights = template_weights(idf, templates)
    anchor = F.array(*map(F.lit, sorted({t for own in anchors(weights, idf, threshold).values() for t in own})))
    wanted = checkpoint(held.where(F.col("doc_id").isNotNull() & F.arrays_overlap("held", anchor)).select("doc_id").distinct())
    near = files.select("doc_id", "text").join(broadcast_keys(wanted), "doc_id", "left_semi").where("text is not null")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line)) > 0)
    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("unit"), (i == 0).alias("opens")))
    pieces = F.transform(F.split("text", PARAGRAPH_BREAK), lambda piece, i: F.struct(piece.alias("unit"), (i == 0).alias("opens")))
    several = F.filter(pieces, lambda u: F.contains(u["unit"], F.lit("\n")))
    candidates = F.filter(F.concat(numbered, several), lambda u: F.arrays_overlap(tokens(u["unit"]), anchor))
    units = near.select("doc_id", F.explode(F.array_append(candidates, F.struct(F.col("text").alias("unit"), F.lit(True).alias("opens")))).alias("x"))
    scored = score_units(units.select("doc_id", "x.unit", "x.opens"), idf, weights, templates, threshold)
    tops = scored.where(F.col("score") >= threshold).groupBy("doc_id", "licence", "rank").agg(F.max(F.struct("score", "opens")).alias("top"))
    ranked = tops.groupBy("doc_id").agg(F.min_by(F.struct("licence", "top"), F.struct("rank", -F.col("top.score"), "licence")).alias("b"))
    return ranked.select("doc_id", F.col("b.licence").alias("licence"), F.col("b.top.score").alias("score"), F.col("b.top.opens").alias("opens"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory itself and every directory above it, up to the root (an empty string)."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def scan_licences(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES, notices_give: bool = False) -> DataFrame:
    """files(doc_id, path, text) -> doc_id, directory, licence, score, origin ('own', 'inherited' or null), from_directory."""
    own = checkpoint(own_licences(files, threshold, templates))  # read for givers and for takers
    name = F.lower(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1))
    places = files.select("doc_id", directory_of(F.col("path")).alias("directory"), name.rlike(LICENCE_FILE).alias("named"))
    placed = places.join(own, "doc_id", "left")
    givers = placed.where(F.col("licence").isNotNull() & (F.col("named") | (F.col("opens") & notices_give)))
    given = givers.groupBy("directory").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("doc_id"))).alias("given"))
    up = placed.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
    met = up.join(given.withColumnRenamed("directory", "above"), "above")
    # a directory may hold most files: its answer goes to them, not they to it
    nearest = checkpoint(met.groupBy("directory").agg(F.max_by(F.struct("given", "above"), F.length("above")).alias("n")))
    out = placed.join(broadcast_keys(nearest), "directory", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "doc_id", "directory", F.coalesce("licence", "n.given").alias("licence"), "score",
        F.when(mine, "own").when(F.col("n.given").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("directory")).otherwise(F.col("n.above")).alias("from_directory"),
    )


def oracle(threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> str:
    rows = ", ".join(f"('{name}', '{licence_of(name)}', '{t}', {n})" for name, terms in template_terms(templates).items() for t, n in terms.items())
    marked = ", ".join(f"('{name}', '{t}', {a}, {b})" for name, t, a, b in mark_rows(templates))
    listed = ", ".join(f"('{t}')" for t in vocabulary(templates))
    families = ", ".join(f"'{f}'" for f in FAMILIES)
    return rf"""
with files as (select doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || (doc_id // 1000) as directory, coalesce(text, '') as text from documents),
tt(template, licence, term, n) as (values {rows}),
vocab as (select * from (values {listed}) as v(term)),
marked as (select * from (values {marked}) as v(template, term, must, must_not)),
df as (select term, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{TERM}')) as term from files) join vocab using (term) group by term),
idf as (select term, ln((1 + (select count(*) from files))::double / (1 + coalesce(df, 0))) + 1 as idf from vocab left join df using (term)),
tn as (select template, sqrt(sum(n * idf * n * idf)) as norm from tt join idf using (term) group by template),
tw as (select template, licence, term, n * idf / norm as w from tt join idf using (term) join tn using (template)),
lines as (select doc_id, line, row_number() over (partition by doc_id order by i) = 1 as opens
          from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from files)
          where length(trim(line)) > 0),
units as (select row_number() over () as u, * from (select doc_id, line as unit, opens from lines union all select doc_id, text, true from files
              union all select doc_id, piece, i = 1 from (select doc_id, unnest(regexp_split_to_array(text, '{PARAGRAPH_BREAK}')) as piece,
                        generate_subscripts(regexp_split_to_array(text, '{PARAGRAPH_BREAK}'), 1) as i from files) where contains(piece, chr(10)))),
tok as (select u, unnest(regexp_extract_all(lower(unit), '{TERM}')) as term from units),
cnt as (select u, term, count(*) as n from tok group by u, term),
nrm as (select u, sqrt(sum(case when idf is null then n * {OTHER_WEIGHT**2} else n * idf * n * idf end)) as norm from cnt left join idf using (term) group by u),
dot as (select u, template, licence, sum(n * idf * w) as dot from cnt join idf using (term) join tw using (term) group by u, template, licence),
bad as (select u, template from cnt join marked using (term) where must_not = 1
        union all select d.u, d.template from (select distinct u, template from dot) d join (select template, term from marked where must = 1) m on m.template = d.template
          anti join cnt on cnt.u = d.u and cnt.term = m.term),
sc as (select doc_id, licence, opens, round(dot / norm, 6) as score, case when licence = '{LAST_RESORT}' then 2 when licence in ({families}) then 1 else 0 end as rank
       from (select * from dot anti join bad on bad.u = dot.u and bad.template = dot.template) join nrm using (u) join units using (u)
       where licence <> '{LAST_RESORT}' or regexp_matches(lower(unit), '{RESERVED}')),
hit as (select doc_id, licence, score, opens, row_number() over (partition by doc_id order by rank, score desc, licence, opens desc) as r from sc where score >= {threshold}),
own as (select * from hit where r = 1),
placed as (select files.doc_id, directory, licence, score, opens from files left join own on files.doc_id = own.doc_id),
given as (select directory, licence as given from (select *, row_number() over (partition by directory order by score desc, doc_id) as r from placed where licence is not null and opens) where r = 1),
dirs as (select distinct directory from placed),
near as (select d.directory, g.given, g.directory as above, row_number() over (partition by d.directory order by length(g.directory) desc) as r
         from dirs d join given g on d.directory = g.directory or starts_with(d.directory, g.directory || '/') or g.directory = '')
select doc_id, p.directory, coalesce(p.licence, n.given) as licence, score,
       case when p.licence is not null then 'own' when n.given is not null then 'inherited' end as origin,
       case when p.licence is not null then p.directory else n.above end as from_directory
from placed p left join (select * from near where r = 1) n on p.directory = n.directory"""
