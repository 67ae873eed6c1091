import math
import re
from collections import Counter

import pytest
from chronoline.llm import license_scan as L


def cosine(unit, template, idf):
    a, b = Counter(re.findall(L.TERM, unit.lower())), Counter(re.findall(L.TERM, template.lower()))
    na = math.sqrt(sum((n * idf[t]) ** 2 if t in idf else n for t, n in a.items()))
    nb = math.sqrt(sum((n * idf[t]) ** 2 for t, n in b.items()))
    return sum(a[t] * b[t] * idf[t] ** 2 for t in b) / (na * nb) if na else 0.0


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/a/x.py", "code\nmore code"), (3, "repo/a/b/COPYING", "copy\n\nLicensed under the Apache License, Version 2.0."),
        (4, "repo/a/b/c/y.py", "plain text of and the"), (5, "other/z.py", "nothing"), (6, "repo/a/w.py", "# This work is licensed under the GNU General Public License, version 3.\nbody"),
        (7, None, None), (8, "repo/a/b/c/y2.py", ""), (1, "repo/LICENSE", "Released under the MIT License."), (None, "repo/q.py", "All rights reserved."),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, path string, text string").selectExpr("*", "'x' as licence", "1 as score", "2 as unit")


def test_nearest_ancestor_inheritance(files):
    got = {r["doc_id"]: (r["licence"], r["origin"], r["from_directory"]) for r in L.scan_licences(files, notices_give=True).collect()}
    assert got == {
        1: ("MIT", "own", "repo"), 2: ("GPL-3.0", "inherited", "repo/a"), 3: ("Apache-2.0", "own", "repo/a/b"), 4: ("Apache-2.0", "inherited", "repo/a/b"), 5: (None, None, None),
        6: ("GPL-3.0", "own", "repo/a"), 7: (None, None, None), 8: ("Apache-2.0", "inherited", "repo/a/b"), None: ("MIT", "inherited", "repo"),
    }
    assert L.scan_licences(files).count() == files.count() and L.scan_licences(files.limit(0)).count() == 0


def test_scores_and_anchors_equal_brute_force(spark, files):
    vocab = L.vocabulary()
    idf = L.inverse_frequencies(L.held_terms(files, vocab), vocab)
    weights = L.template_weights(idf)
    units = ["Licensed under the Apache License, Version 2.0 or so", "all rights reserved", "the of and", "", "MIT license. MIT license.", "GNU general public license version 3 applies here to all of it", "some other words",
             "SPDX-License-Identifier: GPL-2.0-only"]
    anchor = {name: set(own) for name, own in L.anchors(weights, idf).items()}
    got = {}
    for r in L.score_units(spark.createDataFrame(list(enumerate(units)), "u bigint, unit string"), idf, weights).collect():
        got[r["u"], r["licence"]] = max(r["score"], got.get((r["u"], r["licence"]), 0.0))
    want = {}
    for u, unit in enumerate(units):
        own = set(re.findall(L.TERM, unit.lower()))
        for name, text in L.TEMPLATES.items():
            must, must_not = L.marks(name, re.findall(L.TERM, text.lower()))
            score = cosine(unit, text, idf)
            assert score < L.THRESHOLD or anchor[name] & own or not set(must) <= own
            fits = set(must) <= own and not set(must_not) & own and (name != L.LAST_RESORT or re.search(L.RESERVED, unit.lower()))
            if fits and anchor[name] & own:
                want[u, L.licence_of(name)] = max(score, want.get((u, L.licence_of(name)), 0.0))
    assert set(got) == set(want)
    assert got == pytest.approx(want, abs=2e-6)
    assert len(want) > 5


def test_anchors_leave_frequent_terms_out(spark):
    rows = [(k, "and all the words of any text that is to be in use or not in a work of this kind by rights for it") for k in range(200)]
    vocab = L.vocabulary()
    idf = L.inverse_frequencies(L.held_terms(spark.createDataFrame(rows, "doc_id bigint, text string"), vocab), vocab)
    own = L.anchors(L.template_weights(idf), idf)
    assert not {t for terms in own.values() for t in terms} & {"the", "of", "and", "any", "all", "to", "in", "is", "or", "be", "this", "work"}
    assert all(own.values())


def test_templates_name_their_own_licence_among_ordinary_files(spark):
    """Every template, as a file, is its licence or, where several word it so, their family."""
    rows = [(k, f"d{k}/x.c", t) for k, t in enumerate(L.TEMPLATES.values())]
    prose = [(1000 + k, f"e{k}/x.txt", "and all the words of any text that is to be in use or not in a work of this kind by rights") for k in range(100)]
    got = {r["doc_id"]: r["licence"] for r in L.own_licences(spark.createDataFrame(rows + prose, "doc_id bigint, path string, text string")).collect()}
    assert got == {k: L.licence_of(name) for k, name in enumerate(L.TEMPLATES)}


def test_plan_is_native(files):
    plan = L.scan_licences(files)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


TREE = {
    "mit/LICENSE": "MIT License\n\nCopyright (c) 2020 Jo Doe\n\n" + L._MIT + "\n\n" + L._MIT_END, "mit/src/a.c": "int main() { return 0; }",
    "bsd/COPYING": "Copyright (c) 2019, Foo Inc. All rights reserved.\n\n" + L._BSD_2 + L._BSD_3 + "\n" + L._BSD_END, "bsd/x.c": "// nothing here",
    "bsd2/LICENSE.txt": "Copyright 2018 Bar\n\n" + L._BSD_2 + "\n\n" + L._BSD_END,
    "isc/LICENSE": "ISC License\n\nCopyright (c) 2021, Baz\n\n" + L.TEMPLATES["ISC#text"],
    "gpl/main.py": "#!/usr/bin/env python\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
    "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n" + "x = 1\n" * 50,
    "gpl/old.c": "/* This program is free software; you can redistribute it and/or modify it under\n * the terms of the GNU General Public License as published by the Free Software\n"
    " * Foundation; either version 2 of the License, or (at your option) any later\n * version.\n */\nint x;",
    "apache/A.java": "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n"
    " * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\nclass A {}",
    "own/p.txt": "(c) Foo Inc. All rights reserved.", "both/p.txt": "Copyright 2020 Foo. All rights reserved.\nReleased under the BSD license.\n" + "text of it\n" * 9,
    "un/UNLICENSE.md": L.TEMPLATES["Unlicense"], "plain/readme.md": "how to build and run it", "gpl/none.py": "print(1)",
}


def test_real_shaped_files(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(TREE.items())], "doc_id bigint, path string, text string")
    got = {p: None for p in TREE} | {list(TREE)[r["doc_id"]]: (r["licence"], r["origin"]) for r in L.scan_licences(df).collect()}
    own = {"mit/LICENSE": "MIT", "bsd/COPYING": "BSD-3-Clause", "bsd2/LICENSE.txt": "BSD-2-Clause", "isc/LICENSE": "ISC", "gpl/main.py": "GPL-3.0", "gpl/old.c": "GPL-2.0",
           "apache/A.java": "Apache-2.0", "own/p.txt": "proprietary", "both/p.txt": "BSD", "un/UNLICENSE.md": "Unlicense"}
    inherited = {"mit/src/a.c": ("MIT", "inherited"), "bsd/x.c": ("BSD-3-Clause", "inherited")}
    assert got == {p: inherited.get(p, (own[p], "own") if p in own else (None, None)) for p in TREE}


def blank(text):
    """With blank lines between the numbered conditions and before the disclaimer, as published."""
    return re.sub(r" (\d\.|THIS SOFTWARE) ", r"\n\n\1 ", text)


def comment(text, width=72, mark=" * "):
    import textwrap

    return "/*\n" + "\n".join(mark + line for line in textwrap.wrap(text, width)) + "\n */\nint x;\n" * 3


PROBES = {
    "BSD-2-Clause": [blank("Copyright 2018 Bar\n\n" + L._BSD_2 + L._BSD_END), comment(L._BSD_2 + L._BSD_END)],
    "BSD-3-Clause": [blank("Copyright 2018 Bar\n\n" + L._BSD_2 + L._BSD_3 + L._BSD_END), comment(L._BSD_2 + L._BSD_3 + L._BSD_END), blank(L._BSD_2 + L._BSD_3).replace("\n\n", "\n *\n * ")],
    "BSD": ["// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\nx"],
    "LGPL-3.0": [comment(L.TEMPLATES["LGPL-3.0#library"]), comment(L.TEMPLATES["LGPL-3.0#program"]), L.TEMPLATES["LGPL-3.0#library"]],
    "LGPL-2.1": [comment(L.TEMPLATES["LGPL-2.1"]), comment(L.TEMPLATES["LGPL-2.1#program"], 40)],
    "GPL-2.0": [comment(L.TEMPLATES["GPL-2.0"]), comment(L.TEMPLATES["GPL-2.0#only"], 50), "# SPDX-License-Identifier: GPL-2.0-or-later\nx"],
    "GPL-3.0": [comment(L.TEMPLATES["GPL-3.0#notice"]), "// SPDX-License-Identifier: GPL-3.0\nx"],
    "AGPL-3.0": [comment(L.TEMPLATES["AGPL-3.0"])],
    "CC-BY-NC-4.0": ["text\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.\n"],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MIT": ["/* SPDX-License-Identifier: MIT */\nint x;", "MIT License\n\nCopyright (c) 2020 Jo\n\n" + L._MIT + "\n\n" + L._MIT_END],
    None: ["Licensed under the Apache License, Version 1.1.", "This work is licensed under a Creative Commons Attribution 3.0 International License.", "the prince kept the land and all rights reserved for the crown",
           "This program is free software under the GNU Library General Public License"],
}


def test_licences_of_one_family_are_told_apart(spark):
    """Also on a table of these files alone, where frequencies tell little."""
    rows = [(name, t) for name, own in PROBES.items() for t in own]
    table = [(k, f"d{k}/f.c", t) for k, (_, t) in enumerate(rows)]
    for others in (0, 400):
        prose = [(1000 + k, f"e{k}/x.txt", "and all the words of any text that is to be in use or not in a work of this kind by rights") for k in range(others)]
        got = {r["doc_id"]: r["licence"] for r in L.own_licences(spark.createDataFrame(table + prose, "doc_id bigint, path string, text string")).collect()}
        assert [(t[:50], got.get(k)) for k, (_, t) in enumerate(rows)] == [(t[:50], name) for name, t in rows]
