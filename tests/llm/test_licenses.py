import math
import random
import re
from collections import Counter

from tessera.llm import licenses

GPL = "This work is licensed under the GNU General Public License, version 3."


def brute(text, whole=False):
    """(score, license) of the best candidate, without prefixes or bounds."""
    low, found = text.lower(), {}
    paragraphs = [re.sub(licenses.WRAPS, " ", p) for p in re.split(licenses.APART, re.sub(licenses.MARKS, "", low))]
    units = {*re.split(licenses.BREAKS, low), *paragraphs, *(x for p in paragraphs for x in re.split(licenses.STOPS, p)), *([low] if whole else [])}
    tags = {u for u in units if re.search(licenses.TAG, u) and re.search(licenses.BETWEEN, u)}
    units = (units - tags) | {f"spdx-license-identifier: {x}" for u in tags for x in re.split(licenses.BETWEEN, re.sub(licenses.TAG, "", u))}
    for u in units:
        if re.search(licenses.NEGATED, u):
            continue
        tf = Counter(licenses.words(u))
        w = {t: (1 + math.log(n)) * licenses.IDF.get(t, licenses.OTHER_IDF) for t, n in tf.items()}
        size = math.sqrt(sum(x * x for x in w.values())) or 1
        score, name = max((round(sum(x * v.get(t, 0) for t, x in w.items()) / size, 6), name) for name, v in licenses.VECTORS)
        if score >= licenses.THRESHOLD:
            found[name] = max(found.get(name, 0), score)
    if licenses.WITHIN[1] in found:
        found.pop(licenses.WITHIN[0], None)
    return max(((s, n) for n, s in found.items()), default=(None, None))


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "path string, text string, license string, score double")
    return licenses.scan(df).collect()


def test_matches_against_brute_force(spark):
    texts = [GPL, "x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "Licensed under the Apache License, Version 2.0. And more text follows here", "the mit of version", "Released by the team under a license", "released under MIT license!", "", None, "GNU", "A work in progress, version 3", *[t for _, t in licenses.TEMPLATES]]
    rows = [(f"d{i}/f.txt", t) for i, t in enumerate(texts)]
    for r in scan(spark, rows):
        score, name = brute(dict(rows)[r["path"]] or "")
        assert (r["score"], r["license"]) == (score, name), (r, score, name)


def test_every_template_finds_itself(spark):
    got = {r["path"]: r for r in scan(spark, [(f"p{i}/a", t) for i, (_, t) in enumerate(licenses.TEMPLATES)])}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[f"p{i}/a"]["license"] == name and got[f"p{i}/a"]["score"] > 0.95  # a sentence may end inside a template


def test_inheritance_from_the_nearest_directory(spark):
    rows = [("LICENSE", GPL), ("a/LICENSE.txt", "Released under the MIT License"), ("a/b/COPYING", "no licence words"), ("a/b/c/x.py", "code"), ("a/y.py", GPL), ("z/x.py", None), ("top.py", ""), (None, "code"), ("ab/x.py", "code"), ("a/b/c/x.py", "code")]
    got = {r["path"]: (r["license"], r["inherited_from"]) for r in scan(spark, rows)}
    assert got == {"LICENSE": ("GPL-3.0", None), "a/LICENSE.txt": ("MIT", None), "a/b/COPYING": ("MIT", "a"), "a/b/c/x.py": ("MIT", "a"), "a/y.py": ("GPL-3.0", None), "z/x.py": ("GPL-3.0", ""), "top.py": ("GPL-3.0", ""), None: ("GPL-3.0", ""), "ab/x.py": ("GPL-3.0", "")}


def test_no_licence_file_and_no_rows(spark):
    assert [(r["license"], r["inherited_from"]) for r in scan(spark, [("a/x", "text")])] == [(None, None)]
    assert scan(spark, []) == []


def test_long_text_with_a_header(spark):
    got = scan(spark, [("a/x", "word " * 200_000 + "\n" + GPL + "\n" + "more " * 100_000)])
    assert got[0]["license"] == "GPL-3.0"


def test_prefixes_lose_nothing():
    chosen = set(licenses.prefix_words())
    for name, v in licenses.VECTORS:
        assert sum(x * x for w, x in v.items() if w not in chosen) < licenses.THRESHOLD**2, name


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice shall be included in all copies."""
WRAPPED = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import x"""
BLOCK = """/*
 * Copyright 2020 X
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */
int x;"""
TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc."""


def test_wrapped_headers_files_and_tags(spark):
    rows = [("m/LICENSE", MIT), ("g/x.py", WRAPPED), ("a/x.c", BLOCK), ("c/COPYING", TITLE), ("e/x", "// SPDX-License-Identifier: MIT\ncode"), ("f/x", "# SPDX-License-Identifier: Apache-2.0"), ("h/x", "SPDX-License-Identifier: Foo"), ("m/y.py", "code")]
    got = {r["path"]: (r["license"], r["score"]) for r in scan(spark, rows)}
    assert got == {"m/LICENSE": ("MIT", 1.0), "g/x.py": ("GPL-3.0", 1.0), "a/x.c": ("Apache-2.0", 1.0), "c/COPYING": ("GPL-3.0", 1.0), "e/x": ("MIT", 1.0), "f/x": ("Apache-2.0", 1.0), "h/x": (None, None), "m/y.py": ("MIT", None)}


def test_bounds_lose_no_match(spark):
    rng = random.Random(10)
    others = ["lorem", "ipsum", "the", "of", "and", "works", "version", "license", "software"]
    texts = []
    for _, t in licenses.TEMPLATES * 2:
        w = t.split()
        for _ in range(rng.randrange(0, 6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(others))
            w.pop(rng.randrange(len(w)))
        texts.append(rng.choice(["", "// ", "x y z\n\n"]) + rng.choice([" ", "\n"]).join(w) + rng.choice(["", ". More follows", "\n\nend"]))
    rows = [(f"d{i}/{('f.txt', 'LICENSE')[i % 2]}", t) for i, t in enumerate(texts)]
    got = {r["path"]: (r["score"], r["license"]) for r in scan(spark, rows)}
    found = 0
    for path, t in rows:
        want = brute(t, path.endswith("LICENSE"))
        assert got[path] == want, (t, got[path], want)
        found += want[1] is not None
    assert found > 20


def test_ties_go_to_the_last_name(spark, monkeypatch):
    monkeypatch.setattr(licenses, "VECTORS", [("A-1", licenses.VECTORS[0][1]), ("B-1", licenses.VECTORS[0][1])])
    assert [r["license"] for r in scan(spark, [("x/y", licenses.TEMPLATES[0][1])])] == ["B-1"]


PROGRAM, LIBRARY = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {{}} Public License as published by the Free Software Foundation{} either version {{}} of the License, or (at your option) any later version.".format(*x) for x in (("program", ":", ","), ("library", ";", ";")))
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
HEADERS = [
    (PROGRAM.format("General", 2), "GPL-2.0"), (PROGRAM.format("General", 3), "GPL-3.0"), (LIBRARY.format("General", 2), "GPL-2.0"), (LIBRARY.format("Lesser General", "2.1"), "LGPL-2.1"), (LIBRARY.format("Lesser General", 3), "LGPL-3.0"),
    (PROGRAM.format("Lesser General", "2.1"), "LGPL-2.1"), (PROGRAM.format("Affero General", 3), "AGPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1"), ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "LGPL-3.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"),
    ("BSD 2-Clause License", "BSD-2-Clause"), ("BSD 3-Clause License", "BSD-3-Clause"), (REDISTRIBUTE, "BSD-2-Clause"), (f"{REDISTRIBUTE}\n\n{NEITHER}", "BSD-3-Clause"), (NEITHER.replace("the copyright holder", "Example Inc."), "BSD-3-Clause"),
    ("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("This project is licensed under the MIT License.", "MIT"), ("Released under the MIT license", "MIT"), (GRANT, "MIT"), ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
    ("# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/", "Apache-2.0"), ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("Mozilla Public License Version 2.0", "MPL-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "ISC"), ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Dedicated to the public domain under CC0 1.0 Universal", "CC0-1.0"),
    ("This work is not licensed under the GNU General Public License, version 3.", None), ("It isn't released under the MIT License", None), ("Nothing here is licensed, nor free.", None),
]


def test_real_headers_give_their_licence_and_version(spark):
    got = {r["path"]: r for r in scan(spark, [(f"h{i}/a", t) for i, (t, _) in enumerate(HEADERS)])}
    wrong = [(t, name, got[f"h{i}/a"]["license"]) for i, (t, name) in enumerate(HEADERS) if got[f"h{i}/a"]["license"] != name]
    assert not wrong


def test_several_licences_are_a_set(spark):
    rows = [("a/x", "SPDX-License-Identifier: Apache-2.0 OR MIT"), ("b/x", "SPDX-License-Identifier: (MIT AND BSD-2-Clause)"), ("c/LICENSE", f"{GPL}\n\nReleased under the MIT License"), ("c/y", "code"), ("d/x", PROGRAM.format("General", 2))]
    assert {r["path"]: r["licenses"] for r in scan(spark, rows)} == {"a/x": "Apache-2.0, MIT", "b/x": "BSD-2-Clause, MIT", "c/LICENSE": "GPL-3.0, MIT", "c/y": "GPL-3.0, MIT", "d/x": "GPL-2.0"}
