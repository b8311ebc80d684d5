"""License scans in DataFrame functions only: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the
nearest directory above that has a licence file, by path joins.

Candidates are the sentences of lines, the paragraphs without comment marks and line ends, and the paragraphs' sentences, so that a wrapped
header is one text; a licence file also counts as a whole. Only candidates that hold a word of some template's prefix, and few enough
other words, are compared: without, the words shared with a template weigh less than THRESHOLD of it, so no match is lost. Their template
words then meet the templates' postings, and products are summed for each candidate and template.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

THRESHOLD = 0.75
# Words that are frequent in running text. Their IDF is 1, the least, as if every template had them.
FREQUENT = frozenset("a all also an and any are as at be been but by can could do either for from had has have he her his if in into is it its may me more most name neither no nor not of on one only or other our out own she so some such than that the their them then there these they this those to under up use used was we were what when which who whom will with work would you your".split())
# SPDX identifiers that tags name, and the customary notices, openings and titles.
TAGGED = ["Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "Unlicense"]
GNU = [("GPL-2.0", "General", "either version 2", "Version 2, June 1991"), ("GPL-3.0", "General", "either version 3", "Version 3, 29 June 2007"), ("LGPL-2.1", "Lesser General", "either version 2.1", "Version 2.1, February 1999"), ("LGPL-3.0", "Lesser General", "either version 3", "Version 3, 29 June 2007"), ("AGPL-3.0", "Affero General", "either version 3", "Version 3, 19 November 2007")]
GNU_NOTICE = "free software; you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation; {1} of the License, or (at your option) any later version"
ISSUED = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", ISSUED),
    ("MIT", ISSUED + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
TEMPLATES += [(name, text) for name, kind, notice, title in GNU for text in (f"This work is licensed under the GNU {kind} Public License, {notice.removeprefix('either ')}", f"GNU {kind} Public License {title}", "This program is " + GNU_NOTICE.format(kind, notice), "This library is " + GNU_NOTICE.format(kind, notice))]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in TAGGED]
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Where a line's sentences part, and those of a paragraph; comment marks at the start of a line; where paragraphs part; line ends in one.
BREAKS, STOPS = r"\n|[.!?][ \t\r\n]+", r"[.!?] +"
MARKS = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]*"
APART, WRAPS = r"\n[ \t\r]*\n", r"[ \t\r]*\n[ \t\r\n]*"
#: A tag of several licences, the part before its first, and what stands between them; a sentence that says what is not the licence.
TAG, BETWEEN = r"^.*spdx-license-identifier: *\(?", r"\)? +(?:or|and) +\(?"
NEGATED = r"(?:\bnot|n't|\bnever|\bno longer)(?: [a-z]+)? (?:licen[cs]ed|released|distributed|covered|dedicated)\b"
#: The second names the first's text and one clause more, so it hides the first in a file that has both.
WITHIN = ("BSD-2-Clause", "BSD-3-Clause")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)(\..*)?$"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _vectors() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """IDF of the template words and of frequent ones, the IDF of any other word, and unit TF-IDF vectors (1 + ln tf) of the templates."""
    bags = [(name, Counter(words(t))) for name, t in TEMPLATES]
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()} | dict.fromkeys(FREQUENT, 1.0)
    out = []
    for name, b in bags:
        v = {w: (1 + math.log(n)) * idf[w] for w, n in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append((name, {w: x / size for w, x in sorted(v.items())}))
    return idf, math.log(1 + len(bags)) + 1, out


IDF, OTHER_IDF, VECTORS = _vectors()


def prefix_words() -> list[str]:
    """Of each template, its heaviest words, until the rest's length is under THRESHOLD: a match must hold one of them."""
    out = set()
    for _, v in VECTORS:
        left = 1.0
        for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if left < (THRESHOLD - 1e-6) ** 2:
                break
            out.add(w)
            left -= x * x
    return sorted(out)


def prefix_pattern() -> str:
    return "(?:^|[^a-z0-9])(?:" + "|".join(map(re.escape, prefix_words())) + ")(?:[^a-z0-9]|$)"


def _idf_rows(number: str) -> str:
    return ", ".join(f"('{w}', {number.format(repr(x))})" for w, x in sorted(IDF.items()))


def _posting_rows(number: str) -> str:
    return ", ".join(f"({i}, '{name}', '{w}', {number.format(repr(x))})" for i, (name, v) in enumerate(VECTORS) for w, x in v.items())


def units(low: Column, whole: Column) -> Column:
    """The distinct candidates of a text in lower case, a tag of several licences as one for each; whole: whether the text counts as a whole too."""
    joined = F.transform(F.split(F.regexp_replace(low, MARKS, ""), APART), lambda p: F.regexp_replace(p, WRAPS, " "))
    found = F.concat(F.split(low, BREAKS), joined, F.flatten(F.transform(joined, lambda p: F.split(p, STOPS))))
    found = F.when(whole, F.concat(found, F.array(low))).otherwise(found)
    tag = lambda u: F.transform(F.split(F.regexp_replace(u, TAG, ""), BETWEEN), lambda x: F.concat(F.lit("spdx-license-identifier: "), x))
    return F.array_distinct(F.flatten(F.transform(found, lambda u: F.when(u.rlike(TAG) & u.rlike(BETWEEN), tag(u)).otherwise(F.array(u)))))


def own_licenses(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, license, score, licenses: the best template of each file with a candidate at THRESHOLD or more, ties to the last name, and
    the names of all candidates' best templates in order.

    Only candidates that can match leave the scan; they are grouped, and their words meet the postings, a fixed table of VECTORS.
    """
    spark = files.sparkSession
    pattern = prefix_pattern()
    low = F.lower("text")
    listed = lambda some: F.array(*[F.lit(w) for w in sorted(some)])
    # A file without any prefix word is left where it is read.
    able = files.where(low.rlike(pattern)).select(*keys, "base", low.alias("low"))
    cut = able.select(*keys, F.explode(F.filter(units(F.col("low"), F.col("base").rlike(LICENCE_FILE)), lambda u: u.rlike(pattern) & ~u.rlike(NEGATED))).alias("unit"))
    # An explode of one element keeps the array from being made anew wherever it is read.
    split = cut.select(*keys, "unit", F.explode(F.array(F.regexp_extract_all("unit", F.lit(WORD), F.lit(0)))).alias("words"))
    kinds, frequent, rare = F.size(F.array_distinct("words")), F.size(F.array_intersect("words", listed(FREQUENT))), F.size(F.array_intersect("words", listed(IDF.keys() - FREQUENT)))
    # Every other kind of word adds at least OTHER_IDF squared to the squared length, and the product is at most the template words' length,
    # which n words of so many kinds cannot pass.
    most = (frequent + rare * max(IDF.values()) ** 2) * F.pow(1 + F.log(F.size("words").cast("double")), 2)
    other = (kinds - frequent - rare) * OTHER_IDF**2
    near = split.where((rare > 0) & (most >= (THRESHOLD - 1e-6) ** 2 * (most + other))).select(*keys, F.xxhash64("unit").alias("u"), "words").distinct()
    # From here on a few rows are left: the candidates' words by count, weight and template.
    idf, postings = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_idf_rows('{}D')} AS t(word, idf)")), F.broadcast(spark.sql(f"SELECT * FROM VALUES {_posting_rows('{}D')} AS t(template, license, word, x)"))
    counted = near.select(*keys, "u", F.explode("words").alias("word")).groupBy(*keys, "u", "word").agg(F.count("*").cast("double").alias("n"))
    weighed = counted.join(idf, "word", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.lit(OTHER_IDF)))
    sized = weighed.groupBy(*keys, "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "w"))).alias("own"))
    rows = sized.select(*keys, "u", "size", F.explode("own").alias("e")).select(*keys, "u", "size", F.col("e.word").alias("word"), F.col("e.w").alias("w"))
    scored = rows.join(postings, "word").groupBy(*keys, "u", "size", "template", "license").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    found = scored.select(*keys, "u", F.round(F.col("dot") / F.col("size"), 6).alias("score"), "license").where(F.col("score") >= THRESHOLD)
    # A candidate has one licence: what else comes near it (another version) is not told.
    units_best = found.groupBy(*keys, "u").agg(F.max(F.struct("score", "license")).alias("b")).select(*keys, "b.license", "b.score")
    every = units_best.groupBy(*keys, "license").agg(F.max("score").alias("score")).groupBy(*keys).agg(F.collect_list(F.struct("score", "license")).alias("all"))
    kept = F.filter("all", lambda x: (x["license"] != WITHIN[0]) | ~F.exists("all", lambda y: y["license"] == WITHIN[1]))
    best = every.withColumn("kept", kept).withColumn("best", F.array_max("kept"))
    return best.select(*keys, "best.license", "best.score", F.array_join(F.sort_array(F.transform("kept", lambda x: x["license"])), ", ").alias("licenses"))


def _parent(path: Column) -> Column:
    """The directory of a path: all before its last slash; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _above(path: Column) -> Column:
    """The directory itself and all above it, down to the root."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def scan(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, path, license, score, inherited_from, licenses: each file's licence, and all that it names.

    files: path, text and keys (others ignored). A file's own match comes first (highest cosine, then last name); else that of the
    nearest directory at or above its own with a matched licence file, whose directory inherited_from names; else null. Null paths
    count as files of the root, null and empty texts have no own match. Rows with equal keys and path are one file. An empty table gives
    no rows. Directories are resolved once each, not once a file, so a hot directory is one row before files join it.
    """
    names = list(dict.fromkeys([*keys, "path"]))
    named = files.select(*names, F.coalesce("path", F.lit("")).alias("at"), "text").withColumns({"base": F.regexp_extract("at", "[^/]*$", 0), "dir": _parent(F.col("at"))})
    # Written once: the texts are scanned for it alone, all joins below read small columns.
    own = materialise(own_licenses(named, names), "licenses")
    rows = named.select(*names, "base", "dir").distinct()
    same = [rows[k].eqNullSafe(own[k]) for k in names]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = rows.join(own, on, "left").select(*[rows[k] for k in names], "base", "dir", "license", "score", "licenses")
    matched = own.select(*names, "license", "score", "licenses").withColumns({"base": F.regexp_extract(F.coalesce("path", F.lit("")), "[^/]*$", 0), "home": _parent(F.coalesce("path", F.lit("")))})
    homes = matched.where(F.col("base").rlike(LICENCE_FILE)).groupBy("home").agg(F.max(F.struct("score", "license", "licenses")).alias("best")).select("home", F.struct("best.license", "best.licenses").alias("given"))
    dirs = named.select("dir").distinct().select("dir", F.explode(_above(F.col("dir"))).alias("home"))
    nearest = dirs.join(homes, "home").groupBy("dir").agg(F.max(F.struct(F.length("home").alias("n"), F.col("home"), F.col("given"))).alias("near"))
    # Hot directories: files join one row of theirs, which adaptive execution broadcasts when small and splits when skewed.
    full = joined.join(nearest, "dir", "left")
    given = F.col("near.given")
    inherited = F.when(F.col("license").isNull(), F.col("near.home")).alias("inherited_from")
    return full.select(*names, F.coalesce("license", given["license"]).alias("license"), "score", inherited, F.coalesce("licenses", given["licenses"]).alias("licenses"))


#: documents have no paths: source/thousand/name, with the first file of a thousand (or of ten, at the source) as its licence file.
PATH = "concat(coalesce(source, 'none'), '/', CASE WHEN doc_id % 10000 = 0 THEN 'LICENSE' WHEN doc_id % 1000 = 0 THEN concat(cast({n} AS {s}), '/LICENSE') ELSE concat(cast({n} AS {s}), '/', cast(doc_id AS {s}), '.txt') END)"


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH.format(n="doc_id div 1000", s="string")).alias("path"), "text")
    return scan(docs, ("doc_id",))


def _oracle() -> str:
    vocab, posting = _idf_rows("CAST({} AS DOUBLE)"), _posting_rows("CAST({} AS DOUBLE)")
    return rf"""
WITH vocab(word, idf) AS (VALUES {vocab}), posting(template, license, word, weight) AS (VALUES {posting}),
files AS (SELECT doc_id, {PATH.format(n='doc_id // 1000', s='VARCHAR')} AS path, coalesce(text, '') AS text FROM documents),
named AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS dir, lower(text) AS low FROM files),
joined AS (SELECT *, list_transform(string_split_regex(regexp_replace(low, '{MARKS}', '', 'g'), '{APART}'), lambda p: regexp_replace(p, '{WRAPS}', ' ', 'g')) AS paragraphs FROM named WHERE regexp_matches(low, '{prefix_pattern()}')),
listed AS (SELECT doc_id, path, unnest(list_concat(string_split_regex(low, '{BREAKS}'), paragraphs, flatten(list_transform(paragraphs, lambda p: string_split_regex(p, '{STOPS}'))), CASE WHEN regexp_matches(base, '{LICENCE_FILE}') THEN [low] ELSE [] END)) AS unit FROM joined),
parts AS (SELECT DISTINCT doc_id, path, unnest(CASE WHEN regexp_matches(unit, '{TAG}') AND regexp_matches(unit, '{BETWEEN}') THEN list_transform(string_split_regex(regexp_replace(unit, '{TAG}', ''), '{BETWEEN}'), lambda x: 'spdx-license-identifier: ' || x) ELSE [unit] END) AS unit FROM listed),
bags AS (SELECT doc_id, path, md5(unit) AS u, unnest(regexp_extract_all(unit, '{WORD}')) AS word FROM parts WHERE regexp_matches(unit, '{prefix_pattern()}') AND NOT regexp_matches(unit, '{NEGATED.replace("'", "''")}')),
tf AS (SELECT doc_id, path, u, word, count(*) AS n FROM bags GROUP BY ALL),
w AS (SELECT doc_id, path, u, tf.word, (1 + ln(n)) * coalesce(idf, {OTHER_IDF!r}) AS w FROM tf LEFT JOIN vocab USING (word)),
norm AS (SELECT doc_id, path, u, sqrt(sum(w * w)) AS size FROM w GROUP BY ALL),
dot AS (SELECT doc_id, path, u, template, license, sum(w * weight) AS dot FROM w JOIN posting USING (word) GROUP BY ALL),
scored AS (SELECT doc_id, path, u, license, round(dot / size, 6) AS score FROM dot JOIN norm USING (doc_id, path, u)),
winners AS (SELECT doc_id, path, u, arg_max(license, (score, license)) AS license, max(score) AS score FROM scored WHERE score >= {THRESHOLD} GROUP BY ALL),
hiding AS (SELECT doc_id, path, bool_or(license = '{WITHIN[1]}') AS hides FROM winners GROUP BY ALL),
own AS (SELECT doc_id, path, max(score) AS score, arg_max(license, (score, license)) AS license, string_agg(DISTINCT license, ', ' ORDER BY license) AS licenses FROM winners JOIN hiding USING (doc_id, path) WHERE NOT (hides AND license = '{WITHIN[0]}') GROUP BY ALL),
homes AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS home, arg_max(license, (score, license, licenses)) AS given, arg_max(licenses, (score, license, licenses)) AS given_all FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}') GROUP BY ALL),
near AS (SELECT dir, max(home) AS home, arg_max(given, length(home)) AS given, arg_max(given_all, length(home)) AS given_all FROM (SELECT DISTINCT dir FROM named) JOIN homes ON dir = home OR starts_with(dir, home || '/') OR home = '' GROUP BY dir)
SELECT DISTINCT named.doc_id, named.path, coalesce(own.license, near.given) AS license, own.score, CASE WHEN own.license IS NULL THEN near.home END AS inherited_from, coalesce(own.licenses, near.given_all) AS licenses
FROM named LEFT JOIN own USING (doc_id, path) LEFT JOIN near USING (dir)
"""


ORACLE = {"op10_license_scan": _oracle()}
