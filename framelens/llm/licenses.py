"""Operator 2: license scans (native).

Every sentence of a text that mentions licensing is a TF-IDF vector in the
vocabulary of the license templates; document frequencies of that vocabulary
are counted over all texts. The sentence's license is the template sentence of
the highest cosine, from ``LEAST`` on; a file's own license is its best
sentence's. Files without one inherit from the nearest ancestor directory
that has a licence file (a file named LICENSE, LICENCE or COPYING) with a
license of its own, found by joining paths. All steps are DataFrame functions.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.7
SENTENCE_END = r"([.!?]) "
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
MENTION = "licen[cs]|copyright|permission|redistribut|spdx|warrant|public domain"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)(\.[a-z]+)?$"

# Notice sentences of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 or any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
                     "are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without "
            "fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)
TERMS = tuple(Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES)
VOCABULARY = tuple(sorted(set().union(*TERMS)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Vocabulary tokens of a lower-cased text, in order, with repeats."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t.isin(list(VOCABULARY)))


def inverse_frequencies(files: DataFrame) -> dict[str, float]:
    """IDF of every vocabulary term over all texts (one row per term reaches the driver)."""
    import math

    seen = files.select(F.explode(F.array_append(F.array_distinct(tokens(lowered(F.col("text")))), F.lit("")))
                        .alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = {r["term"]: r["n"] for r in seen.collect()}
    return {t: math.log((1 + n.get("", 0)) / (1 + n.get(t, 0))) + 1 for t in VOCABULARY}


def best_template(sentence: Column, idf: dict[str, float]) -> Column:
    """struct(score, template) of the most similar template; equal scores go to the earlier one."""
    norms = [sum((n * idf[t]) ** 2 for t, n in terms.items()) ** 0.5 for terms in TERMS]
    weights = F.create_map(*[x for t in VOCABULARY for x in (F.lit(t), F.array(
        *[F.lit(terms[t] * idf[t] / norm) for terms, norm in zip(TERMS, norms)]))])
    rarity = F.create_map(*[x for t in VOCABULARY for x in (F.lit(t), F.lit(idf[t]))])
    words = tokens(sentence)
    counted = F.transform(F.array_distinct(words), lambda t: F.struct(
        t.alias("t"), (F.size(F.filter(words, lambda x: x == t)) * F.element_at(rarity, t)).alias("w")))
    start = F.struct(F.lit(0.0).alias("norm"), F.array(*[F.lit(0.0)] * len(TEMPLATES)).alias("dot"))
    summed = F.aggregate(counted, start, lambda acc, x: F.struct(
        (acc["norm"] + x["w"] * x["w"]).alias("norm"),
        F.zip_with(acc["dot"], F.element_at(weights, x["t"]), lambda a, b: a + x["w"] * b).alias("dot")),
        lambda acc: F.transform(acc["dot"], lambda d, i: F.struct(
            F.when(acc["norm"] > 0, F.round(d / F.sqrt(acc["norm"]), 6)).otherwise(0.0).alias("score"),
            (-i).alias("template"))))
    return F.array_max(summed)


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Add own_license and own_score, null without a match; whole texts are read.

    Null and empty texts have none. Other columns pass through.
    """
    idf = inverse_frequencies(files)
    sentences = F.filter(F.split(F.regexp_replace(lowered(F.col("text")), SENTENCE_END, "$1\n"), "\n"),
                         lambda s: s.rlike(MENTION))
    found = F.array_max(F.transform(sentences, lambda s: best_template(s, idf)))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    # texts without a mention never enter the sentence functions
    df = files.withColumn("_best", F.when(lowered(F.col("text")).rlike(MENTION), found))
    hit = F.col("_best.score") >= least
    return (df.withColumn("own_license", F.when(hit, F.element_at(names, 1 - F.col("_best.template"))))
            .withColumn("own_score", F.when(hit, F.col("_best.score"))).drop("_best"))


def parent(path: str) -> Column:
    """Directory of a path; '' for a file at the top."""
    p = F.col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, '' included, as (depth, name)."""
    names = F.split(directory, "/")
    depth = F.when(directory == "", 0).otherwise(F.size(names))
    return F.transform(F.sequence(F.lit(0), depth), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(names, F.lit(1), d), "/").alias("name")))


def licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Add own_license, own_score, license, origin and from_dir to files (path, text).

    ``origin`` is ``own``, ``inherited`` or null. Of several licence files in a
    directory the highest score counts, then the first name. Rows with a null
    path inherit nothing. Repeated rows are treated alike; an empty table gives
    no rows. Only distinct directories are joined with their ancestors, so a
    large directory costs one row there.
    """
    own = own_licenses(files, least).withColumn("_dir", parent("path"))
    is_file = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE)
    given = own.filter(is_file & F.col("own_license").isNotNull()).groupBy("_dir").agg(
        F.max(F.struct("own_score", F.col("own_license"))).alias("_g")).select(
        F.col("_dir").alias("name"), F.col("_g.own_license").alias("_license"))
    above = (own.filter("_dir is not null").select("_dir").distinct()
             .select("_dir", F.explode(ancestors(F.col("_dir"))).alias("_a"))
             .select("_dir", F.col("_a.depth").alias("_depth"), F.col("_a.name").alias("name")))
    nearest = (above.join(given, "name").groupBy("_dir")
               .agg(F.max(F.struct("_depth", "name", "_license")).alias("_n")))
    out = own.join(nearest, "_dir", "left")
    return (out.withColumn("license", F.coalesce("own_license", "_n._license"))
            .withColumn("origin", F.when(F.col("own_license").isNotNull(), "own")
                        .when(F.col("_n").isNotNull(), "inherited"))
            .withColumn("from_dir", F.when(F.col("own_license").isNull(), F.col("_n.name")))
            .drop("_n", "_dir"))
