"""Licence scans: headers and licence files against templates by TF-IDF, then inheritance along directories.

A line, or a span of one, that shares words with a template is a header; a text that is nothing but licence lines is a licence
file of its directory. Both are compared with the templates by the cosine of sparse TF-IDF vectors, with document
frequencies over all texts. A file without a licence of its own takes that of the nearest ancestor directory with a
licence file. All column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.store import saved

#: The usual short notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}
#: Least cosine of a header, and least share of a licence file's words that stand in licence lines.
ALIKE, WHOLE = 0.8, 0.5
_OWN = ["own_licence", "own_score", "licence_file", "licence", "licence_from"]


def _terms(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def _vocabulary() -> list[str]:
    return sorted({t for texts in TEMPLATES.values() for x in texts for t in _terms(x)})


def _line_terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def _number(values: dict[str, float]) -> Column:
    """A fixed map of words to numbers."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def licence_lines(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(path, n_words, words, best): each line with a cosine of ALIKE or more, the words of the text and of the notice, and
    the best template as (score, first, licence).

    A template is compared with the whole line and with each span of as many words as it has itself, so that words before
    and after a notice don't count against it; then the notice is the span, and not the line.
    The weight of a word is its count times ln((1 + texts) / (1 + texts with it)) + 1; a word of no template has the
    greatest weight. The best template is taken, of equal ones the first by name.
    """
    from math import log, sqrt

    vocabulary = _vocabulary()
    t = F.coalesce(F.col(text), F.lit(""))
    n = files.count()
    per = files.select(F.explode(F.array_intersect(_line_terms(t), F.array(*[F.lit(v) for v in vocabulary]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in per.collect()}  # at most the words of the templates
    idf = {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = log(1 + n) + 1
    rare, needed = telling_words(idf)
    pattern = "(^|[^a-z0-9])(" + "|".join(rare) + ")([^a-z0-9]|$)"  # words end where terms do
    # only texts with such lines go on
    some = files.select(path, t.alias("__t"), F.filter(F.split(t, "\n"), lambda x: F.lower(x).rlike(pattern)).alias("__lines")).where(F.size("__lines") > 0)
    words = some.select(path, F.size(_line_terms(F.col("__t"))).alias("n_words"), F.explode("__lines").alias("line")).withColumn("w", _line_terms(F.col("line")))
    words = words.where(F.size(F.array_intersect("w", F.array(*[F.lit(w) for w in rare]))) >= needed)
    weight = _number(idf)
    ordered, m = F.array_sort("w"), F.size("w")
    words = words.withColumn("sorted", F.when(F.spark_partition_id() >= 0, ordered))
    ends = F.filter(F.sequence(F.lit(1), m), lambda i: (i == m) | (F.get("sorted", i - 1) != F.get("sorted", i)))
    words = words.withColumn("ends", F.when(F.spark_partition_id() >= 0, ends))
    words = words.withColumn("tf", F.transform("ends", lambda i, k: F.struct(F.get("sorted", i - 1).alias("t"), (i - F.when(k > 0, F.get("ends", k - 1)).otherwise(0)).alias("n"))))
    words = words.withColumn("v", F.transform("tf", lambda x: F.struct(x["t"].alias("t"), (x["n"] * F.coalesce(F.element_at(weight, x["t"]), F.lit(other))).alias("x"))))
    words = words.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["x"] * x["x"])))

    telling = F.transform("w", lambda t, i: F.when(t.isin(rare), i + 1))
    words = words.withColumn("at", F.filter(telling, lambda i: i.isNotNull()))
    words = words.withColumn("z", F.transform("w", lambda t: F.struct(t.alias("t"), F.coalesce(F.element_at(weight, t), F.lit(other)).alias("x"))))

    def span(own: Column, size: int) -> Column:
        """The best cosine of ``size`` successive words of a longer line; 0 where it is below ALIKE."""

        def at(start: Column) -> Column:
            some = F.slice("z", start, size)
            dot = F.aggregate(some, F.lit(0.0), lambda s, e: s + e["x"] * F.coalesce(F.element_at(own, e["t"]), F.lit(0.0)))
            least = F.aggregate(some, F.lit(0.0), lambda s, e: s + e["x"] * e["x"])  # the norm but for repeated words, which only add
            norm = F.sqrt(F.aggregate(some, F.lit(0.0), lambda s, e: s + e["x"] * e["x"] * F.size(F.filter(some, lambda y: y["t"] == e["t"]))))
            return F.when(dot * dot >= (ALIKE**2 - 1e-6) * least, F.round(dot / norm, 9)).otherwise(0.0)

        # a span without a telling word stays below ALIKE
        near = F.transform("at", lambda i: F.sequence(F.greatest(i - size + 1, F.lit(1)), F.greatest(F.least(i, F.size("z") - size + 1), F.lit(1))))
        starts = F.filter(F.array_distinct(F.flatten(near)), lambda i: i <= F.size("z") - size + 1)
        return F.when(F.size("z") > size, F.coalesce(F.array_max(F.transform(starts, at)), F.lit(0.0))).otherwise(0.0)

    def cosine(own: Column) -> Column:
        dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["x"] * F.coalesce(F.element_at(own, x["t"]), F.lit(0.0)))
        return F.round(dot / F.col("norm"), 9)

    scores = []
    for place, (name, texts) in enumerate(sorted(TEMPLATES.items())):
        for t in texts:
            counts: dict[str, int] = {}
            for w in _terms(t):
                counts[w] = counts.get(w, 0) + 1
            length = sqrt(sum((c * idf[w]) ** 2 for w, c in counts.items()))
            own = _number({w: c * idf[w] / length for w, c in counts.items()})
            size = len(_terms(t))
            for score, whole in ((cosine(own), True), (span(own, size), False)):
                n_own = F.size("w") if whole else F.lit(size)
                scores.append(F.struct(score.alias("score"), F.lit(-place).alias("first"), F.lit(name).alias("licence"), n_own.alias("words"), F.lit(whole).alias("whole")))
    # a filter on the scores must not be pushed below the columns they need: it would repeat those within one another
    stay = F.spark_partition_id() >= 0
    words = words.withColumn("__all", F.when(stay, F.filter(F.array(*scores), lambda x: x["score"] >= ALIKE))).where(F.size("__all") > 0)
    whole = F.exists("__all", lambda x: x["whole"])
    best = F.array_max(F.transform("__all", lambda x: F.struct(x["score"].alias("score"), x["first"].alias("first"), x["licence"].alias("licence"))))
    length = F.when(whole, F.size("w")).otherwise(F.array_max(F.transform("__all", lambda x: x["words"])))
    return words.select(path, "n_words", length.alias("words"), best.alias("__best"))


def telling_words(idf: dict[str, float]) -> tuple[list[str], int]:
    """Words, and how many different ones a line must have to reach a cosine of ALIKE with any template.

    A line's cosine is at most the length of the template's unit vector over the words that they share. Words are taken
    by falling weight until the others alone stay below ALIKE in every template; two are needed if the others and any
    one more stay below it too.
    """
    units = []
    for texts in TEMPLATES.values():
        for t in texts:
            v = {w: (_terms(t).count(w) * idf[w]) ** 2 for w in set(_terms(t))}
            units.append({w: x / sum(v.values()) for w, x in v.items()})
    rare: set[str] = set()
    limit = ALIKE**2 - 1e-6
    for w in sorted(idf, key=lambda w: (-idf[w], w)):
        if all(sum(x for k, x in u.items() if k not in rare) < limit for u in units):
            break
        rare.add(w)
    two = all(sum(x for k, x in u.items() if k not in rare) + max((x for k, x in u.items() if k in rare), default=0) < limit for u in units)
    return sorted(rare), 2 if two else 1


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``files`` with own_licence, own_score, licence_file, licence and licence_from.

    own_licence is the template of the best line (of equal ones the first by name); a licence file has WHOLE of its words
    in such lines. licence is the own one, or that of the nearest ancestor directory with a licence file in it (the one
    of the best score, then by name), and licence_from the file's or the directory's path. A null path is its own
    directory without ancestors; a null or empty text has no licence of its own; repeated rows are judged alike; input
    columns named like an output column are replaced; an empty table gives no rows.
    """
    files = files.select([c for c in files.columns if c not in _OWN])
    found = licence_lines(files, text, path).groupBy(path).agg(F.max("__best").alias("__best"), F.sum("words").alias("words"), F.sum("n_words").alias("n"), F.count("*").alias("lines"))
    # repeated rows add to all three sums alike
    own = saved(found.select(F.col(path).alias("__p"), "__best", (F.col("words") * F.col("lines") >= WHOLE * F.col("n")).alias("__file")), "licences")
    d = files.join(own, F.col(path).eqNullSafe(F.col("__p")), "left")
    d = d.withColumns({"own_licence": F.col("__best.licence"), "own_score": F.col("__best.score"), "licence_file": F.coalesce("__file", F.lit(False))}).drop("__p", "__file", "__best")
    directory = F.when(F.instr("__p", "/") > 0, F.regexp_extract("__p", "^(.*)/[^/]*$", 1)).otherwise("")
    given = own.where(F.col("__file") & F.col("__p").isNotNull()).groupBy(directory.alias("__dir")).agg(F.max("__best")["licence"].alias("__given"))
    # only directories, not files, are joined with their ancestors
    parents = files.where(F.col(path).isNotNull()).select(F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("").alias("__parent")).distinct()
    steps = parents.select("__parent", F.posexplode(F.concat(F.array("__parent"), F.when(F.col("__parent") != "", ancestors(F.col("__parent"))).otherwise(F.array().cast("array<string>")))).alias("__far", "__dir"))
    nearest = steps.join(given, "__dir").groupBy("__parent").agg(F.min_by(F.struct("__dir", "__given"), "__far").alias("__n"))
    d = d.withColumn("__parent", F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).when(F.col(path).isNotNull(), ""))
    d = d.join(nearest, "__parent", "left")
    return d.withColumns({"licence": F.coalesce("own_licence", F.col("__n.__given")), "licence_from": F.when(F.col("own_licence").isNotNull(), F.col(path)).otherwise(F.col("__n.__dir"))}).drop("__parent", "__n")
