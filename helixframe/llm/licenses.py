"""License scan (operator 8), DataFrame functions only.

A text's words make five-word shingles; overlapping windows of shingles, in
sizes that double, cover every run of a template's length whole.  A window
that holds a template of n shingles, n between a quarter and half of the window,
is at least 1/4 similar to it, so of BANDS one-row MinHash bands at least one
agrees but with a probability below 3/4^BANDS, 1e-8.  Windows retrieved are
verified by exact containment of the template's shingles.

Two lossless screens come first: a text must hold one word of a set that every
template shingle meets, and a window one template shingle; without, no MinHash
can agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, BANDS = 5, 64
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8
#: A word: letters and digits, with points and hyphens inside.
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"

# License statements and notices in wide use.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License", "This project is licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(license, number, distinct shingles) of every template of K words or more."""
    word = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
    rows, number = [], 0
    for name, texts in templates.items():
        for text in texts:
            own = list(dict.fromkeys(shingles(word.findall(text.lower()))))
            if not own:
                raise ValueError(f"a template of {name} has fewer than {K} words")
            rows.append((name, number, own))
            number += 1
    return rows


def hitting_words(rows: list[tuple[str, int, list[str]]]) -> list[str]:
    """Words of which every template shingle holds one; long words first, as they are rarer in texts."""
    left, chosen = {s for _, _, own in rows for s in own}, []
    while left:
        counts: dict[str, int] = {}
        for shingle in left:
            for word in set(shingle.split()):
                counts[word] = counts.get(word, 0) + 1
        best = max(counts, key=lambda w: (min(len(w), 9) * 1000 + counts[w], w))
        chosen.append(best)
        left = {s for s in left if best not in s.split()}
    return chosen


def once(value: Column) -> Column:
    """The same value, as a generated column: the optimizer doesn't copy it into the lambdas that use it."""
    return F.explode(F.array(value))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment: every license of which a window of the text holds a template.

    A row for each (row of ``docs``, license) found, with the best containment
    among its templates and windows.  Null texts and texts of fewer than K
    words have none; rows with equal doc_id give one row for a license.
    """
    spark: SparkSession = docs.sparkSession
    rows = template_rows(templates)
    every = sorted({s for _, _, own in rows for s in own})
    screen = "|".join(re.escape(w) for w in hitting_words(rows))
    kept = docs.select("doc_id", F.lower("text").alias("_text")).filter(F.col("_text").rlike(screen))
    words = kept.select("doc_id", once(F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    made = F.transform(F.sequence(F.lit(1), F.size("w") - K + 1), lambda i: F.array_join(F.slice("w", i, K), " "))
    sets = words.filter(F.size("w") >= K).select("doc_id", once(made).alias("s")).filter(F.arrays_overlap("s", F.array(*map(F.lit, every))))
    # Window sizes: 2L for templates of up to L shingles, L a power of two; steps of L.
    sizes = sorted({1 << (len(own) - 1).bit_length() for _, _, own in rows})

    def windows_of(size: int) -> Column:
        last = F.floor((F.size("s") - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * size + 1).alias("at"), F.lit(size).alias("size")))

    starts = F.flatten(F.array(*map(windows_of, sizes)))
    cut = sets.select("doc_id", "s", F.explode(starts).alias("v")).select("doc_id", F.col("v.size").alias("size"), once(F.array_distinct(F.slice("s", F.col("v.at"), 2 * F.col("v.size")))).alias("window"))
    cut = cut.filter(F.arrays_overlap("window", F.array(*map(F.lit, every))))
    minima = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("window", lambda s: F.xxhash64(s, b))).alias("least")))
    banded = cut.select("doc_id", "size", "window", F.explode(minima).alias("m")).select("doc_id", "size", "window", "m.band", "m.least")
    known = spark.createDataFrame([(name, number, 1 << (len(own) - 1).bit_length(), own) for name, number, own in rows], "license string, template int, size int, shingles array<string>")
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, b))).alias("least")))
    index = known.select("license", "template", "size", "shingles", F.explode(least).alias("m")).select("license", "template", "size", "shingles", "m.band", "m.least")
    # BANDS rows for each of the templates given by the caller: small by their number.
    met = banded.join(F.broadcast(index), ["size", "band", "least"])
    share = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    verified = met.select("doc_id", "license", share.alias("containment")).filter(F.col("containment") >= contained)
    return verified.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def scan_sql(templates: dict[str, list[str]] = TEMPLATES, contained: float = CONTAINED) -> str:
    """The same without MinHash: all windows against all templates, in DuckDB SQL."""
    values = ", ".join(
        "({}, {}, {}, {}, {})".format(*("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else x for x in (name, number, 1 << (len(own) - 1).bit_length(), len(own), shingle)))
        for name, number, own in template_rows(templates)
        for shingle in own
    )
    return f"""
WITH t(license, template, size, total, shingle) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT r, doc_id, i AS pos, array_to_string(w[i + 1 : i + {K}], ' ') AS shingle FROM w, unnest(range(0, greatest(0, len(w) - {K - 1}))) AS u(i)),
hit AS (SELECT r, doc_id, license, template, size, total, pos, s.shingle FROM s JOIN t ON s.shingle = t.shingle),
placed AS (
  SELECT r, doc_id, license, template, total, pos // size AS win, shingle FROM hit
  UNION ALL SELECT r, doc_id, license, template, total, pos // size - 1, shingle FROM hit WHERE pos >= size
), counted AS (
  SELECT doc_id, license, count(DISTINCT shingle) / CAST(total AS DOUBLE) AS containment FROM placed GROUP BY r, doc_id, license, template, total, win
)
SELECT doc_id, license, max(containment) AS containment FROM counted WHERE containment >= {contained} GROUP BY doc_id, license
"""
