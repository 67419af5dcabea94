"""Licence scans by Dice coefficient over word bigrams (operator 1), DataFrame functions only.

A text is normalised (A-Z lower-cased, everything but a-z and 0-9 a border between words) and compared to
licence templates in three kinds of units: the whole text, its blocks between blank lines, and its lines.
Dice = 2 |A and B| / (|A| + |B|) over the sets of word bigrams. As |A and B| is at most the smaller size,
a score of t needs |A| between t / (2 - t) |B| and (2 - t) / t |B|; only templates within these bounds are
compared, and a unit outside the bounds of all of them is dropped before its bigrams are looked at.

The templates are a list of bounded size (``MAX_TEMPLATE_WORDS``) and become constants of the plan. Every
row is answered where it lies; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.llm.common import LOWER_AZ, UPPER_AZ, lower_az

THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 100_000

# The wording of common licence notices.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Proprietary": ["All rights reserved."],
}


def bigrams(text: str) -> set[str]:
    """The word bigrams of a normalised text; the same rule as the plan's."""
    lowered = text.translate(str.maketrans(UPPER_AZ, LOWER_AZ))
    words = re.findall("[a-z0-9]+", lowered)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _constant(templates: dict[str, list[str]], threshold: float) -> tuple[Column, int, int]:
    """The templates as an array of id, bigrams and size bounds, and the bounds over all of them."""
    rows, least, most, words = [], None, 0, 0
    for name in sorted(templates):
        for text in templates[name]:
            grams = sorted(bigrams(text))
            if not grams:
                continue
            words += len(grams)
            lo = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
            hi = math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
            least, most = lo if least is None else min(least, lo), max(most, hi)
            rows.append(F.struct(
                F.lit(name).alias("id"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"),
                F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    if words > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {words} bigrams, more than {MAX_TEMPLATE_WORDS}")
    empty = F.expr("cast(array() as array<struct<id:string,grams:array<string>,n:int,lo:int,hi:int>>)")
    return (F.array(*rows) if rows else empty), least or 1, most


def _units(text: Column) -> Column:
    """The different units of a text, normalised: words with one blank between them."""
    plain = F.regexp_replace(lower_az(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n]+", " ")
    parts = F.concat(F.array(plain), F.split(plain, r"\n *\n[ \n]*"), F.split(plain, r"\n"))
    return F.array_distinct(F.transform(parts, lambda u: F.trim(F.regexp_replace(u, r"[ \n]+", " "))))


def matches(text: Column, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """An array of ``dice, id``, one for every unit and template that reach the threshold."""
    known, least, most = _constant(templates, threshold)
    words = F.filter(F.transform(_units(text), lambda u: F.split(u, " ")), lambda w: F.size(w) > least)
    grams = F.transform(words, lambda w: F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
    sized = F.filter(grams, lambda g: F.size(g).between(least, most))
    scored = F.flatten(F.transform(sized, lambda g: F.transform(
        F.filter(known, lambda t: F.size(g).between(t["lo"], t["hi"])),
        lambda t: F.struct(
            (F.size(F.array_intersect(g, t["grams"])) * 2.0 / (F.size(g) + t["n"])).alias("dice"), t["id"].alias("id")))))
    return F.filter(scored, lambda m: m["dice"] >= threshold)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, licenses, n_matches`` of every row of ``docs(doc_id, text)``.

    ``license``: the template of the highest score, the first by name among equals; ``licenses``: all that
    reach the threshold, sorted and comma-joined; ``n_matches``: pairs of a unit and a template that do.
    Without a match license and dice are null, licenses is empty. Null and empty texts and an empty list of
    templates give no match; repeated rows are answered each; an empty table gives an empty table.
    """
    best = F.array_sort(F.col("found"), lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(
        a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), matches(F.col("text").cast("string"), templates, threshold).alias("found"))
        .withColumn("best", F.get(best, F.lit(0)))
        .select("doc_id", F.col("best.id").alias("license"), F.col("best.dice").alias("dice"),
                F.array_join(F.array_sort(F.array_distinct("found.id")), ",").alias("licenses"),
                F.size("found").cast("long").alias("n_matches")))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, {quote(text)})" for name in sorted(TEMPLATES) for text in TEMPLATES[name])


_LOWERED = f"translate(coalesce({{}}, ''), '{UPPER_AZ}', '{LOWER_AZ}')"
_GRAMS = """SELECT DISTINCT {key}, list_extract(w, i) || ' ' || list_extract(w, i + 1) AS gram
  FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM (SELECT {key}, string_split(u, ' ') AS w FROM {of}))"""
SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS tid, license, trim(regexp_replace({_LOWERED.format('body')}, '[^a-z0-9]+', ' ', 'g')) AS u
  FROM (VALUES {_values()}) AS v(license, body)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_replace({_LOWERED.format('text')}, '[^a-z0-9\n]+', ' ', 'g') AS n FROM documents),
parts AS (
  SELECT DISTINCT rid, trim(regexp_replace(p, '[ \n]+', ' ', 'g')) AS u FROM (
    SELECT rid, unnest(list_concat(list_concat([n], regexp_split_to_array(n, '\n *\n[ \n]*')), string_split(n, chr(10)))) AS p FROM d)),
units AS (SELECT row_number() OVER () AS uid, rid, u FROM parts),
ug AS ({_GRAMS.format(key='uid', of='units')}),
tg AS ({_GRAMS.format(key='tid', of='t')}),
us AS (SELECT uid, count(*) AS n FROM ug GROUP BY uid),
ts AS (SELECT tid, count(*) AS n FROM tg GROUP BY tid),
both_in AS (SELECT uid, tid, count(*) AS n FROM ug JOIN tg USING (gram) GROUP BY uid, tid),
found AS (
  SELECT rid, license, both_in.n * 2.0::DOUBLE / (us.n + ts.n) AS dice
  FROM both_in JOIN us USING (uid) JOIN ts USING (tid) JOIN units USING (uid) JOIN t USING (tid)
  WHERE both_in.n * 2.0::DOUBLE / (us.n + ts.n) >= {THRESHOLD}::DOUBLE),
best AS (
  SELECT rid, license, dice FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, license) AS k FROM found) WHERE k = 1),
every AS (
  SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n FROM found GROUP BY rid)
SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(every.n, 0) AS n_matches
FROM d LEFT JOIN best USING (rid) LEFT JOIN every USING (rid)
"""
