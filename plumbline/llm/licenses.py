"""License notices in texts, by MinHash over overlapping windows; DataFrame functions only.

A template of n words is looked for in windows of n + s - 1 words, s apart, so
that one window holds any place where it stands whole. Windows and templates are
sets of five-word shingles (a template of fewer words has one shingle of them
all). Both are cut into MinHash bands, an equi-join on (band, value) retrieves the
templates that a window may hold, and exact containment of the template's
shingles decides (``CONTAINMENT``).

A window that contains a template to that share has a Jaccard similarity of at
least ``floor_similarity`` with it, from which the number of bands is derived so
that it is retrieved with a probability over 1 - ``MISS``. Shingles that occur in
no template of a window's size are dropped before hashing: they can't make a band
agree, only keep it from agreeing, so retrieval finds no less and most windows
vanish.

Templates are broadcast in blocks of ``BLOCK_WORDS``; each block is a pass.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 2
MISS = 1e-4
#: Words of the templates that are looked for, and broadcast, in one pass.
BLOCK_WORDS = 20_000

# Notices of well-known licenses, as published.
TEMPLATES = [
    ("MIT-short", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
]

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, "".join(c.lower() if c.isascii() else c for c in text)) if w]


def shingle_size(n: int) -> int:
    """Words in a shingle of a template of ``n`` words."""
    return min(SHINGLE, n)


def _shingles(words: list[str]) -> list[str]:
    size = shingle_size(len(words))
    return sorted({" ".join(words[i : i + size]) for i in range(len(words) - size + 1)})


def stride(n: int) -> int:
    """How far apart the windows for a template of ``n`` words are."""
    return max(1, n // 4)


def floor_similarity(n: int, distinct: int) -> float:
    """The least Jaccard similarity of a template and a window that contains it."""
    window = n + stride(n) - shingle_size(n)
    shared = math.ceil(CONTAINMENT * distinct)
    return shared / (distinct + window - shared)


def bands_needed(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(similarity, 0.999) ** ROWS)))


def _min_hashes(shingles: Column, bands: int) -> Column:
    """One value for each band of the shingles' MinHash."""
    least = lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k)))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *(least(b * ROWS + j) for j in range(ROWS))))


def template_blocks(templates: list[tuple[str, str]], block_words: int) -> list[list[tuple]]:
    """Rows (template, shingle size, width, stride, shingles) in blocks of so many
    words, a longer template alone. A template without a word is never found."""
    blocks, size = [[]], 0
    for name, text in templates:
        words = _words(text)
        if not words:
            continue
        if blocks[-1] and size + len(words) > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((name, shingle_size(len(words)), len(words) + stride(len(words)) - 1, stride(len(words)), _shingles(words)))
        size += len(words)
    return [b for b in blocks if b]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, _NOT_WORD), lambda w: w != "")


def found_licenses(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and what was found: row, template,
    containment (the best of any window) and first_word (where that window begins).

    Null and empty texts hold none; of equally good windows the first counts;
    repeated rows are scanned each alone; an empty table, or no templates, gives
    nothing found; other columns, whatever they are called, are not looked at.
    """
    blocks = template_blocks(TEMPLATES if templates is None else templates, block_words)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(blocks) != 1:  # rows keep their numbers from pass to pass
        texts = written(spark, texts, "texts")
    empty = spark.createDataFrame([], "row bigint, template string, containment double, first_word bigint")
    rows, found = texts.select("row", "doc_id"), empty
    for block in blocks:
        rows, more = _found(spark, texts, block)
        found = found.unionByName(more)
    return rows, found


_HITS = "array<struct<pos:int,size:int,shingle:string>>"


def _places(size: int, codes: list[int]) -> Column:
    """The shingles of ``size`` words whose hash is among ``codes``, with their positions."""
    at = F.sequence(F.lit(0), F.size("words") - size)
    known = F.filter(at, lambda i: F.xxhash64(*(F.get("code", i + k) for k in range(size))).isin(codes))
    spelt = F.transform(known, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.array_join(F.slice("words", i + 1, size), " ").alias("shingle")))
    return F.when(F.size("words") >= size, spelt)


def _found(spark: SparkSession, texts: DataFrame, block: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """One pass: the rows, and what was found of these templates."""
    bands = max(bands_needed(floor_similarity(w - s + 1, len(sh))) for _, _, w, s, sh in block)
    table = F.broadcast(spark.createDataFrame(block, "template string, size int, width int, stride int, shingles array<string>"))  # BLOCK_WORDS bounds it
    words = texts.select("row", "doc_id", words_of(F.col("text")).alias("words"))
    # Words are hashed once; a shingle is looked up by a hash of their hashes before it is spelt out.
    coded = words.withColumn("code", F.transform("words", lambda w: F.xxhash64(w)))
    hits = F.array().cast(_HITS)
    for size in sorted({b[1] for b in block}):
        known = sorted({tuple(sh.split(" ")) for _, k, _, _, shingles in block if k == size for sh in shingles})
        spelt = spark.createDataFrame([(list(k),) for k in known], "w array<string>")
        codes = [r["c"] for r in spelt.select(F.xxhash64(*(F.xxhash64(F.get("w", k)) for k in range(size))).alias("c")).collect()]
        hits = F.concat(hits, F.coalesce(_places(size, codes), F.array().cast(_HITS)))
    hits = written(spark, coded.select("row", "doc_id", hits.alias("hits")), "hits")
    # each shingle goes into the windows of every size that a template with it has
    sized = table.select("size", "width", "stride", F.explode("shingles").alias("shingle")).distinct()
    spots = hits.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(F.broadcast(sized), ["size", "shingle"])
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") + F.col("size") - F.col("width")) / F.col("stride"))).cast("int")
    spots = spots.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("stride")).cast("int"))))
    windows = spots.groupBy("row", "size", "width", "stride", "window").agg(F.collect_set("shingle").alias("have"))  # at most a window's shingles
    by_band = lambda df, shingles: df.select("*", F.posexplode(_min_hashes(F.col(shingles), bands)).alias("band", "value"))
    pairs = by_band(windows, "have").join(F.broadcast(by_band(table, "shingles")), ["size", "width", "stride", "band", "value"])
    share = F.size(F.array_intersect("have", "shingles")) / F.size("shingles")
    sure = pairs.select("row", "template", share.alias("containment"), (F.col("window") * F.col("stride")).cast("bigint").alias("first_word")).where(F.col("containment") >= CONTAINMENT)
    best = F.max_by(F.struct("containment", "first_word"), F.struct("containment", -F.col("first_word")))  # a window found by several bands counts once
    return hits.select("row", "doc_id"), sure.groupBy("row", "template").agg(best.alias("b")).select("row", "template", "b.*")


def license_report(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document doc_id, n_templates, templates (names, sorted, comma-joined) and best (containment).

    Null and empty texts hold none (best is 0); of equally good windows the first
    counts; repeated rows are scanned each alone; an empty table gives no rows;
    columns other than doc_id and text are not looked at.
    """
    rows, found = found_licenses(spark, docs, templates)
    by_row = found.groupBy("row").agg(F.sort_array(F.collect_set("template")).alias("names"), F.max("containment").alias("best"))
    out = rows.join(by_row, "row", "left")
    return out.select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_templates"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("templates"), F.coalesce("best", F.lit(0.0)).alias("best"))


def license_sql() -> str:
    """The same by comparing every window with every template."""
    quoted = ", ".join("('{}', {}, {}, ['{}'])".format(n, len(_words(t)) + stride(len(_words(t))) - 1, stride(len(_words(t))), "', '".join(_shingles(_words(t)))) for n, t in TEMPLATES)
    return rf"""
WITH templates(template, width, stride, shingles) AS (VALUES {quoted}),
parts AS (SELECT template, width, stride, len(shingles) AS n, unnest(shingles) AS shingle FROM templates),
words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spots AS (
  SELECT row, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS shingle FROM words, unnest(generate_series(1, len(w) - 4)) AS s(i) WHERE len(w) >= 5
), windows AS (
  SELECT row, template, n, k, count(DISTINCT shingle) AS c FROM spots JOIN parts USING (shingle),
    unnest(generate_series(CAST(greatest(0, ceil((pos + 5 - width) / stride)) AS BIGINT), CAST(floor(pos / stride) AS BIGINT))) AS s(k)
  GROUP BY row, template, n, k
), found AS (SELECT row, template, max(c / n) AS containment FROM windows WHERE c / n >= 0.8 GROUP BY row, template),
by_row AS (SELECT row, count(*) AS n_templates, string_agg(template, ',' ORDER BY template) AS templates, max(containment) AS best FROM found GROUP BY row)
SELECT doc_id, CAST(coalesce(n_templates, 0) AS BIGINT) AS n_templates, coalesce(templates, '') AS templates, coalesce(best, 0.0) AS best
FROM words LEFT JOIN by_row USING (row)
"""
