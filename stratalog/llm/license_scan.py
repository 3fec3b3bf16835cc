"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: License notices and the opening words of license texts, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
)

WIDTH = 5  # words of a shingle
PRIME = (1 << 31) - 1
#: Windows are up to 2.5 times as long as the template, so a match of 0.75 has a Jaccard similarity above 0.27.
#: Bands of one row: the chance that all of them miss such a pair is below 0.73^48, or 3 in 10 million.
BANDS = 48
GROWTH = 1.25  # from one window length to the next


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and the signs inside version numbers and names; other signs separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*)"), F.lit(1))


def hashed_shingles(words: Column) -> Column:
    """Hashes below 2^31 - 1 of all runs of WIDTH words; empty if there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(words) - WIDTH + 1)
    one = lambda i: F.pmod(F.xxhash64(F.concat_ws(" ", F.slice(words, i, WIDTH))), F.lit(PRIME))
    return F.when(F.size(words) >= WIDTH, F.transform(starts, one)).otherwise(F.array().cast("array<bigint>"))


def bands_of(hashes: Column, bands: int = BANDS) -> Column:
    """For each band the least value of its permutation over the shingles, marked with the band's number."""
    a = [(1_103_515_245 * (i + 1) + 12_345) % (PRIME - 1) + 1 for i in range(bands)]
    b = [(69_069 * (i + 1) + 1) % PRIME for i in range(bands)]

    def least(i: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: (h * a[i] + b[i]) % PRIME)) + (i << 31)

    return F.array(*map(least, range(bands)))


def templates(spark: SparkSession, listed=TEMPLATES) -> DataFrame:
    """One row per template of at least WIDTH words: template, license, hashes, n, length class ``span``."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(listed)], "template int, license string, notice string")
    rows = rows.withColumn("words", words_of(F.col("notice"))).withColumn("hashes", F.array_distinct(hashed_shingles(F.col("words"))))
    rows = rows.where(F.size("hashes") > 0)
    # shingles of the template, rounded up to a power of GROWTH: few window lengths serve all templates
    return rows.select("template", "license", "words", "hashes", F.size("hashes").alias("n"), F.ceil(F.pow(F.lit(GROWTH), F.ceil(F.log(GROWTH, F.size("hashes")) - 1e-9))).cast("int").alias("span"))


def anchors(listed: list[list[str]], share: float = 0.25) -> list[str]:
    """Words such that over ``share`` of each template's shingles hold one: no match of 1 - share can lack them all.

    Greedy over words of five letters or more, the longest that add shingles to most templates first.
    """
    runs = [[set(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)] for words in listed]
    chosen: list[str] = []
    covered = lambda t: sum(any(w in s for w in chosen) for s in t)
    while open_ := [t for t in runs if covered(t) <= share * len(t)]:
        gain = {}
        for t in open_:
            for w in {w for s in t if not any(c in s for c in chosen) for w in s}:
                g = gain.setdefault(w, [0, 0])
                g[0] += 1
        best = max(gain, key=lambda w: (gain[w][0] * (len(w) >= 5), len(w), w))
        chosen.append(best)
    return sorted(chosen)


def scan(docs: DataFrame, listed=TEMPLATES, least: float = 0.75, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses (names, sorted, comma-joined), matches, best (containment).

    A template matches where one window of twice its length holds at least ``least`` of its distinct five-word shingles.
    Windows overlap by half, so each passage as long as the template lies whole in one.  Only windows around an anchor
    word are formed; every template needs one (see ``anchors``), so no match is lost.  Windows that share a band with a
    template are verified exactly, once for each window and template.  Rows that share doc_id and text share their
    matches.  A null or short text, or one without a match, has an empty list, 0 and 0.0.  Notices that differ in a version only
    may all match.
    """
    spark = docs.sparkSession
    known = templates(spark, listed)
    notices = known.select("words", "span").collect()  # the templates, a parameter
    if not notices:
        return docs.select("doc_id", F.lit("").alias("licenses"), F.lit(0).cast("long").alias("matches"), F.lit(0.0).alias("best"))
    spans = sorted({r["span"] for r in notices})
    found = anchors([list(r["words"]) for r in notices])
    # rows without any anchor are done at once, before their words are split; the test reads whole texts
    texts = docs.select("doc_id", text_of("text").alias("text"))
    some = texts.select("doc_id", F.xxhash64("text").alias("of"), "text").where(F.lower("text").rlike("|".join(w.replace(".", r"\.") for w in found)))
    some = some.select("doc_id", "of", words_of(F.col("text")).alias("words"))
    listed_anchors = F.array(*map(F.lit, found))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(listed_anchors, w), i).otherwise(F.lit(-1))), lambda i: i >= 0)

    def windows_of(span: int) -> Column:
        """All windows of one length with a shingle that holds the anchor at word p; they start at multiples of span."""
        block = lambda word: F.floor(word / span).cast("int")
        one = lambda p: F.transform(F.sequence(F.greatest(block(p - (WIDTH - 1)) - 1, F.lit(0)), block(p)), lambda k: F.struct(F.lit(span).alias("span"), (k * span).alias("from")))
        return F.flatten(F.transform(at, one))

    cut = some.withColumn("window", F.explode(F.array_distinct(F.flatten(F.array(*map(windows_of, spans))))))
    part = F.slice("words", F.col("window.from") + 1, F.col("window.span") * 2 + WIDTH - 1)
    cut = cut.select("doc_id", "of", F.col("window.span").alias("span"), F.col("window.from").alias("start"), part.alias("part")).where(F.size("part") >= WIDTH)
    scratch = Scratch(spark, "license-scan")
    cut = scratch.write(cut.select("doc_id", "of", "span", "start", F.array_distinct(hashed_shingles(F.col("part"))).alias("window")), "windows")
    probes = cut.select("*", F.explode(F.array_distinct(bands_of(F.col("window"), bands))).alias("band"))
    index = known.select("template", "span", F.explode(bands_of(F.col("hashes"), bands)).alias("band"))
    # the templates are a fixed list, one row for each of their bands
    hits = probes.join(F.broadcast(index), ["span", "band"]).groupBy("doc_id", "of", "span", "start", "template").agg(F.first("window").alias("window"))
    hits = hits.join(F.broadcast(known.select("template", "license", "hashes", "n")), "template")
    inside = F.size(F.array_intersect("window", "hashes")) / F.col("n")
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("of").alias("hit_of"), "license", "template", inside.alias("share")).where(F.col("share") >= least)
    hits = hits.groupBy("hit_id", "hit_of").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.size(F.collect_set("template")).alias("matches"), F.max("share").alias("best"))
    hits = scratch.write(hits, "hits")
    out = texts.select("doc_id", F.xxhash64("text").alias("of")).join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("of") == F.col("hit_of")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.coalesce("best", F.lit(0.0)).alias("best"))


def load_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of every .txt file of a folder of license texts, named by SPDX identifier; for ``scan(listed=...)``."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), "value")
    return sorted((r["name"], r["value"]) for r in files.collect())
