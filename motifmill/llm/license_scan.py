"""Scan for licences by diagonal voting.  DataFrame functions only.

Every two words in a row of a document are looked up, by their hash, among those of the templates.  A hit at
word p of the document and word q of a template votes for the diagonal p - q.  A phrase stands where all its votes
meet on one diagonal.  Of longer notices the diagonals close to each other are put together, as words may
have been put in or left out, and a span counts if it holds enough of the notice.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from motifmill.llm.tables import keyed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public licence notices and the lines by which they are named, with labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer"),
    ("bsd", "Released under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("lgpl", "GNU Lesser General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words with at most so many letters make no seed with each other: they are everywhere.
COMMON = 3
#: Diagonals at most so far apart belong together; share of a notice's seeds that a span needs.
GAP, COVER = 4, 0.6


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def seeds() -> list[tuple]:
    """One row per seed: (template, label, phrase, seeds, length, place, word, next word)."""
    rows = []
    for t, (label, text, phrase) in enumerate([*((v, k, True) for k, v in PHRASES.items()), *((k, v, False) for k, v in NOTICES)]):
        words = _split(text)
        places = [q for q in range(len(words) - 1) if phrase or max(map(len, words[q: q + 2])) > COMMON]
        rows += [(t, label, phrase, len(places), len(words), q, words[q], words[q + 1]) for q in places]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    """The seeds by the hash of their words; a few hundred rows, fixed in the code."""
    found = spark.createDataFrame(seeds(), "t int, label string, phrase boolean, seeds int, length int, q int, x string, y string")
    return found.select("t", "label", "phrase", "seeds", "length", "q", F.xxhash64("x", "y").alias("gram"))


def words(text: Column) -> Column:
    """The words of a text, with A-Z in lower case and other letters as they are."""
    folded = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def scan(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, spans) with spans an array of (label, phrase, start, stop, cover) in order of start.

    ``docs`` has doc_id and text.  Null texts are empty.  Rows that repeat doc_id and text give one row; rows that repeat
    only doc_id stay apart.
    """
    spark = docs.sparkSession
    cut = keyed(docs).select("key", "doc_id", words(F.col("text")).alias("w"))
    grams = F.when(F.size("w") > 1, F.transform(
        F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))))
    hits = (cut.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(grams).alias("p", "gram"))
            .join(F.broadcast(_templates(spark)), "gram", "left")
            .filter(F.col("t").isNotNull() | (F.coalesce("p", F.lit(0)) == 0)))
    diagonals = hits.groupBy("key", "doc_id", "n_words", "t", "label", "phrase", "seeds", "length", (F.col("p") - F.col("q")).alias("d")).agg(
        F.count("t").alias("votes"), F.min("p").alias("first"), (F.max("p") + 1).alias("last"))
    by = Window.partitionBy("key", "t").orderBy("d")
    apart = F.col("phrase") | (F.col("d") - F.lag("d").over(by) > GAP) | F.lag("d").over(by).isNull()
    runs = diagonals.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    spans = runs.groupBy("key", "doc_id", "n_words", "t", "label", "phrase", "seeds", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("start"), F.max("last").alias("stop"), F.max("length").alias("length"))
    # A span has to hold enough of the notice, and not much besides.
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("seeds"))
    good = F.when(F.col("phrase"), F.col("votes") == F.col("seeds")).otherwise(
        (cover >= COVER) & (F.col("votes") >= 2) & (F.col("stop") - F.col("start") < 2 * F.col("length")))
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "label", "phrase", cover.alias("cover"))
    return spans.groupBy("key", "doc_id", "n_words").agg(F.sort_array(F.collect_list(F.when(good, span))).alias("spans"))


def summary(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Base places are those of ``PHRASES``; ``labels`` has those of the notices too; ``score`` is the best cover.
    """
    found = scan(docs)
    base = F.filter("spans", lambda s: s["phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))
