"""License scans: phrases of known licenses, and an exact set-similarity join of text blocks with notices.

A block is a paragraph (blank lines cut), or a window of `window` words, half of it new, where
the paragraph is longer, so every run of up to half a window stands whole in some block.  A block
meets a template if it holds at least `threshold` of the template's distinct words (containment).

The join: words that some template has are counted over the documents of the whole table and ordered
from rare to common.  The smallest common word of a meeting pair stands among the first
|template| - need + 1 words of the template and the first |block| - need + 1 words of the block
(only template words count), so blocks join the templates' prefixes on such words alone; the length of
the block and the places of the word on both sides then bound the overlap, and what is left is
verified by the sets themselves.  No meeting pair is lost.  All of it is DataFrame expressions.

Templates are a parameter; their words (at most `MOST_WORDS`, checked) are the only thing that is
broadcast.  Documents are joined with nothing else: one shuffle of thin rows, keyed by row.

Defined results: a null or empty text has no word, no block and no label (labels '', places null,
score 0); an equal text under several rows gives each its own row; places overlap freely; ties between
templates give all their labels; an empty table gives an empty result; further columns are ignored,
whatever their names; texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BLANK_LINES = "\\n[\\x20\\x09-\\x0D]*\\n"
MOST_WORDS = 100_000

# Phrases that name a license
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(text), BETWEEN_WORDS, -1), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """The words of each paragraph; those of a null text are none."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), BLANK_LINES, -1), words)


def blocks(paras: Column, window: int) -> Column:
    half = window // 2
    return F.flatten(F.transform(paras, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - half - 1, F.lit(0)), F.lit(half)), lambda i: F.slice(p, i + 1, window))))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("long")


def with_phrases(texts: DataFrame) -> DataFrame:
    """`texts` (paras) with n_words, n_base, first_word, last_word and base (the distinct labels).

    The words, each with a space on either side, are split before every phrase: the pieces are one more
    than the places, and spaces count words.
    """
    d = texts.withColumn("joined", F.concat(F.lit(" "), F.array_join(F.flatten("paras"), " "), F.lit(" ")))
    d = d.withColumn("pieces", F.split("joined", " (?=" + "|".join(f"{p} " for p in PHRASES) + ")", -1))
    n_words = F.when(F.col("joined") == "  ", F.lit(0).cast("long")).otherwise(_spaces(F.col("joined")) - 1)
    some = F.size("pieces") > 1
    return d.select(
        "*",
        n_words.alias("n_words"),
        (F.size("pieces") - 1).cast("long").alias("n_base"),
        F.when(some, _spaces(F.get("pieces", F.lit(0)))).alias("first_word"),
        F.when(some, n_words - _spaces(F.element_at("pieces", -1))).alias("last_word"),
        F.array_compact(F.array(*(F.when(F.col("joined").contains(f" {p} "), F.lit(label)) for p, label in PHRASES.items()))).alias("base"),
    ).drop("joined", "pieces")


def template_words(spark: SparkSession, templates: list[tuple[str, str]], tenths: int) -> DataFrame:
    """template, label, tokens (distinct words) and need: the least overlap of a meeting block."""
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, label string, text string")
    t = t.select("template", "label", F.array_distinct(words(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
    return t.withColumn("need", F.ceil(F.size("tokens") * tenths / 10).cast("int"))


def rare_first(texts: DataFrame, templates: DataFrame) -> list[str]:
    """The templates' words, from those in the fewest documents to those in the most."""
    vocabulary = sorted(r.w for r in templates.select(F.explode("tokens").alias("w")).distinct().limit(MOST_WORDS + 1).collect())
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} distinct words")
    known = F.split(F.lit(" ".join(vocabulary)), " ")
    held = texts.select(F.explode(F.array_intersect(known, F.flatten("paras"))).alias("w"))
    counts = {r.w: r["count"] for r in held.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefixes(templates: DataFrame, order: list[str]) -> DataFrame:
    """token, template, t_place, t_tokens, need, label: what the blocks join."""
    by_rank = F.split(F.lit(" ".join(order)), " ")
    t = templates.select("template", "label", "need", F.array_intersect(by_rank, "tokens").alias("t_tokens"))
    t = t.select("*", F.posexplode("t_tokens").alias("t_place", "token"))
    return t.where(F.col("t_place") <= F.size("t_tokens") - F.col("need"))


def matches(texts: DataFrame, templates: list[tuple[str, str]], tenths: int, window: int) -> DataFrame:
    """`texts` (paras and further columns) with block, template, label and containment of each meeting
    pair; texts without any stand once, with nulls."""
    spark = texts.sparkSession
    t = template_words(spark, templates, tenths)
    order = rare_first(texts, t)
    if not order:
        return texts.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("block", "int"), ("template", "int"), ("label", "string"), ("containment", "double"))))
    index = prefixes(t, order)
    by_rank = F.split(F.lit(" ".join(order)), " ")
    least = t.agg(F.min("need")).first()[0]
    prefix_words = F.split(F.lit(" ".join(sorted(r.token for r in index.select("token").distinct().collect()))), " ")
    worth = F.arrays_overlap(F.flatten("paras"), prefix_words)
    held = F.transform(blocks(F.col("paras"), window), lambda b: F.array_intersect(by_rank, b))
    found = texts.withColumn("b_all", F.when(worth, held))
    entries = F.flatten(F.transform("b_all", lambda b, i: F.transform(
        F.filter(F.transform(F.array_intersect(b, prefix_words), lambda w: F.struct(w.alias("token"), (F.array_position(b, w) - 1).cast("int").alias("b_place"))), lambda e: (F.size(b) >= least) & (e["b_place"] <= F.size(b) - least)),
        lambda e: F.struct(i.alias("block"), e["token"].alias("b_token"), e["b_place"].alias("b_place"), b.alias("b_tokens")),
    )))
    rows = found.withColumn("e", F.explode_outer(entries)).select(*texts.columns, "e.*")
    n_b, n_t = F.size("b_tokens"), F.size("t_tokens")
    most = F.least("b_place", "t_place") + 1 + F.least(n_b - F.col("b_place"), n_t - F.col("t_place")) - 1
    on = (F.col("b_token") == F.col("token")) & (n_b >= F.col("need")) & (F.col("b_place") <= n_b - F.col("need")) & (most >= F.col("need"))
    met = rows.join(F.broadcast(index), on, "left")
    overlap = F.size(F.array_intersect("b_tokens", "t_tokens"))
    true = overlap >= F.col("need")
    return met.select(*texts.columns, *(F.when(true, x).alias(a) for x, a in ((F.col("block"), "block"), (F.col("template"), "template"), (F.col("label"), "label"), (overlap / n_t, "containment"))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, tenths: int = 9, window: int = 256) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `tenths`: the containment threshold.  score: 1 where a phrase stands, else the greatest containment of
    a met template, else 0.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", paragraphs(F.col("text")).alias("paras"))
    met = matches(with_phrases(texts), templates, tenths, window)
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    one = met.select(*keys, "label", "containment").groupBy(*keys).agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return one.select(*keys[1:-1], joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", "found")).alias("labels"), score.alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_sql_words = lambda x: f"regexp_extract_all(translate({x}, '{common.UPPER}', '{common.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# blocks x templates by plain set intersection; phrases by looking at every word
OP12_SQL = f"""
WITH p(phrase, label) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in PHRASES.items())}),
t AS (
  SELECT label, list_distinct({_sql_words("x")}) AS tokens
  FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) v(label, x)),
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, {_sql_words("coalesce(text, '')")} AS words FROM documents),
hits AS (
  SELECT row_no, p.label, i FROM d, p, unnest(range(len(words))) u(i)
  WHERE words[i + 1] = split_part(p.phrase, ' ', 1) AND array_to_string(words[i + 1 : i + len(string_split(p.phrase, ' '))], ' ') = p.phrase),
base AS (SELECT row_no, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY row_no),
paras AS (SELECT row_no, {_sql_words("para")} AS words FROM (SELECT row_no, unnest(string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n')) AS para FROM d)),
blocks AS (SELECT row_no, words[i + 1 : i + 256] AS block FROM paras, unnest(range(0, greatest(1, len(words) - 128), 128)) u(i)),
met AS (
  SELECT row_no, label, len(list_intersect(tokens, block)) AS overlap, len(tokens) AS n FROM blocks, t
  WHERE 10 * len(list_intersect(tokens, block)) >= 9 * len(tokens)),
best AS (SELECT row_no, list(DISTINCT label) AS found, max(overlap / n) AS best FROM met GROUP BY row_no)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (row_no) LEFT JOIN best USING (row_no)
"""
