"""Operator 1: license scans as an exact set-similarity join, with DataFrame functions only.

Text blocks are windows of the text's words whatever its line breaks: twice as long as the longest notice, a new one
every such length, so that a notice lies whole in one.  Templates are license notices; both are sets of words.  A
block meets a template if it has
at least ``CONTAINED`` of the template's words.  The join orders words by how many blocks of the corpus have them,
rarest first: a pair with an overlap of a shares a word among the first |T| - a + 1 of the template and the first
|B| - a + 1 of the block (prefix filter), a block needs a words (length filter), and from the places of the shared
word follows how large the overlap can still be (positional filter).  What is left is counted exactly.  Words of no
template can't be part of an overlap and are left out of the blocks at once.  A text is taken apart only if it has one
of the longest |T| - a + 1 words of some template: a block that lacks them all has fewer than a of its words.

Beside it the phrases of ``PHRASES`` are sought as consecutive words of the whole text.

Defined cases: a null text is empty; a text without words has no labels and null places.  Rows of one id are
separate rows.  The templates bound the order of words and the join's other side; both are broadcast.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents
from sightings.session import staged

CONTAINED = 0.9
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices as their publishers word them, with the label they stand for.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of every template."""
    return [(i, label, sorted(set(re.findall(_WORD, text.lower())))) for i, (label, text) in enumerate(templates)]


def block_step(templates: list[tuple[str, str]]) -> int:
    """Words of the longest notice, repeats included: a block begins every so many words and is twice as long."""
    return max(len(re.findall(_WORD, text.lower())) for _, text in templates)


def needs(templates: list[tuple[str, str]], contained: float = CONTAINED) -> dict[int, int]:
    """How many of a template's words a block must have."""
    return {i: max(1, math.ceil(contained * len(words) - 1e-9)) for i, _, words in template_words(templates)}


def telling_words(templates: list[tuple[str, str]], contained: float = CONTAINED) -> list[str]:
    """Words one of which every block has that meets a template."""
    least = needs(templates, contained)
    longest = [sorted(words, key=lambda w: (-len(w), w))[: len(words) - least[i] + 1] for i, _, words in template_words(templates)]
    return sorted({w for some in longest for w in some})


def _ascii_lower(text: Column) -> Column:
    """A-Z only.  lower() is faster and differs for ASCII results in the Kelvin sign alone, which is treated apart."""
    return F.when(F.contains(text, F.lit("K")), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in the array of words, from 0."""
    parts = phrase.split()

    def at(word: Column, i: Column) -> Column:
        hit = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.coalesce(F.get(words, i + k), F.lit("")) == part)
        return F.when(hit, i)

    return F.array_compact(F.transform(words, at))


def scanned(docs: DataFrame, templates: list[tuple[str, str]], contained: float = CONTAINED) -> DataFrame:
    """A row per document: row, doc_id, n_words, the places of each phrase, and its blocks as words of the templates.

    Blocks with fewer such words than any template needs are left out.  Written once, so that texts are read a single
    time.
    """
    text, low = F.coalesce(F.col("text"), F.lit("")), F.col("low")
    step, least = block_step(templates), min(needs(templates, contained).values())
    known = F.array(*[F.lit(w) for w in sorted({w for _, _, words in template_words(templates) for w in words})])
    telling = reduce(or_, [F.contains(low, F.lit(w)) for w in telling_words(templates, contained)])
    has_phrase = reduce(or_, [F.contains(low, F.lit(p.split()[-1])) for p in PHRASES])
    count = F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("bigint")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", count.alias("n_words"), _ascii_lower(text).alias("low"))
    # only texts with a telling word or a phrase's last word are taken apart
    rows = rows.select("row", "doc_id", "n_words", telling.alias("telling"), F.when(telling | has_phrase, F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))
    blocks = F.transform(starts, lambda begin: F.array_intersect(F.slice("words", begin + 1, 2 * step), known))
    blocks = F.when(F.col("telling"), F.filter(blocks, lambda b: F.size(b) >= least))
    places = [F.coalesce(_places(F.col("words"), p), F.array().cast("array<int>")).alias(f"places_{i}") for i, p in enumerate(PHRASES)]
    return staged(rows.select("row", "doc_id", "n_words", blocks.alias("blocks"), *places), "license-blocks")


def matches(rows: DataFrame, templates: list[tuple[str, str]], contained: float = CONTAINED) -> DataFrame:
    """(row, labels, score) of the rows with a block that meets a template; score is the greatest containment."""
    spark = rows.sparkSession
    parts = template_words(templates)
    need_of = needs(templates, contained)
    least = min(need_of.values())
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "words"))
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # words of the templates
    found = dict(counts)
    vocabulary = sorted({w for _, _, words in parts for w in words}, key=lambda w: (found.get(w, 0), w))
    order = {w: k for k, w in enumerate(vocabulary)}
    prefixes, whole = [], []
    for i, label, words in parts:
        ranks = sorted(order[w] for w in words)
        need = need_of[i]
        prefixes += [(rank, i, place, len(ranks), need) for place, rank in enumerate(ranks[: len(ranks) - need + 1])]
        whole.append((i, label, ranks))
    prefix = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int, t_place int, t_size int, need int"))
    lists = F.broadcast(spark.createDataFrame(whole, "template int, label string, t_ranks array<int>"))
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ranked = blocks.select("row", "block", F.array_sort(F.transform("words", lambda w: rank_of[w])).alias("ranks"))
    begun = F.slice("ranks", 1, F.size("ranks") - least + 1)
    opened = ranked.select("row", "block", "ranks", F.posexplode(begun).alias("b_place", "rank"))
    pairs = opened.join(prefix, "rank").where(
        (F.size("ranks") >= F.col("need"))
        & (F.col("b_place") <= F.size("ranks") - F.col("need"))
        & (1 + F.least(F.col("t_size") - F.col("t_place") - 1, F.size("ranks") - F.col("b_place") - 1) >= F.col("need"))
    )
    # a pair is counted at its first shared word only, so it needs no distinct
    checked = pairs.join(lists, "template").withColumn("common", F.array_intersect("ranks", "t_ranks"))
    met = checked.where((F.array_min("common") == F.col("rank")) & (F.size("common") >= F.col("need")))
    share = F.size("common") / F.col("t_size")
    return met.groupBy("row").agg(F.collect_set("label").alias("met"), F.max(share).alias("share"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Every document with its words, phrases and labels, as op1's contract names them."""
    rows = scanned(docs, templates, contained)
    found = matches(rows, templates, contained)
    places = F.concat(*[F.col(f"places_{i}") for i in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"places_{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    out = rows.drop("blocks").withColumn("places", places).withColumn("base", base)
    out = out.join(found, "row", "left").withColumn("met", F.coalesce("met", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "met")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    values = ", ".join(f"({i}, '{label}', [{', '.join(repr(w) for w in words)}])" for i, label, words in template_words(TEMPLATES))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    hits = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM w WHERE " + " AND ".join(f"words[i + {k + 1}] = '{part}'" for k, part in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    step = block_step(TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT r, {words} AS words FROM d),
w AS (SELECT r, words, unnest(range(len(words))) AS i FROM a),
hit AS ({hits}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hit GROUP BY r),
t(t, label, t_words) AS (VALUES {values}),
start AS (SELECT r, words, unnest(range(0, len(words), {step})) AS s FROM a),
block AS (SELECT r, list_distinct(words[s + 1 : s + {2 * step}]) AS words FROM start),
pair AS (SELECT r, label, len(list_intersect(words, t_words)) / len(t_words) AS share FROM block, t
  WHERE len(list_intersect(words, t_words)) >= ceil({CONTAINED} * len(t_words) - 1e-9)),
met AS (SELECT r, list(DISTINCT label) AS met, max(share) AS share FROM pair GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ','), '') AS labels,
  CASE WHEN base IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d JOIN a USING (r) LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""


OP1_SQL = _sql()
