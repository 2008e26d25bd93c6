"""License scans by diagonal voting, in DataFrame functions only.

A text is lower-cased (``A-Z``) and its words are runs of letters, digits and characters beyond ASCII.  Templates are
word sequences with a label.  A phrase (``whole`` template) counts where all of its words stand one after the other; a
notice counts where most of it stands, whatever was put in, left out or changed.

1. Every run of ``k`` words, k = 2 for phrases and ``GRAM`` for notices, is joined by its hash with the templates'
   runs (the words themselves are compared too, so no two runs are taken for each other).
2. Hits vote for their diagonal: place in the text less place in the template.
3. Diagonals of one template at most ``DRIFT`` apart are one span, as edits of the text shift what follows them.
4. A span is verified by the template's words that its hits cover: all of them for a phrase, a share of at least
   ``cover`` for a notice (``COVER``; short notices that differ by one word ask for all).  That share is its score.

Only hits are shuffled, and an id and a count for each text; the text itself isn't.  Null texts are empty, an empty text has no
words and no labels.  Rows that repeat an id are scanned one by one; equal rows give equal results.  An empty table
gives an empty result, and without templates nothing is found.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overgrid.llm.common import plain, text_of

PHRASE_GRAM, GRAM = 2, 4
#: Words by which the text may drift against a template within a span, and the least share of a notice that counts.
DRIFT, COVER = 8, 0.7

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    whole: bool = False
    #: The least share of a notice's words that counts; of a phrase, all must stand.
    cover: float = COVER


# The phrases of the query's contract and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# The usual notices of well-known licenses.
NOTICES = (
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("mit-notice", "Released under the MIT License", cover=1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", cover=1.0),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", cover=1.0),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", cover=1.0),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("lgpl-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", cover=1.0),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", cover=1.0),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", cover=1.0),
    Template("cc-notice", "This work is licensed under a Creative Commons Attribution International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)


def words_of(text: str | Column) -> Column:
    """The words of a text.  Only the ends of the split can be empty.

    ``lower`` is much faster than a translation of ``A-Z`` and differs beyond ASCII alone.  There it makes an ASCII
    letter of one character, the Kelvin sign, which is put out of the way first; a dotted capital I keeps its dot as a
    character of the word.  So words of ASCII are the same ones either way, and words are cut at the same places.
    """
    return F.array_remove(F.split(F.lower(F.replace(text_of(text), F.lit("\u212a"), F.lit("\u212b"))), BETWEEN_WORDS), "")


def template_grams(spark: SparkSession, templates: Sequence[Template], gram: int = GRAM) -> DataFrame:
    """``(k, h, gram, template, label, whole, length, least, j)``: every run of the templates' words; ``least`` must be covered.

    As many rows as the templates have words.  A notice of fewer than ``gram`` words is an error; so is a phrase of one.
    """
    rows = [(i, t.label, t.whole, 1.0 if t.whole else t.cover, t.text) for i, t in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, whole boolean, cover double, text string").withColumn("w", words_of("text"))
    k = F.when(F.col("whole"), F.lit(PHRASE_GRAM)).otherwise(F.lit(gram))
    sized = table.withColumn("k", k).withColumn("length", F.size("w"))
    checked = sized.withColumn("length", F.expr("CASE WHEN length < k THEN raise_error('a template is too short: ' || text) ELSE length END"))
    least = F.ceil(F.col("cover") * F.col("length")).alias("least")
    placed = checked.select("k", "w", "template", "label", "whole", "length", least, F.explode(F.expr("sequence(0, length - k)")).alias("j"))
    told = placed.withColumn("gram", F.expr("array_join(slice(w, j + 1, k), ' ')"))
    return told.select("k", F.xxhash64("gram").alias("h"), "gram", "template", "label", "whole", "length", "least", "j")


#: Characters of all templates up to which their runs are broadcast; there are fewer runs than characters.
BROADCAST_CHARS = 1_000_000


def held_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """``template_grams``, marked for a broadcast where the templates are small enough; else Spark shuffles."""
    grams = template_grams(spark, templates)
    return F.broadcast(grams) if sum(len(t.text) for t in templates) <= BROADCAST_CHARS else grams


def hits(docs: DataFrame, grams: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(doc_id, sig, i, template, label, whole, length, least, k, j)`` from ``(doc_id, text)``.

    ``i`` is a place in the text and ``j`` one in a template that hold the same run.  ``sig`` tells texts apart.
    """
    w = docs.select("doc_id", F.md5(text_of("text")).alias("sig"), words_of("text").alias("w"))
    runs = ", ".join(f"get(w, i + {d})" for d in range(1, gram))  # at the end of a text runs are shorter and meet nothing
    each = w.select("doc_id", "sig", F.posexplode(F.expr(f"transform(w, (x, i) -> concat_ws(' ', x, {runs}))")).alias("i", "run"))
    both = each.select(
        "doc_id", "sig", "i",
        F.explode(F.expr(f"array(named_struct('k', {PHRASE_GRAM}, 'gram', substring_index(run, ' ', {PHRASE_GRAM})), named_struct('k', {gram}, 'gram', run))")).alias("g"),
    ).select("doc_id", "sig", "i", F.col("g.k").alias("k"), F.col("g.gram").alias("gram"), F.xxhash64("g.gram").alias("h"))
    return both.join(grams, ["k", "h", "gram"]).select("doc_id", "sig", "i", "template", "label", "whole", "length", "least", "k", "j")


def spans_of(found: DataFrame, drift: int = DRIFT) -> DataFrame:
    """``(doc_id, sig, label, whole, first_word, last_word, covered, length)``: the verified spans of ``hits``."""
    text = ["doc_id", "sig", "template"]
    # Equal rows of a table give equal hits; once each is enough.
    votes = found.groupBy(*text, "label", "whole", "length", "least", "k", "i", "j").agg(F.lit(1).alias("_"))
    diagonal = votes.withColumn("diagonal", F.col("i") - F.col("j"))
    line = Window.partitionBy(*text).orderBy("diagonal", "i")
    # A phrase has one diagonal for each place where it stands; a notice's neighbours are merged.
    apart = F.expr(f"CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, sig, template ORDER BY diagonal, i) > CASE WHEN whole THEN 0 ELSE {drift} END THEN 1 ELSE 0 END")
    merged = diagonal.withColumn("_new", apart).withColumn("span", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    told = [*text, "span", "label", "whole", "length", "least", "k"]
    ends = merged.groupBy(*told, "j").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    # Words of the template that the runs cover: each run adds those that the run before it doesn't reach.
    gap = F.expr("j - lag(j) OVER (PARTITION BY doc_id, sig, template, span ORDER BY j)")
    runs = ends.withColumn("_adds", F.least(F.col("k"), F.coalesce(gap, F.col("k"))))
    spans = runs.groupBy(*told).agg(F.sum("_adds").alias("covered"), F.min("a").alias("first_word"), (F.max("b") + F.first("k") - 1).alias("last_word"))
    return spans.filter("covered >= least").select("doc_id", "sig", "label", "whole", "first_word", "last_word", "covered", "length")


def license_spans(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, label, whole, first_word, last_word, cover)``: where each text holds a template, words from 0."""
    found = hits(plain(docs, doc_id=doc_id, text=text), held_grams(docs.sparkSession, templates))
    return spans_of(found).select("doc_id", "label", "whole", "first_word", "last_word", (F.col("covered") / F.col("length")).alias("cover"))


def license_scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    The base columns tell of phrases, ``labels`` of all templates; ``score`` is the largest share of a template that
    the text holds, 1 with a phrase.
    """
    named = plain(docs, doc_id=doc_id, text=text)
    base = F.col("whole")
    told = spans_of(hits(named, held_grams(docs.sparkSession, templates))).groupBy("doc_id", "sig").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max(F.col("covered") / F.col("length")).alias("score"),
    )
    # Only ids, marks and word counts of the texts are shuffled.  A repeated row meets the one finding of its text.
    each = named.select("doc_id", F.md5(text_of("text")).alias("sig"), F.size(words_of("text")).alias("n_words"))
    same = each["doc_id"].eqNullSafe(told["doc_id"]) & (each["sig"] == told["sig"])
    out = each.join(told, same, "left").select(each["doc_id"], "n_words", *[told[c] for c in told.columns[2:]])
    joined_labels = {c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")) for c in ("base_labels", "labels")}
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        *[v.alias(c) for c, v in joined_labels.items()], F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_licenses(spark, sf: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf}/documents.parquet"))


def _oracle() -> str:
    """The same by window sums over all runs; templates as literals."""
    values = ", ".join(f"({i}, '{t.label}', {str(t.whole).lower()}, {1.0 if t.whole else t.cover}, '{t.text}')" for i, t in enumerate((*PHRASES, *NOTICES)))
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{}', '{}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(UPPER, LOWER)
    return f"""
WITH given(template, label, whole, cover, text) AS (VALUES {values}),
t AS (SELECT template, label, whole, cover, {words} AS w, CASE WHEN whole THEN {PHRASE_GRAM} ELSE {GRAM} END AS k FROM given),
tg AS (SELECT template, label, whole, len(w) AS length, cover, k, j::INT AS j, array_to_string(w[j + 1:j + k], ' ') AS gram FROM t, unnest(range(0, len(w) - k + 1)) u(j)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
g AS (SELECT r, k, i::INT AS i, array_to_string(w[i + 1:i + k], ' ') AS gram FROM d, (VALUES ({PHRASE_GRAM}), ({GRAM})) ks(k), unnest(range(0, len(w) - k + 1)) u(i)),
h AS (SELECT r, template, label, whole, length, cover, tg.k, i, j, i - j AS dg FROM g JOIN tg ON g.k = tg.k AND g.gram = tg.gram),
o AS (SELECT *, (dg - lag(dg) OVER (PARTITION BY r, template ORDER BY dg, i) > CASE WHEN whole THEN 0 ELSE {DRIFT} END)::INT AS nw FROM h),
s AS (SELECT *, sum(coalesce(nw, 0)) OVER (PARTITION BY r, template ORDER BY dg, i ROWS UNBOUNDED PRECEDING) AS span FROM o),
c AS (SELECT DISTINCT r, template, label, whole, length, cover, span, j + x AS word FROM s, unnest(range(0, k)) u(x)),
v AS (SELECT r, template, label, whole, length, cover, span, count(*) AS covered FROM c GROUP BY ALL HAVING count(*) >= ceil(cover * length)),
e AS (SELECT v.r, v.label, v.whole, v.covered / v.length AS share, min(s.i) AS first_word
  FROM v JOIN s ON s.r = v.r AND s.template = v.template AND s.span = v.span GROUP BY v.r, v.template, v.span, v.label, v.whole, share),
a AS (SELECT r, count(*) FILTER (whole) AS n_base, min(first_word) FILTER (whole) AS first_word, max(first_word) FILTER (whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM e GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a ON a.r = d.r
"""


ORACLE = _oracle()
