"""License scans by an exact set-similarity join, in DataFrame functions alone.

Templates are sets of words; text blocks are windows over a text's words, twice as long as
the templates of their class and starting every template's length, so that any passage as
long as a template lies within one block. A template is found where a block holds at least
``THRESHOLD`` percent of its words.

Words are ordered by how often the whole corpus has them, rarest first. Of a template with
``n`` words of which ``a`` must be found, one of the ``n - a + 1`` rarest must be in the
block (prefix), the block must have ``a`` words of the templates at all (length), and what
follows the first common word must suffice on both sides (position). What is left is
verified by intersecting the sets. A pair of block and template is kept where its first
common word matched, so no pair is met twice and none is gathered to drop repeats.

Texts are never shuffled: the templates' words travel with the tasks, and only the labels
found are joined with the documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The phrases of the base rules, and the wording of well-known licenses.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: Percent of a template's words that a block must hold.
THRESHOLD = 80
#: Templates of up to so many words share a window, which is twice as long.
CLASSES = (16, 64, 256)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a phrase or template."""
    return re.sub(_GAP, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def spaced(text: str | Column) -> Column:
    """The text's words, A-Z in lower case, with one space before and after each; a space alone if there are none."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    # of all letters but A-Z, these two alone become ASCII letters; what else is lower-cased here meets no word of a phrase or template
    odd = text.rlike("[Kİ]")
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), _GAP, " ")


def _split(s: Column) -> Column:
    return F.split(F.trim(s), " ")


def _count(s: Column) -> Column:
    return F.greatest(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("bigint")


def places(s: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another, as numbers of words."""
    words = words_of(phrase)
    last = F.greatest(_count(s) - len(words), F.lit(0)).cast("int")
    here = lambda text, i: (F.get(text, i) == words[0]) & (F.slice(text, i + 1, len(words)) == F.array(*map(F.lit, words)))
    # the split text is bound once
    inside = F.flatten(F.transform(F.array(_split(s)), lambda text: F.filter(F.sequence(F.lit(0), last), lambda i: here(text, i))))
    return F.when(s.contains(f" {' '.join(words)} "), inside).otherwise(F.array().cast("array<int>"))


@dataclass
class Template:
    label: str
    words: list[str]  # distinct, rarest first
    least: int  # so many must be found
    window: int

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.least + 1]


def ordered_templates(spaced_texts: DataFrame, templates: list[tuple[str, str]], threshold: int) -> tuple[list[str], list[Template]]:
    """All words of the templates, rarest in the column ``s`` first, and the templates in that order."""
    spark, texts = spaced_texts.sparkSession, [(label, words_of(t)) for label, t in templates]
    vocabulary = spark.createDataFrame([(w,) for w in sorted({w for _, t in texts for w in t})], "word string")
    found = spaced_texts.select(F.explode(_split(F.col("s"))).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").count()
    n = {r.word: r["count"] for r in found.collect()}  # at most the templates' words
    order = sorted({w for _, t in texts for w in t}, key=lambda w: (n.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    out = []
    for label, t in texts:
        if words := sorted(set(t), key=at.__getitem__):
            fits = [c for c in CLASSES if c >= len(t)]
            out.append(Template(label, words, -(-threshold * len(words) // 100), fits[0] if fits else len(t)))
    return order, out


def blocks(s: Column, windows: list[int]) -> Column:
    """``struct<window, words>`` of all windows of the given classes."""
    last = F.greatest(_count(s) - 1, F.lit(0)).cast("int")

    def of(words: Column, w: int) -> Column:
        return F.transform(F.sequence(F.lit(0), last, F.lit(w)), lambda i: F.struct(F.lit(w).alias("window"), F.slice(words, i + 1, 2 * w).alias("words")))

    # the split text is bound once
    return F.flatten(F.transform(F.array(_split(s)), lambda words: F.concat(*[of(words, w) for w in windows])))


def template_matches(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """``texts`` (a column ``s`` from :func:`spaced`, and any others) for each block and template whose containment is high enough: the others, ``label`` and ``containment``."""
    spark, others = texts.sparkSession, [c for c in texts.columns if c != "s"]
    order, known = ordered_templates(texts, templates, threshold)
    schema = "window int, word string, label string, t_words array<string>, least int, i int"
    if not known:
        return texts.select(*others, F.lit("").alias("label"), F.lit(0.0).alias("containment")).filter("false")
    entries = spark.createDataFrame([(t.window, w, t.label, t.words, t.least, i) for t in known for i, w in enumerate(t.prefix)], schema)
    first = "|".join(sorted({re.escape(w) for t in known for w in t.prefix}))
    held = texts.filter(F.col("s").rlike(f" (?:{first}) "))
    cut = held.select(*others, F.explode(blocks(F.col("s"), sorted({t.window for t in known}))).alias("block"))
    # in the order of the first array: rarest first
    sets = cut.select(*others, F.col("block.window").alias("window"), F.array_intersect(F.array(*map(F.lit, order)), F.col("block.words")).alias("b_words"))
    sets = sets.filter(F.size("b_words") >= min(t.least for t in known))
    places_ = sets.select(*others, "window", "b_words", F.posexplode("b_words").alias("j", "word"))
    pairs = places_.join(F.broadcast(entries), ["window", "word"])  # the templates' words
    n_b, n_t = F.size("b_words"), F.size("t_words")
    pairs = pairs.filter((n_b >= F.col("least")) & (F.col("j") <= n_b - F.col("least")))
    pairs = pairs.filter(1 + F.least(n_t - F.col("i") - 1, n_b - F.col("j") - 1) >= F.col("least"))
    pairs = pairs.withColumn("common", F.array_intersect("t_words", "b_words")).filter((F.element_at("common", 1) == F.col("word")) & (F.size("common") >= F.col("least")))
    return pairs.select(*others, "label", (F.size("common") / n_t).alias("containment"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, places, base_labels, labels, score``, one row for each row of ``docs``.

    ``places`` has a phrase's label and its starts, in words from 0, for each phrase;
    ``base_labels`` and ``labels`` are sorted arrays; ``score`` is 1 where a phrase stands,
    else the highest containment of a template found, else 0. Words are runs of 0-9, A-Z,
    a-z and all characters from U+0080 on; a null or empty text has none. Phrases and
    templates are ASCII. Rows that repeat are answered each, a null id stays null, and other
    columns are not read, whatever their names.
    """
    if not all(x.isascii() for pair in (*phrases, *templates) for x in pair):
        raise ValueError("phrases and templates must be ASCII")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"), spaced(text_col).alias("s"))
    found = template_matches(rows, templates, threshold).groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("of_text"))
    found = found.agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    s = F.col("s")
    base = rows.select("doc_id", "digest", _count(s).alias("n_words"), F.array(*[F.struct(F.lit(label).alias("label"), places(s, p).alias("starts")) for p, label in phrases]).cast("array<struct<label:string,starts:array<int>>>").alias("places"))
    base = base.withColumn("base_labels", F.array_sort(F.array_distinct(F.transform(F.filter("places", lambda p: F.size(p["starts"]) > 0), lambda p: p["label"]))))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_text")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select("doc_id", "n_words", "places", "base_labels", labels.alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.flatten(F.transform("places", lambda p: p["starts"]))
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _oracle() -> str:
    quoted = lambda t: t.replace("'", "''")
    rules = ", ".join(f"('{' '.join(words_of(p))}', '{label}')" for p, label in PHRASES)
    known = ", ".join(f"('{label}', '{quoted(' '.join(words_of(t)))}')" for label, t in TEMPLATES)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT string_split(col0, ' ') AS pw, col1 AS label FROM (VALUES {rules})),
b AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(ws)), lambda i: ws[i + 1 : i + len(pw)] = pw)) AS place FROM w, p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_labels FROM b GROUP BY doc_id),
t AS (
  SELECT col0 AS label, list_distinct(string_split(col1, ' ')) AS tw, len(string_split(col1, ' ')) AS n,
    CASE WHEN len(string_split(col1, ' ')) <= 16 THEN 16 WHEN len(string_split(col1, ' ')) <= 64 THEN 64 WHEN len(string_split(col1, ' ')) <= 256 THEN 256 ELSE len(string_split(col1, ' ')) END AS win
  FROM (VALUES {known})),
blocks AS (
  SELECT doc_id, win, list_distinct(ws[i * win + 1 : i * win + 2 * win]) AS bw
  FROM (SELECT doc_id, ws, win, unnest(range(0, (len(ws) + win - 1) // win)) AS i FROM w, (SELECT DISTINCT win FROM t))),
m AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(n_common / len(tw)) AS containment
  FROM (SELECT doc_id, label, tw, len(list_intersect(bw, tw)) AS n_common FROM blocks JOIN t USING (win))
  WHERE n_common * 100 >= {THRESHOLD} * len(tw) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base_labels, []::VARCHAR[]) || coalesce(more, []::VARCHAR[]))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ORACLE_SQL = _oracle()
