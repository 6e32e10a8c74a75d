"""License scan: labels by phrases, and an exact set-similarity join of text blocks with
license templates.

A block is a line. A template matches a block when the block holds at least ``threshold`` of
the template's distinct words (containment). The join is exact: the words of the templates are
ordered by how many documents of the corpus hold them, rarest first; a block that meets the
threshold must hold one of a template's first |T| - ceil(threshold |T|) + 1 words in that order
(prefix filter), must have ceil(threshold |T|) words at least (length filter), and after its
first common word at place i the words left must still be enough (positional filter). Pairs
that pass are counted on whole sets. Templates are a short list handed in by the caller, so
their words, not the corpus, decide the size of everything that is broadcast.

Words: runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. Null text is empty:
no words, no labels, score 0. Rows are answered one by one, repeated or not. Texts of any
length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.llm.common import ascii_lower, cut, documents

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache",
           "cc by": "cc-by", "mit license": "mit"}

# Openings of public license notices, as they are written into files.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy "
                 "of this software and associated documentation files",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without "
                 "modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
}
THRESHOLD = 0.9


def word_set(text: str) -> list[str]:
    """Distinct words of a template, by the rule of the module."""
    import re
    return sorted(set(re.findall(WORD, text.lower())))


def holds(lower: Column, word: str) -> Column:
    """Whether the word stands in the text; the pattern runs only where the letters occur."""
    return lower.contains(word) & lower.rlike(
        rf"(^|[\x00-\x2F\x3A-\x60\x7B-\x7F]){word}($|[\x00-\x2F\x3A-\x60\x7B-\x7F])")


def word_order(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Place of each word in the global order: by documents that hold it, then by spelling."""
    lower = documents(docs).select(ascii_lower(F.col("text")).alias("lower"))
    row = lower.agg(*[F.coalesce(F.sum(holds(F.col("lower"), w).cast("long")), F.lit(0)).alias(
        f"w{i}") for i, w in enumerate(words)]).first()
    return {w: k for k, (_, w) in enumerate(sorted((row[i], w) for i, w in enumerate(words)))}


def template_sides(templates: dict[str, str], order: dict[str, int], threshold: float):
    """(name, size, words needed, words) of every template, and (name, word, place) of the words
    in its prefix."""
    sides, prefixes = [], []
    for name, text in sorted(templates.items()):
        words = sorted(word_set(text), key=order.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        if not words:
            continue
        sides.append((name, len(words), need, words))
        prefixes += [(name, w, i) for i, w in enumerate(words[:len(words) - need + 1])]
    return sides, prefixes


def holds_any(lower: Column, prefixes: list[tuple]) -> Column:
    """Whether letters of a prefix word stand in the text."""
    rare = sorted({w for _, w, _ in prefixes})
    return F.greatest(*[lower.contains(w) for w in rare], F.lit(False), F.lit(False))


def similar_blocks(blocks: DataFrame, templates: dict[str, str], order: dict[str, int],
                   threshold: float = THRESHOLD) -> DataFrame:
    """``blocks``: doc_id, uid, lower. Returns uid, template, containment of every block that
    meets the threshold for a template."""
    spark = blocks.sparkSession
    sides, prefixes = template_sides(templates, order, threshold)
    side = spark.createDataFrame(sides, "template string, t_size int, need int, t_words array<string>")
    prefix = spark.createDataFrame(prefixes, "p_template string, word string, t_place int")
    vocabulary = F.array(*[F.lit(w) for w in sorted(order, key=order.get)])

    # words of the block that templates know, in the global order (array_intersect keeps the
    # order of its first argument)
    tokens = blocks.where(holds_any(F.col("lower"), prefixes)
                          ).select("uid", F.array_distinct(F.split("lower", SEPARATORS)).alias("b"))
    tokens = tokens.select("uid", F.size(F.array_remove("b", "")).alias("b_size"),
                           F.array_intersect(vocabulary, "b").alias("b_words"))
    first = tokens.select("*", F.posexplode("b_words").alias("b_place", "word"))
    pairs = first.join(F.broadcast(prefix), "word")     # few rows: the templates' own words
    pairs = pairs.join(F.broadcast(side), F.col("p_template") == F.col("template"))
    pairs = pairs.where(F.col("b_size") >= F.col("need"))
    # before place t_place the template has that many words, which the block may hold or not
    left = F.least(F.col("t_size") - F.col("t_place"), F.size("b_words") - F.col("b_place"))
    pairs = pairs.where(left + F.least("t_place", "b_place") >= F.col("need"))
    shared = F.size(F.array_intersect("t_words", "b_words"))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("need")).groupBy(
        "uid", "template").agg(F.max(F.col("shared") / F.col("t_size")).alias("containment"))


def phrase_places(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first start, last start) of a phrase in text of the form '  word  word  '."""
    words = phrase.split(" ")
    pattern = " " + "  ".join(words) + " "
    parts = F.split(text, pattern)
    count_words = lambda c: F.regexp_count(c, F.lit(r"[^ ]+"))
    n = F.size(parts) - 1
    first = F.when(n > 0, count_words(F.element_at(parts, 1)))
    last = F.when(n > 0, count_words(text) - count_words(F.element_at(parts, -1)) - len(words))
    return n, first, last


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (largest containment, 1 where a phrase stands)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    words = sorted({w for t in templates.values() for w in word_set(t)})
    order = word_order(docs, words)
    lower = documents(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                                   ascii_lower(F.col("text")).alias("lower"))
    keys = [p.split(" ") for p in phrases]
    likely = F.lit(False)
    for k in keys:
        here = F.lit(True)
        for w in k:
            here = here & F.col("lower").contains(w)
        likely = likely | here
    spaced = F.when(likely, F.concat(F.lit("  "), F.regexp_replace("lower", SEPARATORS, "  "),
                                     F.lit("  ")))
    # the lines that can match go along with the row they are of, so ids come from one scan
    prefixes = template_sides(templates, order, threshold)[1]
    near = F.when(holds_any(F.col("lower"), prefixes), F.filter(
        F.split("lower", "\n"), lambda line: holds_any(line, prefixes)))
    base = lower.select("uid", "doc_id", F.regexp_count("lower", F.lit(WORD)).cast("long").alias(
        "n_words"), spaced.alias("spaced"), near.alias("near"))
    places = [phrase_places(F.col("spaced"), p) for p in phrases]
    base = base.select(
        "uid", "doc_id", "n_words", "near",
        sum((F.coalesce(n, F.lit(0)) for n, _, _ in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[f for _, f, _ in places], F.lit(None).cast("int"), F.lit(None).cast("int")).cast("long").alias("first_word"),
        F.greatest(*[x for _, _, x in places], F.lit(None).cast("int"), F.lit(None).cast("int")).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(
            places, phrases.values())]))).alias("base"))
    base = cut(base)
    blocks = base.select("uid", F.explode("near").alias("lower"))
    found = similar_blocks(blocks, templates, order, threshold).groupBy("uid").agg(
        F.collect_set("template").alias("more"), F.max("containment").alias("best"))
    join = lambda c: F.concat_ws(",", c)
    both = base.join(found, "uid", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       join("base").alias("base_labels"), join(every).alias("labels"),
                       score.alias("score"))
