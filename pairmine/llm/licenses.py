"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the k-gram positions of the
license templates. A hit at word ``pos`` for template position ``tpos`` votes for the
offset diagonal ``pos - tpos``; an unbroken occurrence puts all its votes on one diagonal,
and inserted or lost words move the rest to a neighbouring one. Votes are counted per
(text, template, diagonal), neighbouring diagonals are merged, and a merged span is
accepted when enough distinct template positions were found in a span that is not
stretched, and among them those that tell the licence from its neighbours (``REQUIRED``):
a notice that differs from another licence's in one word has nearly all its grams. A phrase (an exact template) counts once per diagonal that holds all its votes.
DataFrame functions only.

The template table is the caller's fixed list (a few hundred rows), so it is broadcast.
A text's rows never leave its task before they are joined and filtered to hits.

Edge cases: null text is empty; a text shorter than k words has no hit; every row of the
input gets one row (repeated rows too, they are told apart by a row number); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2                 # words per gram
SLACK = 3             # diagonals this close are one alignment
MIN_VOTE_SHARE = 0.2  # of a template's grams, for a diagonal to count
MIN_COVERAGE = 0.7    # of a template's grams, for a span to be accepted
MAX_STRETCH = 2.0     # span words against template words

# Phrases of the contract (label, phrase), each place counts.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Sentences by which public licences are commonly declared.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, "
            "are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

# Common licences whose notices are a word away from those above or from each other.
NEAR_TEMPLATES = [
    ("agpl", "This work is licensed under the GNU Affero General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "Licensed under CC0 1.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
]

# Grams that a span needs besides its coverage: (part of a template, its grams). Grams
# joined by | are alternatives; a template takes the first entry whose part it holds.
REQUIRED = [
    ("Apache License, Version 2.0", ["version 2|2 0"]),
    ("Mozilla Public License, v. 2.0", ["v 2|2 0"]),
    ("GNU General", ["gnu general"]),
    ("GNU Affero", ["affero general"]),
    ("GNU Lesser", ["lesser general"]),
    ("BY-NC-ND", ["by nc", "nc nd"]),
    ("BY-NC-SA", ["by nc", "nc sa"]),
    ("BY-NC", ["by nc", "nc 4"]),
    ("BY-ND", ["by nd"]),
    ("BY-SA", ["by sa"]),
    ("CC BY", ["by 4"]),
    ("CC0", ["under cc0"]),
    ("NonCommercial-NoDerivatives", ["attribution noncommercial", "noncommercial noderivatives"]),
    ("NonCommercial-ShareAlike", ["attribution noncommercial", "noncommercial sharealike"]),
    ("NonCommercial", ["attribution noncommercial", "noncommercial 4"]),
    ("NoDerivatives", ["attribution noderivatives"]),
    ("ShareAlike", ["attribution sharealike"]),
    ("Attribution", ["attribution 4"]),
]

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # what separates words once A-Z is lower case


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def required_positions(text: str, k: int) -> list[list[int]]:
    """Template positions of the required grams: of each list one must be found."""
    words = template_words(text)
    at = {}
    for i in range(len(words) - k + 1):
        at.setdefault(" ".join(words[i:i + 2]), []).append(i)
    needs = next((grams for part, grams in REQUIRED if part in text), [])
    return [p for p in ([i for g in need.split("|") for i in at.get(g, [])] for need in needs) if p]


def template_needs(spark: SparkSession, phrases, templates, k: int) -> DataFrame:
    """(t, need) of every template that is not a phrase."""
    rows = [(t, required_positions(text, k)) for t, (_, text) in enumerate(templates, len(phrases))]
    return spark.createDataFrame(rows, "t int, need array<array<int>>")


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(t, label, exact, t_words, grams, tpos, gram): one row per template position."""
    rows = []
    for t, (exact, label, text) in enumerate([(True, *p) for p in phrases] + [(False, *p) for p in templates]):
        words = template_words(text)
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {text!r}")
        for i in range(len(words) - k + 1):
            rows.append((t, label, exact, len(words), len(words) - k + 1, i, words[i:i + k]))
    return spark.createDataFrame(rows, "t int, label string, exact boolean, t_words int, grams int, "
                                       "tpos int, gram array<string>")


def lower_ascii(col):
    """A-Z to a-z. Of the other letters only the Kelvin sign has a lower case in ASCII;
    it is swapped for a letter that has not."""
    return F.lower(F.replace(col, F.lit("K"), F.lit("Å")))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES + NEAR_TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans),
    one row per row of ``docs``; spans: array of (label, start, end) in words, end exclusive."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"),
                       F.filter(F.split(text, _GAP, -1), lambda x: x != "").alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    # A row of its own for each gram, with its k words only: linear in the text.
    parts = ", ".join(f"get(words, i + {j})" for j in range(k))
    rolling = F.when(F.col("n_words") >= k, F.expr(f"transform(sequence(0, n_words - {k}), i -> array({parts}))"))
    rows = rows.select("rid", "doc_id", "n_words", F.posexplode_outer(rolling).alias("pos", "own"))
    gram_hash = lambda c: F.xxhash64(*[F.get(c, F.lit(j)) for j in range(k)])
    rows = rows.withColumn("hash", gram_hash("own"))

    grams = template_grams(docs.sparkSession, phrases, templates, k)
    joined = rows.join(F.broadcast(grams.withColumn("hash", gram_hash("gram"))), "hash", "left")
    hit = F.col("t").isNotNull() & (F.col("own") == F.col("gram"))
    # Hits, and one row per text to carry it through.
    kept = joined.filter(hit | F.col("pos").isNull() | (F.col("pos") == 0)).select(
        "rid", "doc_id", "n_words",
        *[F.when(hit, F.col(c)).alias(c) for c in ("t", "label", "exact", "t_words", "grams", "tpos", "pos")])
    votes = (kept.groupBy("rid", "t", (F.col("pos") - F.col("tpos")).alias("diag"))
             .agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "exact", "t_words", "grams")],
                  F.collect_set("tpos").alias("found"), F.count("tpos").alias("votes"),
                  F.min("pos").alias("first"), F.max("pos").alias("last")))

    # Neighbouring diagonals of one template whose spans touch become one alignment.
    # Weak diagonals only carry their text on.
    strong = F.col("votes") >= F.col("grams") * F.lit(MIN_VOTE_SHARE)
    votes = votes.withColumns({c: F.when(strong, F.col(c)) for c in ("t", "exact", "found")})
    order = Window.partitionBy("rid", "t").orderBy("diag")
    apart = (F.col("diag") - F.lag("diag").over(order) > SLACK) | F.col("exact") | F.col("exact").isNull()
    cluster = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(order)
    spans = (votes.withColumn("cluster", cluster).groupBy("rid", "t", "cluster")
             .agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "exact", "t_words", "grams")],
                  F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
                  F.min("first").alias("first"), (F.max("last") + k).alias("end"), F.min("diag").alias("diag")))
    spans = (spans.withColumn("n_found", F.size("found"))
             .join(F.broadcast(template_needs(docs.sparkSession, phrases, templates, k)), "t", "left"))
    coverage = F.col("n_found") / F.col("grams")
    told_apart = F.forall("need", lambda p: F.arrays_overlap(p, F.col("found")))
    straight = F.col("end") - F.col("first") <= F.col("t_words") * F.lit(MAX_STRETCH)
    base = F.col("exact") & (F.col("n_found") == F.col("grams"))
    accepted = F.when(F.col("exact"), base).otherwise((coverage >= MIN_COVERAGE) & straight & told_apart)
    spans = spans.withColumns({"base": F.coalesce(base, F.lit(False)), "accepted": F.coalesce(accepted, F.lit(False)),
                               "coverage": F.when(F.col("exact") & ~base, 0.0).when(straight, coverage)})
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("diag"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("diag"))).cast("long").alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("accepted")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("first", "end", "label")))).alias("spans"),
    ).drop("rid")
