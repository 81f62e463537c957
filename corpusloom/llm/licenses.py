"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined to the positions at which license templates have
the same hash. A hit of text position i and template position j votes for the diagonal i - j: the words of
a copied notice all vote for one. Votes are added up per text, template and diagonal, neighbouring diagonals
(a word more or less inside the notice) are merged, and a span is accepted if it covers enough of the
template's words within a span of about the template's length.

The template side is a fixed table of a few hundred k-grams (``TEMPLATES``), so it is broadcast; texts are never
shuffled, only votes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

K = 3
#: A merged group spans at most so many neighbouring diagonals apart.
NEIGHBOURS = 3
COVERED = 0.8
STRETCH = 1.3
#: Phrases that count in any place (fixed values).
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Notices as they stand in files (fixed values), in lower-case words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def normal(text: Column) -> Column:
    """Lower-case words joined by single spaces."""
    return F.trim(F.regexp_replace(common.lower_ascii(common.text_or_empty(text)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def _words(n: Column) -> Column:
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def _grams(words: Column) -> Column:
    last = F.size(words) - K
    h = F.xxhash64
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: h(*[F.get(words, i + j) for j in range(K)]))).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, label, size (words) and j for every k-gram of every template."""
    rows = spark.createDataFrame([(i, label, body) for i, (label, body) in enumerate(TEMPLATES)], "template int, label string, body string")
    words = F.split("body", " ")
    return rows.select("template", "label", F.size(words).alias("size"), F.posexplode(_grams(words)).alias("j", "gram"))


def places(norm: Column, words: Column, phrase: str) -> Column:
    """Word positions at which a phrase starts; texts without it are not cut into words for it."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    same = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts])
    return F.when(F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.lit(f" {phrase} ")), F.filter(starts, same)).otherwise(F.array().cast("array<int>"))


def spans(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, h, template, label, first, last (word positions), covered (share of the template) of accepted spans.

    ``docs``: doc_id, h (hash of the text), text. Rows that repeat id and text count once.
    """
    cut = docs.select("doc_id", "h", _words(normal(F.col("text"))).alias("w")).select("doc_id", "h", F.posexplode(_grams(F.col("w"))).alias("i", "gram"))
    hits = cut.join(F.broadcast(template_grams(spark)), "gram")
    # one row per diagonal: votes, which template words they cover (one bit each, folded before the shuffle), ends
    hits = hits.select("doc_id", "h", "template", "label", "size", (F.col("i") - F.col("j")).alias("diagonal"), "i", "j")
    lines = hits.groupBy("doc_id", "h", "template", "label", "size", "diagonal").agg(
        F.min("i").alias("first"), F.max(F.col("i") + K - 1).alias("last"), F.expr("bit_or(shiftleft(1L, j))").alias("seen"))
    # a diagonal with a single vote far from all others goes; neighbours within NEIGHBOURS join
    w = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOURS) | F.lag("diagonal").over(w).isNull()
    grouped = lines.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    merged = grouped.groupBy("doc_id", "h", "template", "label", "size", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("seen").alias("seen"))
    # words of the template under an accepted k-gram
    words = F.col("seen")
    for o in range(1, K):
        words = words.bitwiseOR(F.shiftleft("seen", o))
    share = F.bit_count(words) / F.col("size")
    return (merged.withColumn("covered", F.least(share, F.lit(1.0)))
            .where((F.col("covered") >= COVERED) & (F.col("last") - F.col("first") + 1 <= F.ceil(F.col("size") * STRETCH) + NEIGHBOURS)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null text counts as empty (no words, no labels, score 0). score is the best cover of a template, 1 where a
    base phrase stands. Labels are distinct, sorted and joined by commas.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), common.text_or_empty(text).alias("text")).withColumn("h", F.xxhash64("text"))
    base = rows.select("doc_id", "h", normal(F.col("text")).alias("n"))
    base = base.withColumn("w", _words(F.col("n")))
    found = {label: places(F.col("n"), F.col("w"), phrase) for label, phrase in PHRASES.items()}
    base = base.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), *[c.alias(f"at_{i}") for i, c in enumerate(found.values())])
    at = [F.col(f"at_{i}") for i in range(len(PHRASES))]
    labels = F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, found)]), lambda x: x.isNotNull())
    base = base.select("doc_id", "h", "n_words", sum((F.size(a) for a in at[1:]), F.size(at[0])).cast("long").alias("n_base"),
                       F.least(*[F.array_min(a) for a in at]).cast("long").alias("first_word"), F.greatest(*[F.array_max(a) for a in at]).cast("long").alias("last_word"),
                       labels.alias("base"))
    voted = spans(rows, spark).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("first", "last", "covered", "label")).alias("s"))
    # of overlapping spans (notices that share most of their words) the better covered one stays
    better = lambda o, x: (o["covered"] > x["covered"]) & (o["first"] <= x["last"]) & (x["first"] <= o["last"])
    voted = voted.withColumn("s", F.filter("s", lambda x: ~F.exists("s", lambda o: better(o, x))))
    voted = voted.select("_d", "_h", F.col("s.label").alias("own"), F.array_max("s.covered").alias("best"))
    both = base.join(voted, base["doc_id"].eqNullSafe(voted["_d"]) & (base["h"] == voted["_h"]), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", none))), ",").alias("labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op10_license_scan(spark, folder: str) -> DataFrame:
    return scan(common.table(spark, folder, "documents"))
