"""Operator 5: licence scan by diagonal voting.

Every rolling pair of words of every document is hashed and joined to the positions of the same pair in the templates, a
fixed table of a few hundred rows, which alone is broadcast. A match votes for the diagonal (place in the document less
place in the template). Votes are counted by diagonal before anything is shuffled; diagonals next to each other, which an
inserted or missing word makes, are merged; a merged span counts if it covers enough of the template. Each vote is
verified: the join compares the words, not just their hash.

Short phrases are templates that must be covered in full, on one diagonal. Only DataFrame expressions are used.

Defined results: null and empty texts have no words, no places, empty label lists and score 0. Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from phenoline.llm.common import lower_ascii

# Phrases that must stand word for word, with their label (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Longer passages of public licence texts, with the method's labels (fixed values).
PASSAGES = (
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)

# Before lower-casing, capitals are letters too.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = 2
BITS = 62  # places of a template that one number marks


def words_of(text: Column) -> Column:
    """Words as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def templates(spark: SparkSession, phrases, passages) -> DataFrame:
    """Rows (template, exact, label, pairs, place, first, second, gram) of every pair of neighbouring words."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *passages]):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text}")
        rows += [(number, number < len(phrases), label, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    schema = "template int, exact boolean, label string, pairs int, place int, first string, second string"
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64(F.xxhash64("first"), F.xxhash64("second")))


def votes(docs: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, doc_id, n_words, template, exact, label, pairs, diagonal, part, seen, low, high), and one with nulls for the pairs without votes.

    ``seen`` marks the places of the template that a diagonal has votes for, ``BITS`` of them to a ``part``. ``row`` tells input rows apart; it is made
    once and only travels with its row.
    """
    words = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("words", words_of(F.col(text)))
    # Each pair takes its two words along, and nothing as long as the text.
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    placed = words.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(pairs).alias("at", "pair"))
    first, second = lower_ascii(F.col("pair.a")), lower_ascii(F.col("pair.b"))
    placed = placed.select("row", "doc_id", "n_words", "at", first.alias("a"), second.alias("b"))
    gram = F.when(F.col("b").isNotNull(), F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    same = (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    matched = placed.withColumn("gram", gram).join(F.broadcast(table.withColumnRenamed("gram", "t_gram")), (F.col("gram") == F.col("t_gram")) & same, "left")
    part = F.coalesce(F.expr(f"place div {BITS}"), F.lit(0)).alias("part")
    return matched.groupBy("row", "doc_id", "n_words", "template", "exact", "label", "pairs", (F.col("at") - F.col("place")).alias("diagonal"), part).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.col("place") % BITS, F.lit(0)))).alias("seen"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
    )


def scan(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, least: float = 0.7, text: str = "text") -> DataFrame:
    """Per input row (doc_id and a text): n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists what the passages and phrases cover: label, first word, last word, share of the template.
    """
    table = templates(docs.sparkSession, phrases, passages)
    found = votes(docs.select("doc_id", text), table, text)
    # A passage's diagonal with a lone vote is noise, unless the passage has no more pairs than that.
    alone = F.sum(F.bit_count("seen")).over(Window.partitionBy("row", "template", "diagonal")) < 2
    found = found.withColumn("alone", alone).withColumn("template", F.when(F.col("exact") | ~F.col("alone"), F.col("template")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(order) <= F.when(F.col("exact"), 0).otherwise(GAP)
    span_of = ("row", "doc_id", "n_words", "template", "exact", "label", "pairs", "span")
    merged = (
        found.withColumn("starts", F.when(near, 0).otherwise(1))
        .withColumn("span", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*span_of, "part")
        .agg(F.bit_or(F.when(F.col("template").isNotNull(), F.col("seen"))).alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"))
        .groupBy(*span_of)
        .agg(F.sum(F.bit_count("seen")).alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("share", F.when(F.col("template").isNotNull(), F.col("covered") / F.col("pairs")))
    )
    holds = F.col("template").isNotNull() & F.when(F.col("exact"), F.col("share") == 1).otherwise(F.col("share") >= least)
    base = holds & F.col("exact")
    listed = lambda hit: F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("label")))), ",")
    span = F.struct("label", F.col("low").alias("first_word"), (F.col("high") + 1).alias("last_word"), "share")
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(holds).alias("labels"),
        F.coalesce(F.max(F.when(holds, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(holds, span))).alias("spans"),
    ).withColumn("n_words", F.col("n_words").cast("long")).drop("row")
