"""Licence scan by diagonal voting.

Every rolling k-gram of words of every text is joined by hash to its positions
in the templates (and kept only if the words agree too, so a hash can route but
not decide). A match votes for its diagonal, document position less template
position. Votes are summed by diagonal; neighbouring diagonals that go on
through the template (a few words put in or left out) are merged; a merged span
is accepted if the votes cover enough of the template and the span is not much
longer than it.

The template table is a fixed list of a few hundred rows and is broadcast; the
k-grams stream through that join without a shuffle. Only matches are shuffled,
by text digest, template and diagonal. Rows that share a text share its result.

Defined results: a null text has no words and no places; texts shorter than k
words match nothing; repeated rows get the same result each; an empty table
gives an empty table; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import fresh, whole_text

GRAM = 3
#: Words that may be put in or left out between two parts of a span.
SHIFT = 3
#: Templates of fewer words must match whole.
SHORT = 8
COVERAGE = 0.6

# Phrases that state a licence, and the licence's label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Further wordings of public licences.
WORDINGS = (
    ("the mit license", "mit"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("bsd 3 clause license", "bsd"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software"
     " and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the"
     " license at http www apache org licenses license 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted"
     " provided that the following conditions are met", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def lowered(text: Column) -> Column:
    """A-Z as a-z. ``lower`` also changes other letters, which no template
    holds; the two letters that it would turn into ASCII take the slow way."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike("[\\u0130\\u212A]"), F.translate(text, upper, small)).otherwise(F.lower(text))


def scan_words(text: Column) -> Column:
    bare = F.regexp_replace(lowered(text), "^" + SEPARATOR + "|" + SEPARATOR + "\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))


def grams(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(
        " ", *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def template_grams(spark: SparkSession, phrases, wordings, k: int) -> DataFrame:
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate((*phrases, *wordings))]
    t = spark.createDataFrame(rows, "template int, words string, label string, base boolean")
    words = F.split("words", " ")
    return t.select("template", "label", "base", F.size(words).alias("t_words"),
                    F.posexplode(grams(words, k)).alias("t_pos", "t_gram")).withColumn(
        "t_hash", F.xxhash64("t_gram"))


def spans(texts: DataFrame, phrases=PHRASES, wordings=WORDINGS, k: int = GRAM,
          shift: int = SHIFT, short: int = SHORT, coverage: float = COVERAGE) -> DataFrame:
    """(key, words) -> (key, label, base, start, end, score), one row an
    accepted span; ``start``/``end`` count words."""
    templates = template_grams(texts.sparkSession, phrases, wordings, k)
    own = texts.select("key", F.posexplode(grams(F.col("words"), k)).alias("pos", "gram"))
    votes = own.join(F.broadcast(templates), (F.xxhash64("gram") == F.col("t_hash"))
                     & (F.col("gram") == F.col("t_gram")))
    diagonals = votes.groupBy(
        "key", "template", "label", "base", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")
    ).agg(F.countDistinct("t_pos").alias("votes"), F.min("t_pos").alias("t_first"), F.max("t_pos").alias("t_last"))
    # neighbouring diagonals that shift little and match different parts belong together: words
    # put in move the later part to a greater diagonal, words left out to a lesser one
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    goes_on = (F.col("diagonal") - F.lag("diagonal").over(along) <= shift) & (
        (F.col("t_first") > F.lag("t_last").over(along)) | (F.col("t_last") < F.lag("t_first").over(along)))
    parts = diagonals.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn(
        "_span", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("key", "template", "label", "base", "t_words", "_span").agg(
        F.sum(F.col("votes") + (k - 1)).alias("covered"),
        F.min(F.col("diagonal") + F.col("t_first")).alias("start"),
        F.max(F.col("diagonal") + F.col("t_last") + k).alias("end"),
        F.max(F.col("votes") == F.col("t_words") - (k - 1)).alias("whole"))
    share = F.least(F.lit(1.0), F.col("covered") / F.col("t_words"))
    accepted = F.when(F.col("base") | (F.col("t_words") < short), F.col("whole")).otherwise(
        (share >= coverage) & (2 * (F.col("end") - F.col("start")) <= 3 * F.col("t_words")))
    return merged.where(accepted).select("key", "label", "base", "start", "end", share.alias("score"))


def scan(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` and ``score`` (the best span's share of its
    template, 0 without any)."""
    key = fresh("key")
    content = whole_text(text)
    digest = F.unhex(F.md5(content))
    # keys are texts, not rows: votes count template positions once, however many copies there are
    found = spans(docs.select(digest.alias("key"), scan_words(content).alias("words")), **options)
    base = lambda x: F.when(F.col("base"), x)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_text = found.groupBy(F.col("key").alias(key)).agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("long").alias("first_word"),
        F.max(base(F.col("start"))).cast("long").alias("last_word"),
        joined(base(F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.max("score").alias("score"))
    columns = [c for c in docs.columns if c not in RESULTS]
    out = docs.select(*columns, digest.alias(key), F.size(scan_words(content)).cast("long").alias("n_words"))
    out = out.join(by_text, key, "left").drop(key)
    return out.withColumns({
        "n_base": F.coalesce("n_base", F.lit(0)).cast("long"),
        "base_labels": F.coalesce("base_labels", F.lit("")), "labels": F.coalesce("labels", F.lit("")),
        "score": F.coalesce("score", F.lit(0.0))})
