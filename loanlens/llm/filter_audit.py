"""Audit of how a corpus's filters interact, over every order of applying them.

A document is judged once: one bit a filter it fails. Documents then count only
as mask cells, at most 2**k for each part of the corpus with k filters, with
their weights (documents, good ones, toxic ones). Each cell folds across the
array of all k! orders: ``transform`` over orders, ``aggregate`` over an order's
steps with "already removed" as the state, giving k * k! weighted structs (600
for five filters). The structs of a part's cells are merged by sums element by
element.

One filter, repetition, is no property of a row alone: a text fails if a
smaller id in the whole table holds the same text. Rows meet by digest, as
counts: rows of one text, part and label kind are one cell before any row
travels to its text's smallest id, so a text that a third of the rows share is
a handful of rows there. A row whose id is null is never later than another.

Defined results: a null text is an empty one (0 words, so it fails A); a null
part is the empty string; null or absent labels count as neither good nor
toxic, several labels of one id count once if any says so; rows repeating an id
are documents of their own, and as none has a smaller id than the other they
both stay; texts of any length are judged whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import whole_text, words_of

FILTERS = "ABCDE"
REPEATED = "E"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which the filters on a text alone remove it."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]++", "")).cast("long")
        > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(letter: str, letters: str = FILTERS) -> int:
    return 1 << letters.index(letter)


def judged(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(id, part, digest, mask): ``mask`` has the bits of the filters on texts."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       whole_text(text).alias("t"))
    rows = rows.withColumn("w", words_of(F.col("t")))
    fails = text_failures(F.col("t"), F.col("w"))
    mask = sum((F.when(v, F.lit(bit(k))).otherwise(F.lit(0)) for k, v in fails.items()), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def label_kinds(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row an id: whether any of its labels is good, or toxic."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("string").alias("meets")).agg(
        said("quality").alias("good"), said("toxic").alias("toxic"))


def mask_cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``judged`` rows, repetition included."""
    counted = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    # null ids meet no label; their digests keep them apart
    meets = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.hex("digest")))
    labelled = counted.withColumn("meets", meets).join(labels, "meets", "left").drop("meets")
    kinds = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    # within a cell of one text ids are distinct: the least one carries its number of rows
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    cells = labelled.select("id", "part", "digest", "mask", "n", *kinds).groupBy(
        "digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    at_first = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    stays = F.col("no_id") + at_first
    sides = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), stays.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(bit(REPEATED))).alias("mask"), (F.col("n") - stays).alias("n"))))
    cells = cells.withColumn("first", first).select("part", "good", "toxic", sides.alias("cell"))
    weight = lambda c: F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0))
    return cells.where(F.col("cell.n") > 0).groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum("cell.n").alias("n"), weight("good").alias("good"), weight("toxic").alias("toxic"))


def cell_structs(orders: list[str], letters: str = FILTERS) -> Column:
    """A cell's weighted structs, one for each order and step in turn."""
    kinds = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"

    def step(state: Column, own: Column) -> Column:
        fails, gone = F.col("mask").bitwiseAND(own) != 0, state["gone"]
        if_ = lambda cond, weight: F.when(cond, F.col(weight)).otherwise(F.lit(0)).cast("long")
        values = (if_(~gone & ~fails, "n"), if_(~gone & fails, "n"), if_(gone & fails, "n"),
                  if_(F.col("mask") == own, "n"), if_(~gone & fails, "good"), if_(~gone & fails, "toxic"))
        made = F.struct(*[v.alias(m) for v, m in zip(values, MEASURES, strict=True)])
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(made)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kinds).alias("steps"))
    every = F.lit([[bit(x, letters) for x in o] for o in orders])
    return F.flatten(F.transform(every, lambda o: F.aggregate(o, start, step, lambda state: state["steps"])))


def fold_orders(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, measures..., shapley) for all orders."""
    orders = ["".join(o) for o in itertools.permutations(letters)]
    k = len(letters)
    folded = cells.select("part", F.posexplode(cell_structs(orders, letters)).alias("at", "x"))
    merged = folded.groupBy("part", "at").agg(*[F.sum(f"x.{m}").alias(m) for m in MEASURES])
    order = F.get(F.lit(orders), F.floor(F.col("at") / k).cast("int"))
    merged = merged.select("part", order.alias("filter_order"), (F.col("at") % k + 1).cast("int").alias("step"), *MEASURES)
    own = Window.partitionBy("part", F.substr("filter_order", F.col("step"), F.lit(1)))
    # k! rows of each part and filter, whatever the number of documents
    return merged.withColumn("shapley", F.sum("removed").over(own))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``fold_orders`` of a corpus: k * k! rows for each part."""
    return fold_orders(mask_cells(judged(docs, **columns), label_kinds(labels, columns.get("doc_id", "doc_id"))))


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
earliest AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
kinds AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(texts.t, '[^A-Z]', '', 'g')) > 10 * length(texts.t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(texts.t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN texts.doc_id > least THEN 16 ELSE 0 END AS mask
    FROM texts JOIN earliest ON texts.t = earliest.t LEFT JOIN kinds ON texts.doc_id = kinds.doc_id),
cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
orders AS (
    SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
    FROM letters p, letters q, letters r, letters s, letters u
    WHERE p.b + q.b + r.b + s.b + u.b = 31 AND (p.b | q.b | r.b | s.b | u.b) = 31),
steps AS (
    SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS letter, bits[i] AS own,
           CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i) AS numbers),
report AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN (mask & (earlier | own)) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN (mask & earlier) <> 0 AND (mask & own) <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN (mask & earlier) = 0 AND (mask & own) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM report
"""
