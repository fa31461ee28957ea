"""Connected components of an edge table by alternating large and small stars.

Each round relinks every node to the smallest neighbour known, from both sides,
until nothing changes; the rounds grow with the logarithm of the longest path.
A node's smallest neighbour is found by a partial aggregate and joined back, so
a node with a great many neighbours is never gathered in one place. Each round
is checkpointed, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.session import ensure_checkpoint_dir

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b), a > b, each once. Large star: every greater neighbour of
    a node goes to the least one near it; small star: every node's smaller
    neighbours, and it, go to the least of them."""
    if large:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        found = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        found = (edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))))
    return found.where(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the edge set does."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any orderable type -> (node, component), the component being
    its least node; nodes without an edge do not occur."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        e = _star(_star(e, large=True), large=False).checkpoint()
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select("b", "b").distinct())
