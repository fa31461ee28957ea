"""Best-fit packing planned on a length histogram.

Documents become token pieces of at most the capacity; only piece lengths are
counted. Best fit, longest first, then runs over the at most ``capacity``
counts on the driver instead of over documents: all sequences with the same
room are one group, and a length's count moves group by group. The resulting
slots say which ranks within a length go to which sequences and offsets; the
pieces are ranked within their length and take their slot by a join.

The histogram has at most ``capacity`` rows and the plan at most a few for each
pair of lengths, whatever the number of documents, so both may pass through the
driver and the plan may be broadcast. Ranks are counted in hashed buckets of a
length with the buckets' offsets added, so a length with most of the pieces is
spread over many tasks.

Defined results: a null text is an empty one; every document has at least its
end id, so at least one piece; documents longer than the capacity are cut into
full pieces after a shorter first one; repeated rows are separate documents;
null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm import tokenizing
from loanlens.llm.common import whole_text
from loanlens.session import materialize

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 50_000
PIECES = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, pattern: str | None = None, text: str = "text", doc_id: str = "doc_id",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        encoder = tokenizing.byte_bpe(tokenizer_path, pattern)
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"]
            for lo, hi in tokenizing.slices(texts):
                rows = []
                for at, own in enumerate(encoder.encode(texts[lo:hi]), lo):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    rows += [(at, k, s, n, zlib.crc32(own[s:s + n].tobytes()))
                             for k, (s, n) in enumerate(cut(len(own), capacity))]
                at, piece, start, length, crc = map(list, zip(*rows, strict=True))
                yield pd.DataFrame({"doc_id": ids.iloc[at].array, "piece": piece, "start": start,
                                    "length": length, "ids_crc32": crc})

    # ids cross as text: pandas has no long with nulls
    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), whole_text(text).alias("text"))
    return found.mapInPandas(run, f"doc_id string, {PIECES}").withColumn("doc_id", F.col("doc_id").cast(kind))


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first_rank, n, per_sequence, first_sequence, offset)``:
    the ``n`` pieces of ``length`` from ``first_rank`` on fill the sequences
    from ``first_sequence`` on, ``per_sequence`` each, from ``offset`` there.

    Longest length first; each takes the sequences with the least room that
    still fits, then new ones."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, n: int, space: int) -> None:
            """Fills up to ``n`` sequences with ``space`` left each."""
            nonlocal left, rank
            each = space // length
            for take, k in ((min(n, left // each), each), (1, left % each)):
                # the second round: what is left fills one more sequence in part
                if take and k and left and n:
                    k = min(k, left)
                    slots.append((length, rank, take * k, k, first, capacity - space))
                    room.setdefault(space - k * length, []).append((first, take))
                    first, n, left, rank = first + take, n - take, left - take * k, rank + take * k
            if n:
                room.setdefault(space, []).append((first, n))

        for space in range(length, capacity + 1):
            if not left:
                break
            for first, n in room.pop(space, []):
                if left:
                    fill(first, n, space)
                else:
                    room.setdefault(space, []).append((first, n))
        if left:
            new = -(-left // (capacity // length))
            first, sequences = sequences, sequences + new
            fill(first, new, capacity)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (read several times: pass a written table) with
    ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(
        plan_best_fit(counts, capacity),
        "length long, first_rank long, n long, per_sequence long, first_sequence long, first_offset long")
    buckets = spark.createDataFrame(
        [(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], "length long, _buckets long")
    p = pieces.join(F.broadcast(buckets), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_buckets")))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = p.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("_own", F.row_number().over(own) - 1).join(offsets, ["length", "_bucket"])
    p = p.withColumn("_rank", F.col("_before") + F.col("_own"))
    plan = plan.withColumnRenamed("length", "_length")
    p = p.join(F.broadcast(plan), (p["length"] == plan["_length"]) & (F.col("_rank") >= F.col("first_rank"))
               & (F.col("_rank") < F.col("first_rank") + F.col("n")))
    nth = F.col("_rank") - F.col("first_rank")
    return p.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Tokenizes once, writes the piece lengths, plans and places."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity=capacity, **columns), "pieces")
    return pack(pieces, capacity)
