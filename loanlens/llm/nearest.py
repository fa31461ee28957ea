"""Exact nearest neighbours by a block matrix join.

Unit vectors are taken as int8 with a scale and the length of what the
rounding lost. A tile is one block of queries against one block of candidates,
worked through in pieces of fixed size: the int8 product gives every cosine
with an error bound (the products are sums of integers below 2**24, exact in
float32), the k-th largest lower bound is the bar of the first piece and the
k-th best score so far that of the others, and only pairs whose upper bound
reaches it are computed in double precision from the original vectors. Heaps
merge the tiles of a query.

Rows are numbered in a written table. Blocks of queries are packed into one row
each and copied once to every candidate block number, which are known from the
count; candidates are copied to every query block, which is one up to
``QUERY_BLOCK`` queries. Both sides meet by cogroup, so a task holds the
vectors of one tile and never a batch of tiles. Vectors travel as they are
stored, codes are made where they are used. A vector that many rows share
spreads over the blocks like any other rows.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; every other row is a candidate
of its own, also where it repeats an id or has none (its vec_id is then null),
and only a query's own row is left out; rows repeating a query's id are queries
of their own; a null id is no query unless ``is_query`` says so; vectors are
compared with those of the same length only; equal scores go to the smaller id,
null last; fewer candidates than k give fewer rows; an empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.session import materialize

#: Rows of a block: as many blocks as ``LEAST_BLOCK`` gives up to ``LEAST_BLOCKS``, then larger ones.
BLOCK = 65536
LEAST_BLOCK = 4096
LEAST_BLOCKS = 24
QUERY_BLOCK = 65536
#: Queries and candidates of a tile that are compared at once.
PIECE = (1024, 4096)
#: Widest int8 product summed exactly in float32.
EXACT_DIMS = 2 ** 24 // (127 * 127)
SLACK = 1e-9
PACKED = "block long, dim int, rows binary, ids binary, named binary, vectors binary"
FOUND = "query_row long, query_id long, vec_row long, vec_id long, score double"
FOUND_TYPES = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_row", pa.int64()),
                         ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and lost length of the unit vectors of ``x``."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # neither squares nor their sum can leave the range of doubles
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    lost = np.sqrt(((unit - scale * codes) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale[:, 0], lost


def _matrix(v, dim: int) -> np.ndarray:
    """A column of vectors of ``dim`` numbers, as they are stored."""
    return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    packed = {"block": key[0].as_py(), "dim": key[1].as_py()}
    parts = {"rows": rows["row"].to_numpy(), "ids": rows["id"].to_numpy(),
             "named": rows["named"].to_numpy().astype(bool), "vectors": _matrix(rows["v"], packed["dim"])}
    types = [("block", pa.int64()), ("dim", pa.int32()), *[(c, pa.binary()) for c in parts]]
    return pa.Table.from_pylist([packed | {c: x.tobytes() for c, x in parts.items()}], pa.schema(types))


def numbered(vectors: DataFrame, blocks: int) -> DataFrame:
    """(row, id, v) -> (block, dim, row, id, named, v): about even blocks, every id a number."""
    return vectors.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"), "row",
                          F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "v")


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """(row, id, v) -> about ``blocks`` blocks of vectors of one dimension, a row each."""
    return numbered(vectors, blocks).groupBy("block", "dim").applyInArrow(_pack, PACKED)


class Side:
    """Rows of a tile: numbers, ids, whether the id is one, vectors and their codes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.named, self.x = rows, ids, named, x
        self.codes, self.scale, self.lost = quantise(x.astype(np.float64))

    @classmethod
    def of_block(cls, r: dict) -> Side:
        rows, ids = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
        wide = len(r["vectors"]) // (len(rows) * r["dim"])
        x = np.frombuffer(r["vectors"], np.float32 if wide == 4 else np.float64).reshape(len(rows), -1)
        return cls(rows, ids, np.frombuffer(r["named"], bool), x)

    @classmethod
    def of_rows(cls, t: pa.Table, dim: int) -> Side:
        return cls(t["row"].to_numpy(), t["id"].to_numpy(), t["named"].to_numpy().astype(bool), _matrix(t["v"], dim))

    def part(self, a: int, b: int) -> Side:
        cut = Side.__new__(Side)
        for name, value in vars(self).items():
            setattr(cut, name, value[a:b])
        return cut


def approximate(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a tile from int8, and how far they can be off."""
    dots = sum((q.codes[:, k:k + EXACT_DIMS].astype(np.float32)
                @ c.codes[:, k:k + EXACT_DIMS].astype(np.float32).T).astype(np.float64)
               for k in range(0, q.codes.shape[1], EXACT_DIMS))
    off = q.lost[:, None] + (1 + q.lost)[:, None] * c.lost[None, :] + SLACK
    return dots * q.scale[:, None] * c.scale[None, :], off


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; equal rows give equal results."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _piece(q: Side, c: Side, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a piece whose cosine can be among the ``k`` best."""
    near, off = approximate(q, c)
    own = q.rows[:, None] == c.rows[None, :]
    if not np.isfinite(bar).all() and near.shape[1] > k:
        low = np.where(own, -np.inf, near - off)
        bar = np.maximum(bar, np.partition(low, -k, axis=1)[:, -k])
    near += off
    return np.nonzero((near >= bar[:, None]) & ~own)


def tile_best(q: Side, c: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``q``, place in ``c``, score) of each query's ``k`` best of a
    tile, one piece of the candidates after the other."""
    bar = np.full(len(q.ids), -np.inf)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(c.ids), PIECE[1]):
        qi, ci = _piece(q, c.part(start, start + PIECE[1]), k, bar)
        if not len(qi):
            continue
        ci = ci + start
        score = np.concatenate([cosine(q.x[a].astype(np.float64), c.x[b].astype(np.float64)) for a, b in zip(
            *(np.array_split(x, -(-len(qi) // 2 ** 17)) for x in (qi, ci)), strict=True)])
        qi, ci, score = (np.concatenate(x) for x in zip(best, (qi, ci, score), strict=True))
        order = np.lexsort((c.rows[ci], c.ids[ci], ~c.named[ci], -score, qi))
        qi, ci, score = qi[order], ci[order], score[order]
        first = np.searchsorted(qi, np.arange(len(q.ids)))
        rank = np.arange(len(qi)) - first[qi]
        last = rank == k - 1
        bar[qi[last]] = score[last]
        kept = rank < k
        best = qi[kept], ci[kept], score[kept]
    return best


def _tiles(k: int):
    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = [FOUND_TYPES.empty_table()]
        if candidates.num_rows and queries.num_rows:
            c = Side.of_rows(candidates, key[0].as_py())
            for r in queries.to_pylist():
                every = Side.of_block(r)
                for a in range(0, len(every.ids), PIECE[0]):
                    q = every.part(a, a + PIECE[0])
                    qi, ci, score = tile_best(q, c, k)
                    found.append(pa.table([
                        pa.array(q.rows[qi]), pa.array(q.ids[qi], mask=~q.named[qi]), pa.array(c.rows[ci]),
                        pa.array(c.ids[ci], mask=~c.named[ci]), pa.array(score)], FOUND_TYPES))
        return pa.concat_tables(found)
    return run


def _table(rows: list[tuple], types: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(types)).astype(types)


def _merge(k: int):
    """Merges the tiles' bests; a partition holds all rows of its queries."""
    types = {"query_id": "Int64", "rank": "int32", "vec_id": "Int64", "score": "float64"}

    def run(batches):
        heaps: dict[int, tuple[object, list]] = {}
        for b in batches:
            for q, name, row, v, s in zip(b["query_row"], b["query_id"].astype("Int64"), b["vec_row"],
                                          b["vec_id"].astype("Int64"), b["score"], strict=True):
                unnamed = v is pd.NA
                h = heaps.setdefault(q, (name, []))[1]
                (heapq.heappush if len(h) < k else heapq.heappushpop)(h, (s, not unnamed, 0 if unnamed else -v, -row))
        yield _table([(name, i, -v if named else None, s) for name, h in heaps.values()
                      for i, (s, named, v, _) in enumerate(sorted(h, reverse=True), 1)], types)
    return run


def block_count(n: int, block: int) -> int:
    return max(1, -(-n // block), min(LEAST_BLOCKS, -(-n // LEAST_BLOCK)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, vec_id: str = "vec_id",
            embedding: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine for
    each row that ``is_query`` (over column ``id``) picks."""
    stored = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    v = v.where(usable(F.col("v").cast("array<double>"))).withColumn("row", F.monotonically_increasing_id())
    v = materialize(v, "vectors").withColumn("v", F.col("v").cast(stored))  # one number a row, for both sides
    chosen = v.where(is_query)
    blocks, query_blocks = block_count(v.count(), block), max(1, -(-chosen.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = numbered(v, blocks).withColumn("query_block", every(query_blocks) if query_blocks > 1 else F.lit(0).cast("long"))
    queries = packed(chosen, query_blocks).withColumnRenamed("block", "query_block").withColumn("block", every(blocks))
    keys = ["dim", "block", "query_block"]
    best = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_tiles(k), FOUND)
    return best.repartition("query_row").mapInPandas(
        _merge(k), "query_id long, rank int, vec_id long, score double")
