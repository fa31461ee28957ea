"""Global order without a single-task window.

An unpartitioned ``Window.orderBy`` moves every row into one task. The
primitives here split the order range into buckets at approximate
quantile edges, total each bucket (a few hundred rows), turn those totals
into offsets with a tiny window, and finish with a window partitioned by
bucket. Equal order values always share a bucket, so ties stay together;
the result is exact although the edges are approximate.

* ``running_totals``  - inclusive running sums over a table that is
  distinct on (partition cols, order col): ROC/KS/AUC, PSI, quantiles.
* ``assign_segments`` - rank rows by (order col, tie col) and map every
  rank to a segment (split, decile) with a monotone function. Only the
  few order values that straddle a segment cut are ranked row by row,
  and even those are bucketed on the tie column, so a value holding a
  third of the table does not land in one task.
* ``bracketed_counts`` - value counts around asked quantiles, by a sketch.
* ``column_quantiles`` - quantiles of many columns of a frame at once, by the
  digits of their values.
* ``exact_quantiles`` - linear-interpolated quantiles (numpy / DuckDB
  ``quantile_cont`` semantics) from value counts, without the exact
  ``percentile`` aggregate's single in-memory value map.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import materialize, shuffle_partitions

_BKT = "_bkt"


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    return max(1, n_buckets or shuffle_partitions(df.sparkSession))


def _as_double(df: DataFrame, order_col: str) -> Column:
    """Monotone double image of an orderable column (dates as epoch days, texts
    as their first six bytes, exact in a double; equal images share a bucket)."""
    dtype = df.schema[order_col].dataType
    c = F.col(order_col)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def _edges(df: DataFrame, order_col: str, k: int) -> list[float]:
    if k <= 1:
        return []
    probs = [i / k for i in range(1, k)]
    row = df.agg(F.percentile_approx(_as_double(df, order_col), probs, 10000)
                 .alias("e")).first()
    vals = row["e"] or []
    return sorted({float(v) for v in vals if v is not None and math.isfinite(v)})


def count_and_edges(df: DataFrame, order_col: str, count_col: str | None = None,
                    n_buckets: int | None = None, nulls: dict | None = None
                    ) -> tuple[int, list[float]]:
    """One pass: total count of non-null ``order_col`` (sum of ``count_col``,
    else rows) and approximate bucket edges; ``nulls["n"]`` receives the
    count of NULL order values when a dict is passed."""
    k = _n_buckets(df, n_buckets)
    present = F.col(order_col).isNotNull()
    weight = F.col(count_col) if count_col else F.lit(1)
    aggs = [F.coalesce(F.sum(F.when(present, weight)), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(~present, weight)), F.lit(0)).alias("n_null")]
    if k > 1:
        aggs.append(F.percentile_approx(_as_double(df, order_col),
                                        [i / k for i in range(1, k)], 10000).alias("e"))
    row = df.agg(*aggs).first()
    if nulls is not None:
        nulls["n"] = int(row["n_null"])
    vals = (row["e"] or []) if k > 1 else []
    edges = sorted({float(v) for v in vals if v is not None and math.isfinite(v)})
    return int(row["n"]), edges


def _with_bucket(df: DataFrame, order_col: str, edges: list[float], descending: bool
                 ) -> DataFrame:
    if not edges:
        return df.withColumn(_BKT, F.lit(0))
    tmp = "_bkt_x"
    splits = [-math.inf, *edges, math.inf]
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol="_bkt_d", handleInvalid="keep"
                     ).transform(df.withColumn(tmp, _as_double(df, order_col)))
    b = F.col("_bkt_d").cast("int")
    if descending:
        b = F.lit(len(splits)) - b  # NaN bucket (last) sorts first, as NaN > all
    return out.withColumn(_BKT, b).drop(tmp, "_bkt_d")


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_",
                   keep_bucket: bool = False, edges: list[float] | None = None) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of each ``c`` in order.

    ``df`` must be distinct on ``partition_cols + [order_col]``.
    ``keep_bucket`` also returns the bucket id (``_bkt``), ordered like
    ``order_col``. ``edges`` (from ``count_and_edges``) saves the sampling pass.
    """
    P = list(partition_cols)
    if edges is None:
        edges = _edges(df, order_col, _n_buckets(df, n_buckets))
    b = _with_bucket(df, order_col, edges, descending)
    keys = P + [_BKT]
    totals = b.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*P) if P else Window).orderBy(_BKT).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    # offsets has (#partition groups x k) rows; without partition columns
    # that is at most k rows, a proven bound for the broadcast. With them,
    # AQE broadcasts it once the runtime size is known to be small.
    joined = b.join(F.broadcast(offsets) if not P else offsets, keys, "left")
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                               Window.currentRow)
    return joined.select(*[F.col(c) for c in df.columns],
                         *([F.col(_BKT)] if keep_bucket else []), *[
        (F.col(f"_o_{c}") + F.sum(c).over(w)).alias(f"{prefix}{c}") for c in sum_cols])


def assign_segments(df: DataFrame, order_col: str, tie_col: str,
                    segment_of: Callable[[Column, int], Column], out_col: str = "segment",
                    descending: bool = False, n_buckets: int | None = None,
                    with_position: bool = False, require_not_null: bool = False
                    ) -> tuple[DataFrame, int]:
    """Rank rows by ``order_col`` (then ``tie_col`` ascending, which must be
    unique) and set ``out_col = segment_of(rank, n)``; ``segment_of`` must
    be non-decreasing in rank. Rows with NULL ``order_col`` are dropped, or
    raise ``ValueError`` with ``require_not_null`` (checked in the same pass).

    Returns ``(frame, n)``.
    """
    g = df.groupBy(order_col).agg(F.count(F.lit(1)).alias("_c"))
    nulls: dict = {}
    n, edges = count_and_edges(g, order_col, "_c", n_buckets, nulls=nulls)
    if require_not_null and nulls["n"]:
        raise ValueError(f"{order_col!r} contains values that could not be parsed")
    df = df.filter(F.col(order_col).isNotNull())
    g = g.filter(F.col(order_col).isNotNull())
    if n == 0:
        return df.withColumn(out_col, F.lit(None).cast("int")), 0
    rt = running_totals(g, order_col, ["_c"], descending=descending, edges=edges)
    start = F.col("cum__c") - F.col("_c")
    rt = rt.select(order_col, start.alias("_start"),
                   segment_of(start, n).alias("_s_lo"),
                   segment_of(F.col("cum__c") - 1, n).alias("_s_hi"))
    # One small collect: per segment its value range, plus every value that
    # straddles a cut (<= #segments + #cuts rows).
    straddles = F.col("_s_lo") != F.col("_s_hi")
    bounds = rt.groupBy("_s_lo", F.when(straddles, F.col(order_col)).alias("_sv")).agg(
        F.min(order_col).alias("lo"), F.max(order_col).alias("hi"),
        F.min("_start").alias("_start"), F.max(straddles.cast("int")).alias("_st")).collect()
    whole = [r for r in bounds if not r["_st"]]
    straddle = [{order_col: r["_sv"], "_start": r["_start"]} for r in bounds if r["_st"]]
    oc = F.col(order_col)
    seg = None
    for r in whole:
        cond = (oc >= F.lit(r["lo"])) & (oc <= F.lit(r["hi"]))
        seg = F.when(cond, F.lit(r["_s_lo"])) if seg is None else seg.when(cond, F.lit(r["_s_lo"]))
    seg = (seg if seg is not None else F.lit(None)).cast("int")
    cols = [F.col(c) for c in df.columns]
    straddle_vals = [r[order_col] for r in straddle]
    main = df.filter(~oc.isin(straddle_vals)) if straddle_vals else df
    main = main.select(*cols, seg.alias(out_col))
    if with_position:
        main = main.withColumn("_pos", F.lit(None).cast("long"))
    if not straddle_vals:
        return main, n
    start_of = None
    for r in straddle:
        cond = oc == F.lit(r[order_col])
        start_of = (F.when(cond, F.lit(r["_start"])) if start_of is None
                    else start_of.when(cond, F.lit(r["_start"])))
    hot = df.filter(oc.isin(straddle_vals)).withColumn("_one", F.lit(1))
    ranked = running_totals(hot, tie_col, ["_one"], partition_cols=[order_col],
                            n_buckets=n_buckets)
    pos = start_of + F.col("cum__one") - 1
    hot_out = ranked.select(*cols, segment_of(pos, n).cast("int").alias(out_col),
                            *([pos.cast("long").alias("_pos")] if with_position else []))
    return main.unionByName(hot_out), n


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation (np.quantile default method)
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


#: Ranks of a sketch are off by a share of at most 1 / ACCURACY.
ACCURACY = 10_000
#: Ranks that a bracket's ends lie apart from its quantile, at least.
RANKS_APART = 8


def bracketed_counts(values: DataFrame, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(_k, _v, _c, _wide): value counts of each key of ``values`` (_k, _v),
    complete only where quantiles ``probs`` lie.

    A mergeable quantile sketch of each key gives a value below and one above
    every asked quantile, at least twice its error and a few ranks apart from
    it (a wider reach for keys of few values), so they must enclose it. One
    pass then counts the values inside these brackets one by one and all others
    as one row between two brackets, named by its largest value (``_wide``: it
    stands for several values). So what is shuffled is bounded by the brackets,
    not by the number of distinct values. The brackets are written first: a
    table whose size is known is broadcast when it is small, as it is for the
    columns of a frame, and the values stay where they are instead of being
    dealt out by their few keys."""
    reaches = [min(1.0, 2.0 / accuracy * 10 ** i) for i in range(max(2, len(str(accuracy)) + 1))]
    ends = [min(1.0, max(0.0, p + side * r)) for r in reaches for side in (-1, 1) for p in probs]
    sketch = values.groupBy("_k").agg(F.percentile_approx("_v", ends, accuracy).alias("_all"),
                                      F.count(F.lit(1)).alias("_n"))
    width = 2 * len(probs)
    own = F.slice("_all", len(ends) - width + 1, width)
    for i in reversed(range(len(reaches) - 1)):
        own = F.when(F.col("_n") * reaches[i] >= RANKS_APART, F.slice("_all", i * width + 1, width)).otherwise(own)
    sketch = materialize(sketch.select("_k", own.alias("_b")), "brackets")
    v, low, high = F.col("_v"), lambda i: F.get("_b", F.lit(i)), lambda i: F.get("_b", F.lit(len(probs) + i))
    inside, passed = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | ((v >= low(i)) & (v <= high(i)))
        passed = passed + (v > high(i)).cast("int")
    rows = values.join(sketch, "_k").select("_k", "_v", F.when(inside, v).alias("_own"), passed.alias("_gap"))
    return rows.groupBy("_k", "_own", "_gap").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"), F.min("_v").alias("_least")).select(
        "_k", "_v", "_c", (F.col("_least") < F.col("_v")).alias("_wide"))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    n_buckets: int | None = None) -> list[float] | None:
    """Linear-interpolated quantiles of the non-null, non-NaN values.

    Returns ``None`` when there is no value. Work: a sketch and a counting
    pass (``bracketed_counts``), a bucketed running count, and a filter down to
    the <= 2 * len(probs) value groups that contain the target positions.
    """
    v = df.select(F.lit(0).alias("_k"), F.col(value_col).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    g = bracketed_counts(v, probs).persist()
    try:
        return _quantiles_of_counts(g, probs, n_buckets)
    finally:
        g.unpersist()


def _quantiles_of_counts(g: DataFrame, probs: Sequence[float], n_buckets: int | None) -> list[float] | None:
    n, edges = count_and_edges(g, "_v", "_c", n_buckets)
    if n == 0:
        return None
    targets = []
    for q in probs:
        h = (n - 1) * float(q)
        targets.append((h, math.floor(h), math.ceil(h)))
    positions = sorted({p for _, lo, hi in targets for p in (lo, hi)})
    rt = running_totals(g, "_v", ["_c"], edges=edges)
    start, end = F.col("cum__c") - F.col("_c"), F.col("cum__c")
    cond = None
    for p in positions:
        c = (start <= p) & (F.lit(p) < end)
        cond = c if cond is None else (cond | c)
    rows = rt.filter(cond).select("_v", start.alias("s"), end.alias("e"), "_wide").collect()
    assert not any(r["_wide"] for r in rows), "a quantile lies outside its bracket"

    def value_at(p: int) -> float:
        for r in rows:
            if r["s"] <= p < r["e"]:
                return r["_v"]
        raise AssertionError("position not found")

    return [_lerp(value_at(lo), value_at(hi), h - lo) for h, lo, hi in targets]


def grouped_exact_quantiles(df: DataFrame, key_col: str, value_col: str,
                            probs: Sequence[float], n_buckets: int | None = None
                            ) -> DataFrame:
    """Per-key quantiles in one job: ``(key, q, value)``.

    Same sketch, counting pass and bucketed running count, partitioned by key;
    the per-key target table has (#keys x len(probs)) rows. The counts are
    written once: edges, totals, running counts and sizes all read them, and
    none of them goes over the values again.
    """
    v = df.select(F.col(key_col).alias("_k"), F.col(value_col).cast("double").alias("_v")
                  ).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    g = materialize(bracketed_counts(v, probs), "bracketed-counts")
    rt = running_totals(g, "_v", ["_c"], partition_cols=["_k"], n_buckets=n_buckets)
    n_tbl = g.groupBy("_k").agg(F.sum("_c").alias("_n"))
    targets = n_tbl.select("_k", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q"),
                           "_n")
    targets = targets.select("_k", "q", ((F.col("_n") - 1) * F.col("q")).alias("_h"))
    targets = targets.select("_k", "q", "_h", F.floor("_h").alias("_lo"),
                             F.ceil("_h").alias("_hi"))
    start, end = F.col("cum__c") - F.col("_c"), F.col("cum__c")
    j = rt.join(targets, "_k").filter(
        ((start <= F.col("_lo")) & (F.col("_lo") < end))
        | ((start <= F.col("_hi")) & (F.col("_hi") < end)))
    outside = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    j = j.withColumn("_v", F.when(F.col("_wide"), outside).otherwise(F.col("_v")))
    agg = j.groupBy("_k", "q", "_h", "_lo").agg(
        F.max(F.when((start <= F.col("_lo")) & (F.col("_lo") < end), F.col("_v"))).alias("a"),
        F.max(F.when((start <= F.col("_hi")) & (F.col("_hi") < end), F.col("_v"))).alias("b"))
    t = F.col("_h") - F.col("_lo")
    d = F.col("b") - F.col("a")
    val = F.when(t >= 0.5, F.col("b") - d * (1 - t)).otherwise(F.col("a") + d * t)
    return agg.select(F.col("_k").alias(key_col), "q", val.alias("value"))


#: Bits of a value that one pass of ``column_quantiles`` tells apart, and values
#: of a column that a task counts at once.
DIGIT_BITS = 16
BLOCK_ROWS = 1 << 18
_DIGITS = ("_i int, _prefix long, _digit long, _n long, _least double, _most double")


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles ``x`` (no NaN, no -0.0)."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _digit_counts(x: np.ndarray, i: int, prefixes: Sequence[int], level: int) -> pa.RecordBatch:
    """Counts and ends of one column's values by their digit of ``level``, of
    those that have one of ``prefixes`` before it."""
    keys = _ordered_bits(x)
    if level:
        own = np.isin(keys >> (64 - DIGIT_BITS * level), np.array(prefixes, np.int64))
        x, keys = x[own], keys[own]
    keys = keys >> (64 - DIGIT_BITS * (level + 1))
    order = np.argsort(keys, kind="stable")
    keys, x = keys[order], x[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = (np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)) if len(at) else (x, x)
    keys = keys[at]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(at), i, np.int32)),
        pa.array(keys >> DIGIT_BITS if level else np.zeros(len(at), np.int64)), pa.array(keys),
        pa.array(np.diff(np.r_[at, len(x)]).astype(np.int64)), *map(pa.array, ends)],
        names=["_i", "_prefix", "_digit", "_n", "_least", "_most"])


def _digits(df: DataFrame, columns: dict[int, str], prefixes: dict[int, list[int]], level: int,
            finite: bool) -> DataFrame:
    numbers = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(block)
            for i, c in zip(numbers, table.columns, strict=True):
                x = c.drop_null().to_numpy()
                x = x[np.isfinite(x) if finite else ~np.isnan(x)] + 0.0
                yield _digit_counts(x, i, prefixes.get(i, []), level)

        block, n = [], 0
        for b in batches:
            block.append(b)
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield from counted(block)
                block, n = [], 0
        if block:
            yield from counted(block)

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in columns.items()])
    return values.mapInArrow(run, _DIGITS).groupBy("_i", "_prefix", "_digit").agg(
        F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], finite: bool = False
                     ) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of each column's non-null, non-NaN values
    (``finite``: nor infinite ones); ``None`` for a column without any. Exact.

    Doubles compare like the integers of their bits, so a value at a rank is
    found digit by digit: a pass counts the values of each leading digit (tasks
    count Arrow blocks, one row a digit is shuffled), the running count says in
    which digit the rank lies, the next pass looks at the values that begin with
    it. A digit that holds a single distinct value ends the search. At most four
    passes over the rows, the later ones over the open columns alone; no row is
    exploded, a running count goes over at most 2^16 digits."""
    spark = df.sparkSession
    names = dict(enumerate(dict.fromkeys(columns)))
    if not names:
        return {}
    counts = materialize(_digits(df, names, {}, 0, finite), "digits")
    sizes = {r["_i"]: int(r["n"]) for r in counts.groupBy("_i").agg(F.sum("_n").alias("n")).collect()}
    places = {i: [(n - 1) * float(q) for q in probs] for i, n in sizes.items()}
    #: (column, rank) -> the digits before, the rank among the values that have them
    todo = {(i, p): (0, p) for i, hs in places.items() for h in hs for p in (math.floor(h), math.ceil(h))}
    found: dict[tuple[int, int], float] = {}
    level = 0
    while todo:
        if level:
            prefixes: dict[int, list[int]] = {}
            for (i, _), (prefix, _) in todo.items():
                prefixes.setdefault(i, []).append(prefix)
            counts = _digits(df, {i: names[i] for i in prefixes}, prefixes, level, finite)
        # one row for each column and asked rank
        asked = F.broadcast(spark.createDataFrame(
            [(i, prefix, p, own) for (i, p), (prefix, own) in todo.items()],
            "_i int, _prefix long, _p long, _rank long"))
        w = Window.partitionBy("_i", "_prefix").orderBy("_digit").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        hits = counts.withColumn("_end", F.sum("_n").over(w)).join(asked, ["_i", "_prefix"]).where(
            (F.col("_end") - F.col("_n") <= F.col("_rank")) & (F.col("_rank") < F.col("_end"))).collect()
        assert len(hits) == len(todo), "the rows changed between two passes"
        todo = {}
        for r in hits:
            if r["_least"] == r["_most"]:
                found[r["_i"], r["_p"]] = r["_least"]
            else:
                todo[r["_i"], r["_p"]] = (r["_digit"], r["_rank"] - (r["_end"] - r["_n"]))
        level += 1

    def between(i: int, h: float) -> float:
        a, b = found[i, math.floor(h)], found[i, math.ceil(h)]
        return a if a == b else _lerp(a, b, h - math.floor(h))

    return {c: [between(i, h) for h in places[i]] if i in places else None for i, c in names.items()}
