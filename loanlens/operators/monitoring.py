"""Drift monitoring (O1-O3, B8, I1) as a drift table, one row per column.

Both snapshots are unioned with a ``side`` flag and unpivoted, so every
statistic for every column comes out of a few shared jobs:

* numeric columns - value counts per (column, value, side) -> bucketed
  running counts per column -> two-sample KS distance and the normed
  Wasserstein distance (area between the two empirical CDFs divided by
  the reference standard deviation); PSI against reference quantile edges.
* categorical columns - counts per (column, category, side) -> chi-square
  statistic of current counts against reference shares, and the
  Jensen-Shannon distance.

The table carries every statistic of a column at every size; which one decides
"drifted" is a named parameter (normed Wasserstein >= 0.1 and Jensen-Shannon
>= 0.1 unless asked otherwise; KS and chi-square decide by p-value < 0.05).
p-values are computed on the driver from the few scalar statistics.
Dates and timestamps are compared as numbers (days, seconds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import NUMERIC_TYPES
from loanlens.operators.cleaning import prune_empty_columns
from loanlens.operators.metrics import psi_by_column
from loanlens.operators.ranking import running_totals

TARGET = "target_default"
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Least divisor of the normed distance, so that a constant column that moves counts.
MIN_DEVIATION = 0.001


# --- scalar distributions (driver side, on a handful of numbers) ---------------

def ks_pvalue(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample KS p-value (Stephens' small-sample correction)."""
    if n == 0 or m == 0:
        return float("nan")
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s, sign = 0.0, 1.0
    for k in range(1, 101):
        term = sign * math.exp(-2.0 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-12:
            break
        sign = -sign
    return max(0.0, min(1.0, 2.0 * s))


def _gammq(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, else the
    continued fraction by the modified Lentz method (Press et al., Numerical
    Recipes, chapter 6.2)."""
    if x < 0 or a <= 0:
        return float("nan")
    if x == 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:  # series for P, then Q = 1 - P
        ap, total, delta = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1
            delta *= x / ap
            total += delta
            if abs(delta) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - gln))
    b = x + 1 - a  # continued fraction for Q
    c, d = 1.0 / 1e-300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_pvalue(stat: float, dof: int) -> float:
    if dof <= 0:
        return float("nan")
    return _gammq(dof / 2.0, stat / 2.0)


# --- distributed statistics -----------------------------------------------------

def _split_kinds(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in columns if isinstance(types[c], (*NUMERIC_TYPES, *DATE_TYPES))]
    cat = [c for c in columns if isinstance(types[c], (T.StringType, T.BooleanType))]
    return num, cat


def _long(ref: DataFrame, cur: DataFrame, columns: Sequence[str], as_string: bool
          ) -> DataFrame:
    def value(frame: DataFrame, c: str) -> Column:
        dtype = frame.schema[c].dataType
        if as_string:
            return F.col(c).cast("string")
        if isinstance(dtype, T.DateType):
            return F.unix_date(c).cast("double")
        if isinstance(dtype, DATE_TYPES):
            return F.col(c).cast("timestamp").cast("double")
        return F.col(c).cast("double")

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), value(frame, c).alias("value"))
            for c in columns])).alias("kv")).select(
            F.lit(name).alias("side"), "kv.column", "kv.value")
    # Reference and current stacked with a side flag.
    return side(ref, "reference").unionByName(side(cur, "current")).filter(
        F.col("value").isNotNull())


def numeric_drift_stats(reference: DataFrame, current: DataFrame, columns: Sequence[str]
                        ) -> DataFrame:
    """(column, n_ref, n_cur, ks_distance, wasserstein_normed) for numeric and
    date columns; the distances are NULL where a side has no value."""
    long = _long(reference, current, columns, as_string=False).filter(~F.isnan("value"))
    counts = long.groupBy("column", "value").agg(
        F.sum(F.when(F.col("side") == "reference", 1).otherwise(0)).alias("cr"),
        F.sum(F.when(F.col("side") == "current", 1).otherwise(0)).alias("cc"))
    totals = long.groupBy("column").agg(
        F.sum(F.when(F.col("side") == "reference", 1).otherwise(0)).alias("n_ref"),
        F.sum(F.when(F.col("side") == "current", 1).otherwise(0)).alias("n_cur"),
        F.stddev_samp(F.when(F.col("side") == "reference", F.col("value"))).alias("sd_ref"))
    rt = running_totals(counts, "value", ["cr", "cc"], partition_cols=["column"],
                        keep_bucket=True)
    # next distinct value: lead inside the bucket, else the next bucket's minimum
    # (bucket minima: #columns x #buckets rows).
    w_in = Window.partitionBy("column", "_bkt").orderBy("value")
    mins = rt.groupBy("column", "_bkt").agg(F.min("value").alias("_bmin"))
    mins = mins.select("column", "_bkt", F.lead("_bmin").over(
        Window.partitionBy("column").orderBy("_bkt")).alias("_next_bmin"))
    rt = rt.join(mins, ["column", "_bkt"], "left").withColumn(
        "_next", F.coalesce(F.lead("value").over(w_in), F.col("_next_bmin")))
    j = rt.join(totals, "column")
    diff = F.abs(F.try_divide("cum_cr", "n_ref") - F.try_divide("cum_cc", "n_cur"))
    stats = j.groupBy("column", "n_ref", "n_cur", "sd_ref").agg(
        F.max(diff).alias("ks"),
        F.sum(F.when(F.col("_next").isNotNull(), diff * (F.col("_next") - F.col("value")))
              .otherwise(diff * 0.0)).alias("w1"))
    return stats.select(
        "column", F.col("n_ref").cast("long").alias("n_ref"),
        F.col("n_cur").cast("long").alias("n_cur"),
        F.round("ks", 6).alias("ks_distance"),
        F.round(F.col("w1") / F.greatest(F.coalesce("sd_ref", F.lit(0.0)), F.lit(MIN_DEVIATION)), 6)
        .alias("wasserstein_normed"))


def categorical_drift_stats(reference: DataFrame, current: DataFrame, columns: Sequence[str]
                            ) -> DataFrame:
    """(column, n_ref, n_cur, n_categories, chi2_statistic, js_distance, psi).

    A category unseen in the reference is expected half a row's share there, so
    that it adds to the statistic; PSI floors empty shares at 1e-6."""
    long = _long(reference, current, columns, as_string=True)
    counts = long.groupBy("column", "value").agg(
        F.sum(F.when(F.col("side") == "reference", 1).otherwise(0)).alias("cr"),
        F.sum(F.when(F.col("side") == "current", 1).otherwise(0)).alias("cc"))
    tot = counts.groupBy("column").agg(F.sum("cr").alias("n_ref"), F.sum("cc").alias("n_cur"))
    j = counts.join(tot, "column")
    p = F.try_divide("cr", "n_ref")
    q = F.try_divide("cc", "n_cur")
    m = (p + q) / 2
    expected = F.try_divide(F.greatest(F.col("cr"), F.lit(0.5)), F.col("n_ref")) * F.col("n_cur")
    pe, qe = (F.when(x == 0, 1e-6).otherwise(x) for x in (p, q))

    def kl(a, b):
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    stats = j.groupBy("column", "n_ref", "n_cur").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum(F.try_divide(F.pow(F.col("cc") - expected, 2), expected)).alias("chi2"),
        F.sum((qe - pe) * F.log(qe / pe)).alias("psi"),
        F.sum(0.5 * kl(p, m) + 0.5 * kl(q, m)).alias("js_div"))
    return stats.select("column", F.col("n_ref").cast("long").alias("n_ref"),
                        F.col("n_cur").cast("long").alias("n_cur"),
                        F.col("n_categories").cast("long").alias("n_categories"),
                        F.round("chi2", 6).alias("chi2_statistic"),
                        F.round(F.sqrt(F.greatest(F.col("js_div"), F.lit(0.0))), 6)
                        .alias("js_distance"), F.round("psi", 6).alias("psi"))


DRIFT_SCHEMA = (
    "section string, column string, kind string, method string, statistic double, "
    "p_value double, threshold double, drifted boolean, ks_distance double, "
    "ks_p_value double, wasserstein_normed double, chi2_statistic double, "
    "chi2_p_value double, js_distance double, psi double")


def _as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, dates as days and timestamps as seconds."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select([
        (F.unix_date(c) if isinstance(types[c], T.DateType)
         else F.col(c).cast("timestamp") if isinstance(types[c], DATE_TYPES) else F.col(c))
        .cast("double").alias(c) for c in columns])


def drift_table(reference: DataFrame, current: DataFrame, target: str = TARGET,
                columns: Sequence[str] | None = None,
                numeric_test: str = "wasserstein_normed",
                categorical_test: str = "jensenshannon",
                threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """O1 + O2: one row per column with every statistic of its kind, PSI, and
    the verdict of the chosen test: ``wasserstein_normed`` or ``ks`` for numbers
    and dates, ``jensenshannon`` or ``chisquare`` for categories. Empty columns
    are pruned first (B8); the target gets its own section when both frames
    carry it."""
    if numeric_test not in ("wasserstein_normed", "ks") or categorical_test not in (
            "jensenshannon", "chisquare"):
        raise ValueError(f"unknown test {numeric_test!r} or {categorical_test!r}")
    spark = reference.sparkSession
    reference, current, _ = prune_empty_columns(reference, current)
    shared = [c for c in reference.columns if c in current.columns]
    cols = [c for c in (columns or shared) if c in shared]
    sections = [("features", [c for c in cols if c != target])]
    if target in reference.columns and target in current.columns:
        sections.append(("target", [target]))
    rows = []

    def verdict(method, statistic, p_value):
        if p_value is not None:
            return method, statistic, p_value, alpha, p_value == p_value and p_value < alpha
        return method, statistic, None, threshold, statistic is not None and statistic >= threshold

    for section, scols in sections:
        num, cat = _split_kinds(reference, scols)
        if section == "target":
            num, cat = [], scols  # the label is a class, not a measure
        if num:
            psi = {r["feature"]: r["psi"] for r in psi_by_column(
                _as_numbers(reference, num), _as_numbers(current, num), num).collect()}
            for r in numeric_drift_stats(reference, current, num).collect():
                ks, w = r["ks_distance"], r["wasserstein_normed"]
                pv = ks_pvalue(ks, r["n_ref"], r["n_cur"]) if ks is not None else None
                chosen = (verdict("ks", ks, pv) if numeric_test == "ks"
                          else verdict("wasserstein_normed", w, None))
                rows.append((section, r["column"], "numerical", *chosen, ks, pv, w, None, None,
                             None, psi.get(r["column"])))
        if cat:
            for r in categorical_drift_stats(reference, current, cat).collect():
                chi, js = r["chi2_statistic"], r["js_distance"]
                dof = max(int(r["n_categories"]) - 1, 0)
                pv = chi2_pvalue(chi, dof) if chi is not None else None
                chosen = (verdict("chisquare", chi, pv) if categorical_test == "chisquare"
                          else verdict("jensenshannon", js, None))
                rows.append((section, r["column"], "categorical", *chosen, None, None, None, chi,
                             pv, js, r["psi"]))
    return spark.createDataFrame(rows, DRIFT_SCHEMA)


def dataset_drift(table: DataFrame, share: float = 0.5) -> DataFrame:
    """O3 summary: share of drifted feature columns and the dataset flag."""
    f = table.filter(F.col("section") == "features")
    return f.agg(F.count(F.lit(1)).alias("n_columns"),
                 F.sum(F.col("drifted").cast("int")).alias("n_drifted")).select(
        "n_columns", "n_drifted",
        F.round(F.col("n_drifted") / F.col("n_columns"), 6).alias("share_drifted"),
        (F.col("n_drifted") / F.col("n_columns") >= share).alias("dataset_drift"))
