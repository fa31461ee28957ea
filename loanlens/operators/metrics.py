"""Validation metrics over (y, score) columns of one DataFrame.

ROC-type metrics first collapse rows to distinct scores (ties grouped,
map-side combined), then take bucketed running sums (ranking.running_totals),
so no step orders the whole table in one task. One score table feeds KS,
AUC/Gini and the ROC points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.columns import parse_month
from loanlens.operators.ranking import (assign_segments, exact_quantiles,
                                        grouped_exact_quantiles, running_totals)

Y, SCORE = "target_default", "score"


def _clean(df: DataFrame, y: str, score: str, keep: Sequence[str] = ()) -> DataFrame:
    s = F.col(score).cast("double")
    return df.select(*keep, F.col(y).cast("int").alias("_y"), s.alias("_s")).filter(
        F.col("_s").isNotNull() & ~F.isnan("_s") & F.col("_y").isNotNull())


def score_table(df: DataFrame, y: str = Y, score: str = SCORE,
                partition_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct scores (descending running sums): score, pos, neg, cum_pos, cum_neg."""
    P = list(partition_cols)
    g = _clean(df, y, score, P).groupBy(*P, "_s").agg(
        F.sum("_y").cast("long").alias("pos"),
        F.sum(1 - F.col("_y")).cast("long").alias("neg"))
    rt = running_totals(g, "_s", ["pos", "neg"], partition_cols=P, descending=True)
    return rt.withColumnRenamed("_s", "score")


def _class_totals(df: DataFrame, y: str, score: str) -> tuple[int, int]:
    r = _clean(df, y, score).agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("p"),
                                 F.count(F.lit(1)).alias("n")).first()
    return int(r["p"]), int(r["n"]) - int(r["p"])


def binary_metrics(df: DataFrame, y: str = Y, score: str = SCORE) -> DataFrame:
    """L1 + L2: one row (roc_auc, gini, ks, n, n_pos).

    AUC = sum over distinct scores of neg * (positives above + pos/2) / (P*N)
    (exact, ties as half); KS = max(TPR - FPR) over thresholds, floored at 0
    (one-sided). Undefined (one class) -> NULL.
    """
    P, N = _class_totals(df, y, score)
    spark = df.sparkSession
    if P == 0 or N == 0:
        return spark.createDataFrame(
            [(None, None, None, P + N, P)],
            "roc_auc double, gini double, ks double, n long, n_pos long")
    st = score_table(df, y, score)
    agg = st.agg(
        (F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") * 0.5)) / F.lit(float(P) * N))
        .alias("auc"),
        F.max(F.col("cum_pos") / F.lit(float(P)) - F.col("cum_neg") / F.lit(float(N))).alias("ks"))
    return agg.select(F.round("auc", 6).alias("roc_auc"),
                      F.round(2 * F.col("auc") - 1, 6).alias("gini"),
                      F.round(F.greatest(F.col("ks"), F.lit(0.0)), 6).alias("ks"),
                      F.lit(P + N).cast("long").alias("n"), F.lit(P).cast("long").alias("n_pos"))


def ks_statistic(df: DataFrame, y: str = Y, score: str = SCORE) -> float | None:
    return binary_metrics(df, y, score).first()["ks"]


def roc_auc(df: DataFrame, y: str = Y, score: str = SCORE) -> float | None:
    return binary_metrics(df, y, score).first()["roc_auc"]


def gini_coefficient(df: DataFrame, y: str = Y, score: str = SCORE) -> float | None:
    return binary_metrics(df, y, score).first()["gini"]


def roc_points(df: DataFrame, y: str = Y, score: str = SCORE) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (0, 0) start
    (threshold +inf)."""
    P, N = _class_totals(df, y, score)
    st = score_table(df, y, score)
    pts = st.select(F.col("score").alias("threshold"),
                    F.round(F.col("cum_neg") / F.lit(float(max(N, 1))), 6).alias("fpr"),
                    F.round(F.col("cum_pos") / F.lit(float(max(P, 1))), 6).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)],
                                            "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def decile_of(pos: Column, n: int) -> Column:
    """Decile of 0-based rank ``pos`` among n (1 = highest score): the
    quantile-cut of positions 0..n-1 into 10 bins, (a, b] with the lowest
    included, in exact integer arithmetic."""
    if n <= 1:
        return F.lit(1)
    return F.greatest(F.lit(1), F.ceil(pos * 10 / F.lit(n - 1)).cast("int"))


def decile_lift_table(df: DataFrame, y: str = Y, score: str = SCORE, tie_col: str = "loan_id"
                      ) -> DataFrame:
    """L4 (+ G1, G2): rows ranked by score desc (ties by ``tie_col``) into
    deciles; n, n_events, event_rate, lift and cumulative columns. Without any
    event the shares of events and the lifts are NULL."""
    src = df.select(F.col(tie_col), F.col(y).cast("int").alias("_y"),
                    F.col(score).cast("double").alias("_s")).filter(
        F.col("_s").isNotNull() & ~F.isnan("_s"))
    ranked, n = assign_segments(src, "_s", tie_col, decile_of, out_col="decile",
                                descending=True)
    tab = ranked.groupBy("decile").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum("_y").cast("long").alias("n_events"))
    tot = src.agg(F.avg("_y").alias("r"), F.sum("_y").alias("e")).first()
    overall, events = float(tot["r"] or 0.0), float(tot["e"] or 0.0)
    # at most 10 rows: the ordered running window is bounded.
    cw = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.col("n_events") / F.col("n")
    out = tab.select(
        "decile", "n", "n_events", F.round(rate, 6).alias("event_rate"),
        F.round(F.try_divide(rate, F.lit(overall)), 6).alias("lift"),
        F.sum("n_events").over(cw).alias("cumulative_events"),
        F.sum("n").over(cw).alias("cumulative_n"))
    return out.select(
        "decile", "n", "n_events", "event_rate", "lift", "cumulative_events",
        F.round(F.try_divide(F.col("cumulative_events"), F.lit(events)), 6)
        .alias("cumulative_pct_events"), "cumulative_n",
        F.round(F.try_divide(F.col("cumulative_events") / F.col("cumulative_n"), F.lit(overall)), 6)
        .alias("cumulative_lift"))


def psi_edges(expected: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Unique quantile edges of ``expected`` with the ends replaced by -inf/+inf."""
    qs = exact_quantiles(expected, column, list(np.linspace(0, 1, bins + 1)))
    if qs is None:
        return []
    edges = sorted(set(qs))
    if len(edges) == 1:
        return [float("inf")]
    return [float("-inf"), *edges[1:-1], float("inf")]


def _bin_index(x: Column, interior: list[float]) -> Column:
    # bins [a, b), last bin closed at +inf: index = #interior edges <= x
    if not interior:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in interior]), lambda e: e <= x))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10,
        actual_column: str | None = None) -> float:
    """L3: population stability index of ``actual`` against ``expected``."""
    if actual_column and actual_column != column:
        actual = actual.withColumnRenamed(actual_column, column)
    return float(psi_by_column(expected, actual, [column], bins).first()["psi"])


def psi_by_column(expected: DataFrame, actual: DataFrame, columns: Sequence[str],
                  bins: int = 10) -> DataFrame:
    """PSI of several columns in a fixed number of jobs -> (feature, psi).

    Quantile edges of every column come from one grouped exact-quantile job;
    the (column, edges) table (#columns x <= bins+1 values) is broadcast and
    both frames are binned in one aggregation. Denominators are full row
    counts (missing values fall in no bin)."""
    spark = expected.sparkSession
    cols = list(columns)

    def long(frame: DataFrame, side: str) -> DataFrame:
        return frame.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
            for c in cols])).alias("kv")).select(F.lit(side).alias("side"), "kv.feature",
                                                 "kv.x")

    probs = [float(v) for v in np.linspace(0, 1, bins + 1)]
    qs = grouped_exact_quantiles(long(expected, "e"), "feature", "x", probs).collect()
    per: dict[str, list[float]] = {}
    for r in qs:
        per.setdefault(r["feature"], []).append(r["value"])
    interior = {c: sorted(set(per[c]))[1:-1] if c in per else [] for c in cols}
    n_bins = {c: (len(sorted(set(per[c]))) - 1 if c in per else 0) for c in cols}
    edges_tbl = spark.createDataFrame([(c, interior[c]) for c in cols],
                                      "feature string, inner array<double>")
    both = long(expected, "e").unionByName(long(actual, "a"))
    valid = F.col("x").isNotNull() & ~F.isnan("x")
    binned = both.join(F.broadcast(edges_tbl), "feature").select(
        "feature", "side", F.when(valid, F.size(F.filter(
            "inner", lambda e: e <= F.col("x")))).otherwise(-1).alias("bin"))
    counts = binned.groupBy("feature", "side", "bin").agg(F.count(F.lit(1)).alias("c")).collect()
    tot: dict[tuple, int] = {}
    cnt: dict[tuple, int] = {}
    for r in counts:
        tot[(r["feature"], r["side"])] = tot.get((r["feature"], r["side"]), 0) + r["c"]
        cnt[(r["feature"], r["side"], r["bin"])] = r["c"]
    rows = []
    for c in cols:
        value = 0.0
        for b in range(n_bins[c]):
            e = cnt.get((c, "e", b), 0) / max(tot.get((c, "e"), 0), 1) or 1e-6
            a = cnt.get((c, "a", b), 0) / max(tot.get((c, "a"), 0), 1) or 1e-6
            value += (a - e) * math.log(a / e)
        rows.append((c, round(value, 6)))
    return spark.createDataFrame(rows, "feature string, psi double")


def confusion_counts(df: DataFrame, y: str = Y, prob: str = "probability_default",
                     threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """L6 inputs: tn, fp, fn, tp in one pass. Prediction = p > threshold
    (``inclusive``: p >= threshold)."""
    p = F.col(prob).cast("double")
    pred = (p >= threshold) if inclusive else (p > threshold)
    pred = F.coalesce(pred, F.lit(False)).cast("int")
    yy = F.col(y).cast("int")
    return df.agg(*[F.sum(F.when((yy == a) & (pred == b), 1).otherwise(0)).cast("long").alias(nm)
                    for nm, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def _safe(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def classification_metrics(df: DataFrame, y: str = Y, prob: str = "probability_default",
                           threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class (0 on zero division)."""
    c = confusion_counts(df, y, prob, threshold, inclusive)
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    prec, rec = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return c.select("tn", "fp", "fn", "tp",
                    F.round(_safe(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
                    F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(_safe(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def classification_report(df: DataFrame, y: str = Y, prob: str = "probability_default",
                          threshold: float = 0.40) -> DataFrame:
    """Per class, macro and weighted precision/recall/F1/support at p >= threshold."""
    c = confusion_counts(df, y, prob, threshold, inclusive=True)
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = _safe(tp, tp + fp), _safe(tp, tp + fn), _safe(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _safe(tn, tn + fn), _safe(tn, tn + fp), _safe(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
            ("weighted avg", _safe(p0 * s0 + p1 * s1, tot), _safe(r0 * s0 + r1 * s1, tot),
             _safe(f0 * s0 + f1 * s1, tot), tot)]
    long = c.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("label"), F.round(p, 6).alias("precision"),
                 F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1_score"),
                 s.cast("long").alias("support")) for k, p, r, f, s in rows])).alias("r"))
    return long.select("r.*")


def default_thresholds() -> list[float]:
    """0.1, 0.15, ... 0.95 generated as start + i * step (float noise kept)."""
    return [float(t) for t in np.arange(0.1, 1.0, 0.05)]


def sweep_thresholds(df: DataFrame, y: str = Y, prob: str = "probability_default",
                     thresholds: Sequence[float] | None = None) -> DataFrame:
    """Precision, recall, F1 for each threshold (p >= t), one scan."""
    ts = list(thresholds) if thresholds is not None else default_thresholds()
    p, yy = F.col(prob).cast("double"), F.col(y).cast("int")
    aggs = []
    for i, t in enumerate(ts):
        pred = F.coalesce(p >= t, F.lit(False))
        aggs += [F.sum(F.when(pred & (yy == 1), 1).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(pred & (yy == 0), 1).otherwise(0)).alias(f"fp{i}"),
                 F.sum(F.when(~pred & (yy == 1), 1).otherwise(0)).alias(f"fn{i}")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, t in enumerate(ts)])).alias("r")).select("r.*")
    tp, fp, fn = (F.col(k).cast("double") for k in ("tp", "fp", "fn"))
    return long.select("threshold", F.round(_safe(tp, tp + fp), 6).alias("precision"),
                       F.round(_safe(tp, tp + fn), 6).alias("recall"),
                       F.round(_safe(2 * tp, 2 * tp + fp + fn), 6).alias("f1_score"))


def brier_score(df: DataFrame, y: str = Y, prob: str = "probability_default") -> Column:
    """L9 aggregate expression: mean squared error of probabilities."""
    return F.avg(F.pow(F.col(prob).cast("double") - F.col(y).cast("double"), 2))


def reliability_curve(df: DataFrame, y: str = Y, prob: str = "probability_default",
                      n_bins: int = 10) -> DataFrame:
    """Uniform bins (a, b] on [0, 1], first bin includes 0; empty bins
    absent: bin, prob_true, prob_pred, n."""
    interior = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    p = F.col(prob).cast("double")
    b = F.size(F.filter(F.array(*[F.lit(e) for e in interior]), lambda e: e < p))
    return (df.filter(p.isNotNull() & ~F.isnan(p)).groupBy(b.alias("bin"))
            .agg(F.round(F.avg(F.col(y).cast("double")), 6).alias("prob_true"),
                 F.round(F.avg(p), 6).alias("prob_pred"), F.count(F.lit(1)).alias("n")))


def per_vintage_auc(df: DataFrame, date_col: str = "issue_d", y: str = Y,
                    score: str = SCORE) -> DataFrame:
    """ROC-AUC per YYYY-MM vintage (dates, or month texts such as
    ``Jan-2019``); NULL where only one class occurs. Rows without a readable date
    belong to no vintage."""
    month = parse_month(date_col, df.schema[date_col].dataType)
    v = df.withColumn("vintage", F.date_format(month, "yyyy-MM")).filter(F.col("vintage").isNotNull())
    st = score_table(v, y, score, partition_cols=["vintage"])
    per = st.groupBy("vintage").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") * 0.5)).alias("num"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 F.col("num") / (F.col("P").cast("double") * F.col("N")))
    return per.select("vintage", F.round(auc, 6).alias("auc"),
                      (F.col("P") + F.col("N")).cast("long").alias("n"),
                      F.col("P").cast("long").alias("n_pos"))


def vintage_auc_by_model(df: DataFrame, scores: dict[str, str], date_col: str = "issue_d",
                         y: str = Y) -> DataFrame:
    """Per-vintage AUC of several models aligned on vintage: a long
    (model, vintage, auc) table pivoted to one column per model (missing
    vintages of a model stay NULL, as an outer join would leave them)."""
    parts = [per_vintage_auc(df, date_col, y, col).select(
        F.lit(name).alias("model"), "vintage", "auc") for name, col in scores.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy("vintage").pivot("model", list(scores)).agg(F.first("auc"))


def evaluate(df: DataFrame, y: str = Y, prob: str = "probability_default",
             tie_col: str = "loan_id") -> dict[str, DataFrame]:
    """Metrics bundle over one scored frame (persist it first)."""
    return {
        "summary": binary_metrics(df, y, prob),
        "classification": classification_metrics(df, y, prob),
        "decile_lift": decile_lift_table(df, y, prob, tie_col),
    }
