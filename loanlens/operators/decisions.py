"""Risk bands, decisions and scorecard (M1-M6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.columns import col_of, interval_label, nan_to_null

# Batch bands are (a, b] over these edges.
RISK_BAND_EDGES = (0, 0.2, 0.4, 0.6, 0.8, 1)
RISK_BAND_LABELS = ("Very Low Risk", "Low Risk", "Medium Risk", "High Risk", "Very High Risk")
# Serving bands are [a, b) below each threshold, else the last label.
SERVING_BAND_THRESHOLDS = (0.2, 0.4, 0.6, 0.8)
SERVING_BAND_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")
# Decision thresholds.
APPROVE_BELOW = 0.20
REJECT_ABOVE = 0.50


def risk_band(p: str | Column = "probability_default") -> Column:
    """M1: batch band, (a, b] closure: 0 -> NULL, 0.2 -> Very Low Risk."""
    return interval_label(p, RISK_BAND_EDGES, RISK_BAND_LABELS, closed="right")


def serving_risk_band(p: str | Column = "pd") -> Column:
    """M2: serving band, [a, b) closure: 0.2 -> Low."""
    x = col_of(p)
    expr = None
    for t, label in zip(SERVING_BAND_THRESHOLDS, SERVING_BAND_LABELS, strict=False):
        expr = F.when(x < t, label) if expr is None else expr.when(x < t, label)
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(SERVING_BAND_LABELS[-1]))


def decision(p: str | Column = "probability_default", approve_below: float = APPROVE_BELOW,
             reject_above: float = REJECT_ABOVE) -> Column:
    """M3/M4: Approve below, Reject at or above, else (and missing) Manual Review."""
    x = nan_to_null(col_of(p))
    return (F.when(x < approve_below, "Approve").when(x >= reject_above, "Reject")
            .otherwise("Manual Review"))


def risk_score(p: str | Column = "probability_default") -> Column:
    """M5: int((1 - p) * 1000), truncating."""
    return ((F.lit(1.0) - col_of(p)) * 1000).try_cast("int")


def build_scorecard(df: DataFrame, prob: str = "probability_default",
                    actual: str = "target_default", keep: tuple[str, ...] = ()) -> DataFrame:
    """M6: risk_score, probability_default, risk_band, decision, actual."""
    return df.select(*keep, risk_score(prob).alias("risk_score"),
                     F.col(prob).alias("probability_default"),
                     risk_band(prob).alias("risk_band"), decision(prob).alias("decision"),
                     F.col(actual).alias("actual"))
