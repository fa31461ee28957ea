"""Feature engineering (C1-C14): an ordered chain of DataFrame transforms.

All steps are row-local column expressions except the loan-size bucket,
whose quartile edges come from one distributed exact-quantile pass and are
then applied as literals (and can be persisted for scoring).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.columns import ieee_divide, interval_label, parse_month
from loanlens.operators.ranking import exact_quantiles

# Bucket labels and edges of the engineered features.
REVOL_UTIL_EDGES = (0, 30, 60, 90, 150)
REVOL_UTIL_LABELS = ("low", "moderate", "high", "very_high")
DTI_EDGES = (0, 10, 20, 30, 100)
DTI_LABELS = ("low_dti", "moderate_dti", "high_dti", "very_high_dti")
EMPLOYMENT_EDGES = (-1, 1, 5, 10, 50)
EMPLOYMENT_LABELS = ("new", "short_term", "medium_term", "long_term")
INQUIRY_EDGES = (-1, 1, 3, 6, 100)
INQUIRY_LABELS = ("low_inquiry", "moderate_inquiry", "high_inquiry", "very_high_inquiry")
DELINQUENCY_EDGES = (-1, 0, 2, 5, 100)
DELINQUENCY_LABELS = ("no_delinquency", "low_delinquency", "moderate_delinquency",
                      "high_delinquency")
LOAN_SIZE_LABELS = ("small", "medium", "large", "very_large")
# Serving-time padding amounts for the loan-size quartiles.
LOAN_AMNT_PADDING = (1000.0, 8000.0, 15000.0, 25000.0, 40000.0)

BUCKET_VOCAB = {
    "revol_util_bucket": REVOL_UTIL_LABELS,
    "dti_bucket": DTI_LABELS,
    "employment_stability": EMPLOYMENT_LABELS,
    "inquiry_risk_bucket": INQUIRY_LABELS,
    "delinquency_risk": DELINQUENCY_LABELS,
    "loan_size_bucket": LOAN_SIZE_LABELS,
}

FEATURE_COLUMNS = (
    "income_to_loan_ratio", "revol_util_bucket", "dti_bucket", "emp_length_clean",
    "employment_stability", "credit_history_years", "inquiry_risk_bucket", "delinquency_risk",
    "loan_size_bucket", "revol_bal_to_income", "installment_to_income", "credit_exposure_score",
)


def add_income_to_loan_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("income_to_loan_ratio", ieee_divide("annual_inc", "loan_amnt"))


def add_revol_util_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("revol_util_bucket",
                         interval_label("revol_util", REVOL_UTIL_EDGES, REVOL_UTIL_LABELS))


def add_dti_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("dti_bucket", interval_label("dti", DTI_EDGES, DTI_LABELS))


def emp_length_years(c: str | Column) -> Column:
    """First digit run of the text, else 0."""
    digits = F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def add_employment_stability(df: DataFrame) -> DataFrame:
    df = df.withColumn("emp_length_clean", emp_length_years("emp_length"))
    return df.withColumn("employment_stability",
                         interval_label("emp_length_clean", EMPLOYMENT_EDGES, EMPLOYMENT_LABELS))


def add_credit_history_years(df: DataFrame) -> DataFrame:
    """Replaces issue_d / earliest_cr_line by dates; whole days / 365."""
    df = df.withColumn("issue_d", parse_month("issue_d", df.schema["issue_d"].dataType))
    df = df.withColumn("earliest_cr_line",
                       parse_month("earliest_cr_line", df.schema["earliest_cr_line"].dataType))
    return df.withColumn("credit_history_years",
                         F.datediff("issue_d", "earliest_cr_line") / F.lit(365.0))


def add_inquiry_risk_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("inquiry_risk_bucket",
                         interval_label("inq_last_6mths", INQUIRY_EDGES, INQUIRY_LABELS))


def add_delinquency_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("delinquency_risk",
                         interval_label("delinq_2yrs", DELINQUENCY_EDGES, DELINQUENCY_LABELS))


def loan_size_edges(df: DataFrame, column: str = "loan_amnt") -> list[float]:
    """Quartile edges [min, q1, q2, q3, max] over the whole frame.

    Duplicate edges raise, as quartile binning cannot label them."""
    qs = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    if qs is None:
        raise ValueError(f"{column!r} has no values to compute quartiles from")
    if len(set(qs)) != len(qs):
        raise ValueError(f"Bin edges must be unique: {qs}")
    return qs


def add_loan_size_bucket(df: DataFrame, edges: Sequence[float] | None = None) -> DataFrame:
    """Quartile bucket; pass persisted training ``edges`` when scoring."""
    edges = list(edges) if edges is not None else loan_size_edges(df)
    return df.withColumn("loan_size_bucket",
                         interval_label("loan_amnt", edges, LOAN_SIZE_LABELS,
                                        include_lowest=True))


def padded_loan_size_bucket(amount: str | Column = "loan_amnt") -> Column:
    """Per-row quartiles over the row's amount plus the five padding
    amounts (serving parity mode), with no UDF."""
    x = F.col(amount) if isinstance(amount, str) else amount
    a = F.array_sort(F.array(x.cast("double"), *[F.lit(v) for v in LOAN_AMNT_PADDING]))

    def at(i: int) -> Column:
        return F.element_at(a, i + 1)

    def lerp(lo: Column, hi: Column, t: float) -> Column:
        return (hi - (hi - lo) * (1 - t)) if t >= 0.5 else (lo + (hi - lo) * t)

    q1, q2, q3 = lerp(at(1), at(2), 0.25), lerp(at(2), at(3), 0.5), lerp(at(3), at(4), 0.75)
    lo, hi = at(0), at(5)
    label = (F.when((x >= lo) & (x <= q1), LOAN_SIZE_LABELS[0])
             .when((x > q1) & (x <= q2), LOAN_SIZE_LABELS[1])
             .when((x > q2) & (x <= q3), LOAN_SIZE_LABELS[2])
             .when((x > q3) & (x <= hi), LOAN_SIZE_LABELS[3]))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(label)


def add_revol_bal_to_income(df: DataFrame) -> DataFrame:
    return df.withColumn("revol_bal_to_income", ieee_divide("revol_bal", "annual_inc"))


def add_installment_to_income(df: DataFrame) -> DataFrame:
    return df.withColumn("installment_to_income",
                         ieee_divide(F.col("installment") * 12, "annual_inc"))


def add_credit_exposure_score(df: DataFrame) -> DataFrame:
    return df.withColumn("credit_exposure_score",
                         F.coalesce(F.col("revol_util").cast("double"), F.lit(0.0))
                         + F.coalesce(F.col("dti").cast("double"), F.lit(0.0))
                         + F.coalesce(F.col("inq_last_6mths").cast("double"), F.lit(0.0)))


FEATURE_STEPS = (
    add_income_to_loan_ratio,
    add_revol_util_bucket,
    add_dti_bucket,
    add_employment_stability,
    add_credit_history_years,
    add_inquiry_risk_bucket,
    add_delinquency_risk,
    add_loan_size_bucket,
    add_revol_bal_to_income,
    add_installment_to_income,
    add_credit_exposure_score,
)


def build_features(df: DataFrame, loan_size_edges: Sequence[float] | None = None,
                   padded_loan_size: bool = False, loan_size: bool = True) -> DataFrame:
    """Apply the 11 steps in order; same rows, input untouched.

    ``loan_size_edges`` fixes the quartile edges (scoring with training
    edges); ``padded_loan_size`` uses the per-row padding quartiles;
    ``loan_size=False`` leaves that bucket out, and with it the passes over
    the table that its quartiles take.
    """
    def step(frame: DataFrame, fn) -> DataFrame:
        if fn is add_loan_size_bucket:
            if not loan_size:
                return frame
            if padded_loan_size:
                return frame.withColumn("loan_size_bucket", padded_loan_size_bucket())
            return add_loan_size_bucket(frame, loan_size_edges)
        return fn(frame)

    return functools.reduce(step, FEATURE_STEPS, df)
