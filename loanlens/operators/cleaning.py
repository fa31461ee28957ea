"""Cleaning, labelling and column-dropping operators."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import finite_or_null, parse_month, string_columns, strip_ws

log = logging.getLogger(__name__)

# The outcome statuses kept for labelling, and the label.
TARGET_STATUSES = ("Fully Paid", "Charged Off")
DEFAULT_STATUS = "Charged Off"
TARGET = "target_default"

# Post-origination columns that leak the outcome (37 names).
LEAKY_COLUMNS = (
    "collection_recovery_fee", "debt_settlement_flag", "debt_settlement_flag_date",
    "funded_amnt", "funded_amnt_inv", "hardship_amount", "hardship_dpd", "hardship_end_date",
    "hardship_flag", "hardship_last_payment_amount", "hardship_length", "hardship_loan_status",
    "hardship_payoff_balance_amount", "hardship_reason", "hardship_start_date",
    "hardship_status", "hardship_type", "last_credit_pull_d", "last_fico_range_high",
    "last_fico_range_low", "last_pymnt_amnt", "last_pymnt_d", "next_pymnt_d", "out_prncp",
    "out_prncp_inv", "pymnt_plan", "recoveries", "settlement_amount", "settlement_date",
    "settlement_percentage", "settlement_status", "settlement_term", "total_pymnt",
    "total_pymnt_inv", "total_rec_int", "total_rec_late_fee", "total_rec_prncp",
)

# Columns excluded from the model matrix (27 names).
MODEL_DROP_COLUMNS = (
    "loan_status", "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d", "last_credit_pull_d",
    "recoveries", "collection_recovery_fee", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "total_pymnt", "total_pymnt_inv", "out_prncp", "out_prncp_inv",
    "debt_settlement_flag", "debt_settlement_flag_date", "settlement_status",
    "settlement_date", "settlement_amount", "settlement_percentage", "settlement_term",
    "id", "member_id", "url", "emp_title", "issue_d", "earliest_cr_line",
)


def strip_strings(df: DataFrame) -> DataFrame:
    """B1: strip Unicode whitespace from every string column."""
    cols = set(string_columns(df))
    return df.select([strip_ws(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def resolved_only(df: DataFrame, status_col: str = "loan_status") -> DataFrame:
    """B2: keep loans with a final outcome."""
    return df.filter(F.col(status_col).isin(*TARGET_STATUSES))


def add_label(df: DataFrame, status_col: str = "loan_status") -> DataFrame:
    """target_default = 1 for charged-off loans."""
    return df.withColumn(TARGET, (F.col(status_col) == DEFAULT_STATUS).cast("int"))


def clean_and_label(df: DataFrame) -> DataFrame:
    """Strip -> resolved filter -> label.

    The filter runs on the stripped expression; Catalyst collapses the
    projection into the filter, so the scan stays a single pass.
    """
    return df.transform(strip_strings).transform(resolved_only).transform(add_label)


def drop_present(df: DataFrame, names: Iterable[str], what: str = "") -> DataFrame:
    present = [c for c in names if c in df.columns]
    if present:
        log.info("dropping %d %s column(s): %s", len(present), what, present)
    return df.drop(*present)


def drop_leaky_columns(df: DataFrame) -> DataFrame:
    """Drop post-origination columns that leak the outcome."""
    return drop_present(df, LEAKY_COLUMNS, "leaky")


def drop_model_excluded(df: DataFrame) -> DataFrame:
    """Drop status, identifiers, free text and raw dates before modelling."""
    return drop_present(df, MODEL_DROP_COLUMNS, "model-excluded")


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-inf (and NaN) become missing in floating columns."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    target = fl if cols is None else fl & set(cols)
    return df.select([finite_or_null(c).alias(c) if c in target else F.col(c)
                      for c in df.columns])


def empty_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns empty in the reference, or shared and empty in current.

    One aggregate pass per frame (``count(c)`` per column)."""
    ref_counts = reference.agg(*[F.count(F.col(c)).alias(c) for c in reference.columns]).first()
    shared = [c for c in reference.columns if c in current.columns]
    cur_counts = (current.agg(*[F.count(F.col(c)).alias(c) for c in shared]).first()
                  if shared else None)
    empty = {c for c in reference.columns if ref_counts[c] == 0}
    if cur_counts is not None:
        empty |= {c for c in shared if cur_counts[c] == 0}
    return [c for c in reference.columns if c in empty]


def prune_empty_columns(reference: DataFrame, current: DataFrame
                        ) -> tuple[DataFrame, DataFrame, list[str]]:
    empty = empty_columns(reference, current)
    return (reference.drop(*empty), current.drop(*[c for c in empty if c in current.columns]),
            empty)


def align_columns(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Select ``columns`` in order; absent ones become typed NULLs."""
    have = set(df.columns)
    return df.select([F.col(c) if c in have else F.lit(None).cast(dtype).alias(c)
                      for c in columns])


def require_parseable_dates(df: DataFrame, column: str) -> None:
    """Raise if any value of ``column`` is not a month date."""
    dtype = df.schema[column].dataType
    bad = df.agg(F.sum(parse_month(column, dtype).isNull().cast("long")).alias("bad")).first()
    if bad["bad"]:
        raise ValueError(f"{column!r} contains values that could not be parsed as dates")
