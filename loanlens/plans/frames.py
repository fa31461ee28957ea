"""Shared Spark frames of the fixture pipeline used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.cleaning import clean_and_label, drop_leaky_columns
from loanlens.operators.features import build_features
from loanlens.operators.splits import time_based_split
from loanlens.session import materialize
from loanlens.sources.fixture import loan_view

PROB = "probability_default"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, labelled loans, lazy: a query reads only the columns it asks for."""
    return loan_view(spark, sf_dir).transform(clean_and_label)


def row_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that a row gives by itself (all but the quartile bucket of
    the loan amount, which needs a pass over the table), lazy."""
    return cleaned(spark, sf_dir).transform(drop_leaky_columns).transform(
        lambda df: build_features(df, loan_size=False))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, for queries over whole rows in several passes: the joined
    table is written once to the shared folder and every pass reads that copy
    instead of replaying the join."""
    base = cleaned(spark, sf_dir).transform(drop_leaky_columns)
    return materialize(base, "cleaned").transform(build_features)


def pseudo_score(df: DataFrame) -> DataFrame:
    """Fixed score for metric queries on the fixture: many ties on purpose,
    exact in every engine (floor, then one IEEE division)."""
    return df.withColumn(PROB, F.floor(F.col("credit_exposure_score") * 10) / F.lit(3000.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored loans, lazy: for queries that aggregate them in one pass."""
    return pseudo_score(row_features(spark, sf_dir))


#: What the metrics over scores, vintages and splits read.
SCORED_COLUMNS = ("loan_id", "issue_d", "target_default", "loan_amnt", "int_rate", "dti",
                  "revol_util", "annual_inc", PROB)


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored loans for metrics that rank or rescan them: only their columns,
    written once."""
    return materialize(scored(spark, sf_dir).select(*SCORED_COLUMNS), "scored")


def split_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_based_split(scored_table(spark, sf_dir), "issue_d")


def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_based_split(features(spark, sf_dir), "issue_d")


def events_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference = first half of the event month, current = second half."""
    from loanlens.sources.fixture import read_table
    ev = read_table(spark, sf_dir, "events")
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    return ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)
