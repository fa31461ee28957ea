"""Sinks (A5, A6, A7, A8, A11): report tables, warehouse load, small JSON
artifacts, dashboard export bundle."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import parse_month
from loanlens.session import materialize, shuffle_partitions
from loanlens.sources.readers import with_loan_key
from loanlens.sources.schemas import FACT_LOANS_SCHEMA, WAREHOUSE_LOAD_COLUMNS


def write_report(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False
                 ) -> str:
    """A5: overwrite a report table. ``single_file`` only for small reports."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def warehouse_frame(df: DataFrame, key: str = "loan_id", *further: str) -> DataFrame:
    """Conform to the fact_loans schema (source key kept; rows without one
    get ``with_loan_key``'s, which is the same at every load; risk_band NULL
    unless the frame carries it)."""
    df = with_loan_key(df, key)
    have = set(df.columns)
    cols = []
    for f in FACT_LOANS_SCHEMA.fields:
        if f.name == "loan_id":
            src = F.col(key)
        else:
            src = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols, *further)


def load_warehouse(df: DataFrame, table: str | None = None, jdbc_url: str | None = None,
                   properties: dict | None = None, batch_size: int = 10000) -> DataFrame:
    """Replace the warehouse table with the 23 loaded columns (+ key).

    ``table`` -> managed table (saveAsTable); ``jdbc_url`` -> JDBC write with
    batched inserts. Credentials come only from ``properties``."""
    frame = warehouse_frame(df).select("loan_id", *WAREHOUSE_LOAD_COLUMNS, "risk_band")
    if jdbc_url:
        props = dict(properties or {})
        props.setdefault("batchsize", str(batch_size))
        frame.write.mode("overwrite").jdbc(jdbc_url, table or "fact_loans", properties=props)
    elif table:
        frame.write.mode("overwrite").saveAsTable(table)
    return frame


UNKNOWN_MONTH = "unknown"
FILES_A_MONTH = 8


def load_warehouse_months(df: DataFrame, path: str, issue_col: str = "issue_d", key: str = "loan_id") -> list[str]:
    """A6 by month: the warehouse as Parquet in one folder an issue month
    (``issue_month=yyyy-MM``; loans without a readable date under ``unknown``).
    The months that ``df`` holds are replaced whole, all others stay as they
    are; returns the months.

    The rows are computed and written to the shared folder first, so an error
    in them leaves the warehouse untouched; the write itself is staged by Spark
    and moves complete folders. Loading the same rows again gives the same
    table, so a load that was cut off is simply repeated."""
    if issue_col not in df.columns:
        raise ValueError(f"the loans have no column {issue_col!r} to tell their month")
    kept = with_loan_key(df, key)
    dates = kept.schema[issue_col].dataType
    date = parse_month(F.col(issue_col)) if isinstance(dates, T.StringType) else F.col(issue_col).cast("date")
    kept = kept.withColumn("issue_month", F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(UNKNOWN_MONTH)))
    staged = materialize(warehouse_frame(kept, key, "issue_month"), "warehouse")
    months = sorted(r["issue_month"] for r in staged.select("issue_month").distinct().collect())  # a few hundred
    # one task a month would be too few for a large one: rows of a month go to several files
    spread = staged.repartition(shuffle_partitions(df.sparkSession), "issue_month", F.pmod(F.xxhash64("loan_id"), F.lit(FILES_A_MONTH)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue_month").parquet(path)
    return months


def read_warehouse(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The month-wise warehouse; ``months`` reads those folders alone."""
    schema = T.StructType([*FACT_LOANS_SCHEMA.fields, T.StructField("issue_month", T.StringType())])
    table = spark.read.schema(schema).parquet(path)
    return table if months is None else table.where(F.col("issue_month").isin(*months))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds ``path``; any other trouble with it is an error."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def write_json_artifact(spark: SparkSession, obj, path: str) -> None:
    """One small JSON document (vocabulary, defaults, metadata)."""
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_json_artifact(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def export_dashboard_bundle(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv"
                            ) -> list[str]:
    """Write the dashboard tables (dataset, risk scores, thresholds,
    portfolio summary, decision default rate, scorecard, risk band
    analysis) under one folder."""
    paths = []
    for name, df in tables.items():
        paths.append(write_report(df, f"{out_dir.rstrip('/')}/{name}", fmt))
    return paths
