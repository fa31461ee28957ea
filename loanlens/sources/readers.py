"""Sources (A1-A4, A12): raw loan CSV, snapshots, report read-back, and the
application feed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import nan_to_null_all
from loanlens.session import materialize
from loanlens.sources.quoted_csv import read_quoted_csv
from loanlens.sources.schemas import APPLICATION_SCHEMA, MISSING_TOKENS


def _header(spark: SparkSession, path: str) -> list[str]:
    # Only the first line is read (a bounded one-row peek, not the file).
    first = spark.read.option("header", "false").csv(path).limit(1).collect()
    if not first:
        return []
    return [str(v) if v is not None else f"_c{i}" for i, v in enumerate(first[0])]


def type_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns whose every present value is a number become double, an
    entirely empty one too; one value that is none ("13.5%") leaves its column
    text, so nothing is silently lost. One aggregate pass over all columns."""
    texts = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not texts:
        return df
    bad = df.agg(*[F.count(F.when(F.col(f"`{c}`").try_cast("double").isNull(), F.col(f"`{c}`")))
                   .alias(f"b{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if bad[f"b{i}"] == 0}
    return df.select([F.col(f"`{c}`").try_cast("double").alias(c) if c in numeric
                      else F.col(f"`{c}`") for c in df.columns])


def normalize_missing(df: DataFrame) -> DataFrame:
    """Text missing-value tokens -> NULL on string columns; NaN -> NULL."""
    tokens = list(MISSING_TOKENS)
    out = df.select([
        F.when(F.col(f.name).isin(*tokens), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])
    return nan_to_null_all(out)


def with_loan_key(df: DataFrame, key: str = "loan_id") -> DataFrame:
    """Rows need an explicit key (Spark rows have no index): keep ``key``, else
    take the export's ``id`` if it is a number in every row and never repeated,
    else a hash of the row and, for equal rows, of which of them it is. The key
    depends on the data alone, not on files or partitions."""
    if key in df.columns:
        return df
    if "id" in df.columns:
        number = F.col("id").try_cast("long")
        found = df.agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("ids"),
                       F.countDistinct(number).alias("distinct")).first()
        if found["n"] == found["ids"] == found["distinct"]:
            return df.withColumn(key, number)
    row = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    digest = F.sha2(F.concat_ws("\x01", *row), 256)
    same = Window.partitionBy("_row").orderBy("_row")
    numbered = df.withColumn("_row", digest).withColumn("_nth", F.row_number().over(same))
    return numbered.withColumn(key, F.xxhash64("_row", "_nth")).drop("_row", "_nth")


def load_raw_data(spark: SparkSession, path: str | Path, schema: T.StructType | None = None,
                  key: str = "loan_id", parallel: bool = True) -> DataFrame:
    """A1: read the raw loan CSV; quoted multi-line text fields are kept whole.
    Columns are read as text and typed by what they hold, unless a ``schema`` is
    given. ``str`` and ``Path`` work.

    Large files are read by many tasks (``quoted_csv``); ``parallel=False``
    leaves them to Spark's own multi-line reader, one task a file. Rows are
    written once as Parquet for all later passes."""
    path = str(path)
    given = schema is not None
    if not given:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, path)])
    if parallel:
        df = read_quoted_csv(spark, path, schema)
    else:
        df = (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
              .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    df = materialize(normalize_missing(df), "raw-loans")
    return with_loan_key(df if given else type_columns(df), key)


def read_snapshots(spark: SparkSession, reference_path: str, current_path: str
                   ) -> tuple[DataFrame, DataFrame]:
    """A2: reference and current Parquet snapshots (schemas may differ)."""
    return spark.read.parquet(reference_path), spark.read.parquet(current_path)


def read_processed(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A3/A4: read back a processed table or report (CSV by ``fmt`` or a
    ``.csv`` name, else Parquet)."""
    if fmt == "csv" or (fmt is None and path.rstrip("/").endswith(".csv")):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return spark.read.parquet(path)


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """Application feed (JSON lines) with the fixed schema."""
    return spark.read.schema(APPLICATION_SCHEMA).json(path)


def stream_applications(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same feed as a file stream."""
    return (spark.readStream.schema(APPLICATION_SCHEMA).option("maxFilesPerTrigger", max_files)
            .json(path))


def applications_from_loans(loans: DataFrame) -> DataFrame:
    """Application-shaped rows of a loan table (application fields only)."""
    return loans.select(
        F.col("loan_id").alias("app_id"), "loan_amnt", "term", "int_rate", "installment",
        "grade", "sub_grade", "emp_length", "home_ownership", "annual_inc",
        "verification_status", "purpose", "dti",
        F.col("delinq_2yrs").cast("long").alias("delinq_2yrs"), "earliest_cr_line",
        F.col("inq_last_6mths").cast("long").alias("inq_last_6mths"),
        "mths_since_last_delinq", F.lit(None).cast("double").alias("mths_since_last_record"),
        F.col("open_acc").cast("long").alias("open_acc"),
        F.col("pub_rec").cast("long").alias("pub_rec"), "revol_bal", "revol_util",
        F.col("total_acc").cast("long").alias("total_acc"), "initial_list_status",
        "application_type")
