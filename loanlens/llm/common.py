"""What the corpus operators share: table reading, word expressions, names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: Column | str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words (runs of anything but ASCII white space) of a non-null text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words of a non-null text."""
    return F.size(words_of(text)).cast("long")


def fresh(name: str) -> str:
    """A column name that no input column carries."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


