"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
NAN = float("nan")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_divide(a: str | Column, b: str | Column) -> Column:
    """a / b with IEEE semantics: x/0 = +-inf, 0/0 = NaN, NULL propagates.

    Spark 4 runs ANSI by default, where a plain ``/`` by zero raises.
    """
    a, b = col_of(a).cast("double"), col_of(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b != 0, F.try_divide(a, b))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
        .otherwise(F.lit(NAN))
    )


def nan_to_null(c: str | Column) -> Column:
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def finite_or_null(c: str | Column) -> Column:
    """+-inf and NaN become NULL (missing)."""
    c = col_of(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)


# Every character Python's str.strip() removes (str.isspace()), from the rule.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing whitespace as Python's ``str.strip()`` does
    (``F.trim`` only strips spaces); a character-set trim, no regex."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def parse_month(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """``MMM-yyyy`` text to a date; dates and timestamps pass through; bad text is NULL."""
    if dtype is not None and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col_of(c))
    return F.try_to_date(col_of(c), "MMM-yyyy")


def interval_label(c: str | Column, edges: Sequence[float], labels: Sequence[str],
                   closed: str = "right", include_lowest: bool = False) -> Column:
    """Label ``c`` by the interval it falls into.

    ``closed='right'`` gives (a, b] bins (values on the lowest edge are
    outside unless ``include_lowest``); ``closed='left'`` gives [a, b).
    Values outside every bin, NULL and NaN get NULL.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    x = col_of(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        if closed == "right":
            lower_ok = (x >= lo) if (include_lowest and i == 0) else (x > lo)
            cond = lower_ok & (x <= hi)
        elif closed == "left":
            cond = (x >= lo) & (x < hi)
        else:
            raise ValueError("closed must be 'right' or 'left'")
        cond = cond & ~F.isnan(x.cast("double"))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN is NULL everywhere (Spark aggregates let NaN through)."""
    cols = set(float_columns(df))
    if not cols:
        return df
    return df.select([nan_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])
