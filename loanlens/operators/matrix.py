"""Model matrix (D1-D12): profile, impute, encode, assemble.

``MatrixPrep.fit`` runs three distributed passes - a numeric-coercion
profile of the string columns, exact medians of all numeric columns
together (``ranking.column_quantiles``), and one
dictionary job over the distinct (column, value) pairs of all columns. The
fitted state is small (one median per column, the sorted vocabulary or the
dictionary path of each categorical column), is persisted as JSON, and is
applied as literals or joins that also work on streams.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import NUMERIC_TYPES, finite_or_null
from loanlens.operators.cleaning import MODEL_DROP_COLUMNS, TARGET
from loanlens.operators.ranking import column_quantiles

MISSING_TOKEN = "nan"


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def category_as_string(df: DataFrame, columns: Sequence[str], token: str = MISSING_TOKEN
                       ) -> DataFrame:
    """Missing categories become the ``token`` category."""
    cols = set(columns)
    return df.select([F.coalesce(F.col(c), F.lit(token)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def _bad_numeric(v: Column) -> Column:
    """Text that is neither a number nor a gap (null, empty or "nan")."""
    return v.isNotNull() & (v != "") & v.try_cast("double").isNull()


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of every row, values as text."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.column", "kv.value")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs, deduplicated map-side: the profile and the
    vocabulary only need distinct values, so casts run once per value."""
    return column_values(df, columns).distinct()


# Vocabularies up to this size are applied as literal lookup maps; larger
# (free-text-like) columns are joined to their part of the dictionary. The
# codes are the same.
MAX_LITERAL_VOCABULARY = 10_000


def dictionary(pairs: DataFrame, name: str = "dictionary") -> str:
    """D5/D6 for all columns in one job: (value, code) with code = position of
    the value among its column's sorted distinct values, written in one folder
    a column (``column=...``). Returns the Parquet path.

    The distinct (column, value) pairs are sorted globally once, whatever the
    columns and their sizes; each pair is stamped with its partition and row id
    and written, so the ids are fixed. A code is the number of the column's
    pairs in earlier partitions (a window over partitions x columns rows) plus
    the pair's place among the column's pairs of its own partition."""
    from loanlens.session import materialize, scratch

    pairs = pairs.where(F.col("value").isNotNull()).distinct()
    stamped = materialize(pairs.orderBy("column", "value").select(
        "column", "value", F.spark_partition_id().alias("_p"),
        F.monotonically_increasing_id().alias("_m")), f"{name}-stamped")
    per = stamped.groupBy("column", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("column", "_p", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_m0")).alias("_o"))
    # one row a partition and column that meet: at most partitions + columns
    codes = stamped.join(F.broadcast(offsets), ["column", "_p"]).select(
        "column", "value", (F.col("_o") + F.col("_m")).cast("long").alias("code"))
    path = scratch(pairs.sparkSession, name)
    codes.write.partitionBy("column").parquet(path)
    return path


def read_dictionary(spark, path: str) -> DataFrame:
    """(column, value, code) of a ``dictionary``."""
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("value", T.StringType()),
                           T.StructField("code", T.LongType())])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def literal_vocabularies(spark, path: str, columns: Sequence[str], max_literal: int
                         ) -> tuple[dict[str, list[str]], list[str]]:
    """(sorted vocabularies of the columns with at most ``max_literal`` values,
    the other columns). Sizes are known before any value is gathered."""
    codes = read_dictionary(spark, path)
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [c for c in columns if sizes.get(c, 0) > max_literal]
    small = [c for c in columns if c not in large]
    vocab: dict[str, list[str]] = {c: [] for c in small}
    if any(sizes.get(c) for c in small):
        for r in codes.where(F.col("column").isin(*small)).orderBy("column", "code").collect():
            vocab[r["column"]].append(r["value"])
    return vocab, large


def profile_and_vocabulary(df: DataFrame, columns: Sequence[str], fill: str = MISSING_TOKEN,
                           max_literal: int = MAX_LITERAL_VOCABULARY
                           ) -> tuple[list[str], dict[str, list[str]], dict[str, str]]:
    """D2 + D6: (numeric-looking columns, sorted vocabularies of the small
    categorical columns, dictionary paths of the large ones).

    A column whose values are all numbers or gaps is numeric; gaps are no
    category of it. Categories keep their gaps as ``fill``."""
    from loanlens.session import materialize

    if not columns:
        return [], {}, {}
    spark = df.sparkSession
    pairs = materialize(distinct_values(df, columns), "distinct-values")
    bad = {r["column"] for r in pairs.where(_bad_numeric(F.col("value"))).select("column").distinct().collect()}
    coerced = [c for c in columns if c not in bad]
    cats = [c for c in columns if c in bad]
    if not cats:
        return coerced, {}, {}
    path = dictionary(pairs.where(F.col("column").isin(*cats)).withColumn(
        "value", F.coalesce("value", F.lit(fill))))
    vocab, large = literal_vocabularies(spark, path, cats, max_literal)
    return coerced, vocab, {c: f"{path}/column={_folder(c)}" for c in large}


def _folder(name: str) -> str:
    """A column's name as Spark writes it in a partition folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 or ord(c) == 127 else c for c in name)


def encode_with_table(df: DataFrame, column: str, table_path: str, out_col: str,
                      missing_token: str = MISSING_TOKEN) -> DataFrame:
    """Join a code table (unknown -> -1). AQE broadcasts small tables and
    splits skewed keys of large ones."""
    codes = df.sparkSession.read.parquet(table_path).select(
        F.col("value").alias(f"_v_{out_col}"), F.col("code").alias(out_col))
    key = F.coalesce(F.col(column).cast("string"), F.lit(missing_token))
    j = df.withColumn(f"_v_{out_col}", key).join(codes, f"_v_{out_col}", "left")
    return j.drop(f"_v_{out_col}").withColumn(out_col, F.coalesce(F.col(out_col), F.lit(-1)))


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact (linear-interpolated) median of each column, all in the same passes."""
    got = column_quantiles(df, columns, [0.5], finite=True)
    return {c: got[c][0] if got[c] else None for c in columns}


def median_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D3/D7 as a table (column, median)."""
    got = column_medians(df, columns)
    return df.sparkSession.createDataFrame([(c, m) for c, m in got.items() if m is not None],
                                           "column string, median double")


def category_vocabulary(df: DataFrame, columns: Sequence[str], fill: str | None = MISSING_TOKEN,
                        max_literal: int = MAX_LITERAL_VOCABULARY) -> tuple[dict[str, list[str]], dict[str, str]]:
    """(sorted distinct values of each column with at most ``max_literal``,
    dictionary paths of the others), one job; code-point order."""
    if not columns:
        return {}, {}
    path = dictionary(_filled(df, columns, fill))
    vocab, large = literal_vocabularies(df.sparkSession, path, columns, max_literal)
    return vocab, {c: f"{path}/column={_folder(c)}" for c in large}


def _filled(df: DataFrame, columns: Sequence[str], fill: str | None) -> DataFrame:
    pairs = column_values(df, columns)
    return pairs if fill is None else pairs.withColumn("value", F.coalesce("value", F.lit(fill)))


def vocabulary_table(df: DataFrame, columns: Sequence[str],
                     fill: str | None = MISSING_TOKEN) -> DataFrame:
    """D6 as a long table (column, value, code), from one dictionary job."""
    return read_dictionary(df.sparkSession, dictionary(_filled(df, columns, fill)))


def encode(value: Column, vocab: Sequence[str]) -> Column:
    """Position in the sorted vocabulary; unknown -> -1 (map lookup)."""
    if not vocab:
        return F.lit(-1)
    lookup = F.create_map(*[x for i, v in enumerate(vocab) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(lookup, value), F.lit(-1)).cast("int")


@dataclass
class MatrixPrepModel:
    """Fitted matrix state (D11); small, JSON-serialisable."""

    feature_names: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]
    coerced_columns: list[str]
    medians: dict[str, float | None]
    vocabulary: dict[str, list[str]]
    key_columns: list[str] = field(default_factory=list)
    target: str = TARGET
    missing_token: str = MISSING_TOKEN
    code_tables: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame, assemble: bool = True,
                  keep: Sequence[str] = ()) -> DataFrame:
        """Encode any frame with the fitted state: key, target, features."""
        have = set(df.columns)
        for c, path in self.code_tables.items():
            if c in have:
                df = encode_with_table(df, c, path, f"_code_{c}", self.missing_token)
        exprs = []
        for c in self.feature_names:
            if c in self.code_tables:
                exprs.append((F.col(f"_code_{c}") if c in have else F.lit(-1))
                             .cast("double").alias(c))
            elif c in self.categorical_columns:
                v = F.col(c).cast("string") if c in have else F.lit(None).cast("string")
                v = F.coalesce(v, F.lit(self.missing_token))
                exprs.append(encode(v, self.vocabulary.get(c, [])).cast("double").alias(c))
            else:
                v = F.col(c) if c in have else F.lit(None)
                if c in self.coerced_columns:
                    v = F.nullif(v.cast("string"), F.lit("")).try_cast("double")
                v = finite_or_null(v.cast("double"))
                med = self.medians.get(c)
                if med is not None:
                    v = F.coalesce(v, F.lit(float(med)))
                exprs.append(v.alias(c))
        passthrough = [c for c in [*self.key_columns, self.target, *keep] if c in have]
        out = df.select(*[F.col(c) for c in dict.fromkeys(passthrough)], *exprs)
        return self.assemble(out) if assemble else out

    def assemble(self, df: DataFrame) -> DataFrame:
        """The feature columns of ``df`` as one vector."""
        return VectorAssembler(inputCols=self.feature_names, outputCol="features",
                               handleInvalid="keep").transform(df)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> MatrixPrepModel:
        return cls(**json.loads(text))


class MatrixStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted matrix (D11) as an ML stage: vocabulary, coercions and medians
    in one parameter, so it is saved and loaded like any stage and can stand
    before a model in a ``PipelineModel``. Large vocabularies are dictionary
    folders that the state names; ``with_tables`` points it to copies."""

    state = Param(Params._dummy(), "state", "fitted matrix state as JSON", TypeConverters.toString)

    def __init__(self, fitted: MatrixPrepModel | None = None):
        super().__init__()
        if fitted is not None:
            self._set(state=fitted.to_json())

    @property
    def fitted(self) -> MatrixPrepModel:
        return MatrixPrepModel.from_json(self.getOrDefault(self.state))

    def with_tables(self, tables: dict[str, str]) -> MatrixStage:
        fitted = self.fitted
        fitted.code_tables = {c: tables.get(c, p) for c, p in fitted.code_tables.items()}
        return MatrixStage(fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted = self.fitted
        others = [c for c in dataset.columns if c not in fitted.feature_names and c != "features"]
        return fitted.transform(dataset, keep=others)


class MatrixPrep:
    """``prepare_model_matrix`` as a fit/transform pair.

    B6 drop -> B11 inf -> D1 category strings -> D2 coercion -> D3 median /
    D4 'unknown' imputation -> D5 codes (position in sorted vocabulary).
    """

    def __init__(self, target: str = TARGET, key_columns: Sequence[str] = ("loan_id",),
                 drop: Sequence[str] = MODEL_DROP_COLUMNS, extra_drop: Sequence[str] = ("split",),
                 missing_token: str = MISSING_TOKEN,
                 max_literal_vocabulary: int = MAX_LITERAL_VOCABULARY):
        self.max_literal_vocabulary = max_literal_vocabulary
        self.target = target
        self.key_columns = list(key_columns)
        self.drop = list(drop) + list(extra_drop)
        self.missing_token = missing_token

    def fit(self, df: DataFrame, fit_on: DataFrame | None = None) -> MatrixPrepModel:
        """Fit on ``fit_on`` (default: ``df`` itself, all rows, as the
        original does; pass the train split for leak-free statistics). Text columns
        of numbers and gaps become numeric, their gaps the median."""
        src = fit_on if fit_on is not None else df
        skip = set(self.drop) | set(self.key_columns) | {self.target}
        feats = [f for f in src.schema.fields if f.name not in skip]
        strings = [f.name for f in feats if isinstance(f.dataType, T.StringType)]
        others = [f.name for f in feats if not isinstance(f.dataType, T.StringType)]
        bad_types = [f.name for f in feats if f.name in others and not _is_numeric(f.dataType)]
        # numbers with gaps are numbers: the profile sees the columns before gaps are named
        coerced, vocab, tables = profile_and_vocabulary(src, strings, self.missing_token,
                                                        self.max_literal_vocabulary)
        categorical = [c for c in strings if c not in coerced]
        numeric = [c for c in others if c not in bad_types] + coerced
        num_src = src.select(*[
            (F.nullif(F.col(c), F.lit("")).try_cast("double") if c in coerced
             else F.col(c).cast("double")).alias(c) for c in numeric])
        medians = column_medians(num_src, numeric)
        names = [f.name for f in feats if f.name in set(numeric) | set(categorical)]
        return MatrixPrepModel(feature_names=names, numeric_columns=numeric,
                               categorical_columns=categorical, coerced_columns=coerced,
                               medians=medians, vocabulary=vocab, key_columns=self.key_columns,
                               target=self.target, missing_token=self.missing_token,
                               code_tables=tables)


def feature_defaults(matrix: DataFrame, feature_names: Sequence[str]) -> dict[str, float | None]:
    """Per-column median of the (encoded) training matrix."""
    return column_medians(matrix, feature_names)
