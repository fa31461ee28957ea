"""Documents to packed training sequences, in five stages.

Each stage takes what the one before it kept and is written as Parquet in
between (``run`` does it in the shared folder). All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import classifier, jaccard_join, mixing, packing, pii
from loanlens.llm.common import read_table
from loanlens.session import ensure_checkpoint_dir, materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    weights, threshold = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return classifier.accepted(docs, weights, threshold)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return jaccard_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, drops and cuts documents to the sources' target weights."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's token pieces into sequences."""
    return packing.pack_documents(docs, TOKENIZER, pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", sequences),
]

#: The classifier, the similarity groups and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
