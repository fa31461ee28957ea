"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with a digest of
the tokenizer file. Counts already stored under that key are joined; only the
distinct missing contents are encoded, once each, and appended to the cache.

Normalised content: white-space runs as one space, none at the ends, where the
tokenizer drops white space (``drops_space``); else the text itself.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); empty
and repeated texts are encoded once; an empty table gives an empty table and
leaves the cache as it was; all other columns pass through, one named like a
result is replaced. A content's text is reduced to one copy on the map side
before it is shuffled, so a content with a third of all rows moves once a task.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loanlens.llm import tokenizing
from loanlens.llm.common import SPACE_RUN, SPACES, fresh, whole_text

LIMIT = 2048
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # a cache that is there but cannot be read is no empty one
        return spark.createDataFrame([], CACHE_SCHEMA)  # nothing stored yet


def known_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a content that two runs
    stored at once counts once."""
    return (read_cache(spark, cache).where(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def _encoder(path: str, drops_space: bool):
    def run(batches):
        split = tokenizing.spaced_chunks if drops_space else tokenizing.leading_space_chunks
        chunks = tokenizing.known_chunks(path)
        for b in batches:
            texts = b["text"].tolist()
            n = [x for lo, hi in tokenizing.slices(texts) for x in chunks.counts(texts[lo:hi], split)]
            b["n_tokens"] = n
            yield b[["digest", "n_tokens"]].astype({"n_tokens": "int64"})
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, *, text: str = "text",
                 drops_space: bool = False, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; appends the
    contents it had to encode to the Parquet table at ``cache``."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    content = whole_text(text)
    if drops_space:
        content = F.btrim(F.regexp_replace(content, SPACE_RUN, " "), F.lit(SPACES))
    key = fresh("digest")
    keyed = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn(key, F.sha2(content, 256))
    distinct = (docs.select(F.sha2(content, 256).alias("digest"), content.alias("text"))
                .groupBy("digest").agg(F.first("text").alias("text")))
    misses = distinct.join(known_counts(spark, cache, version), "digest", "left_anti")
    (misses.mapInPandas(_encoder(tokenizer_path, drops_space), "digest string, n_tokens long")
     .select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache))
    counts = known_counts(spark, cache, version).withColumnRenamed("digest", key)
    return (keyed.withColumn("n_bytes", F.octet_length(whole_text(text)).cast("long"))
            .join(counts, key, "left").drop(key)
            .withColumn("over_limit", F.col("n_tokens") > limit))
