"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library depends on for correct results (not tuning):
# UTC month/day arithmetic, and AQE for runtime skew splitting and
# broadcast conversion of the small per-bucket offset tables.
_REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "loanlens") -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    On a cluster the session already exists and carries its own master,
    partition counts and ``spark.checkpoint.dir``; only the settings the
    library needs for correct results are applied to it.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        for k, v in _REQUIRED_CONF.items():
            active.conf.set(k, v)
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name).master(master or "local[*]")
    for k, v in _REQUIRED_CONF.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOANLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local
    session without one gets a scratch folder (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
    path = tempfile.mkdtemp(prefix="loanlens-ckpt-")
    sc.setCheckpointDir(path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextmanager
def compiled_in_parts(spark: SparkSession):
    """Frames of many expressions run as methods that the JVM compiles.

    One generated method for all expressions of a wide frame outgrows the 8,000
    bytes beyond which HotSpot only interprets it; with this limit Spark runs
    such a step by its smaller generated methods instead. Same results."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts lineage like ``checkpoint()`` (survives executor loss, never
    replays upstream joins) while later passes keep column pruning and
    filter pushdown on the columnar copy."""
    return df.sparkSession.read.parquet(write_table(df, name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def write_table(df, name: str = "table") -> str:
    """Write ``df`` as Parquet under the shared checkpoint folder; the path."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path
