"""Windowed score/feature drift on a stream.

Static reference bins (exact quantile edges of the reference window) are
applied to the stream as literals; a watermarked tumbling-window
aggregation counts events per bin; each closed window gets its PSI against
the reference shares as a column expression. Rows later than the
watermark are dropped by Spark; a window is emitted once it is closed. A
replayed table is one micro-batch, so no order of its files or rows makes any
of them late; it is closed by one marker event beyond its last window, so the
last window is emitted too. Shares are of all rows (missing values fall in no
bin), as in the batch PSI.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.metrics import psi_edges
from loanlens.session import ensure_checkpoint_dir
from loanlens.sources.fixture import read_table

EPS = 1e-6


def _bin(x, interior):
    if not interior:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in interior]), lambda e: e <= x))


def reference_profile(reference: DataFrame, column: str, bins: int = 10
                      ) -> tuple[list[float], list[float]]:
    """Interior edges and floored reference shares per bin."""
    edges = psi_edges(reference, column, bins)
    interior = edges[1:-1] if len(edges) > 1 else []
    nb = max(len(edges) - 1, 1)
    n = reference.count()
    x = F.col(column).cast("double")
    counts = {r["b"]: r["c"] for r in reference.filter(x.isNotNull() & ~F.isnan(x)).groupBy(
        _bin(x, interior).alias("b")).agg(
        F.count(F.lit(1)).alias("c")).collect()}
    shares = [max(counts.get(i, 0) / max(n, 1), 0.0) or EPS for i in range(nb)]
    return interior, shares


def windowed_psi(stream: DataFrame, column: str, interior: list[float], shares: list[float],
                 ts: str = "ts", window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per closed window: n, PSI against the reference shares."""
    x = F.col(column).cast("double")
    b = F.when(x.isNotNull() & ~F.isnan(x), _bin(x, interior)).otherwise(-1)
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.sum(F.when(b == i, 1).otherwise(0)).alias(f"b{i}") for i in range(len(shares))]
    # event time must be a session-zone timestamp for watermarking
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    agg = (stream.withWatermark(ts, watermark)
           .groupBy(F.window(ts, window)).agg(*aggs))
    terms = []
    for i, e in enumerate(shares):
        a = F.col(f"b{i}") / F.col("n")
        a = F.when(a == 0, EPS).otherwise(a)
        terms.append((a - F.lit(e)) * F.log(a / F.lit(e)))
    psi = terms[0]
    for t in terms[1:]:
        psi = psi + t
    return agg.select(F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), "n",
                      F.round(psi, 6).alias("psi"))


def run_drift_stream_once(spark: SparkSession, sf_dir: str, column: str = "value",
                          window: str = "1 day") -> DataFrame:
    """Reference = first half of the event month (static); the whole events
    table is then replayed as a stream and drained (available-now, all its files
    as one micro-batch: the watermark moves only after the last of them). A second
    run of the same stream, from its checkpoint, reads only a marker event far
    after the last one: it moves the watermark past every window of the table."""
    events = read_table(spark, sf_dir, "events")
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    interior, shares = reference_profile(events.filter(F.col("ts") < cut), column)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/drift-stream-{uuid.uuid4().hex}"
    events.limit(0).write.parquet(f"{base}/marker")

    def source(path: str) -> DataFrame:
        return spark.readStream.schema(events.schema).parquet(path)

    # a glob (not a bare file path) so the file source lists it as input
    stream = source(f"{sf_dir.rstrip('/')}/event[s].parquet").unionByName(source(f"{base}/marke[r]"))

    def drain() -> None:
        (windowed_psi(stream, column, interior, shares, window=window)
         .writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
         .awaitTermination())

    drain()
    last = events.agg(F.max("ts").alias("ts"))
    marker = [F.lit(None).cast(t).alias(c) if c != "ts" else (
        F.col("ts") + F.expr("INTERVAL 3650 DAYS")).cast(t).alias(c) for c, t in events.dtypes]
    last.where("ts IS NOT NULL").select(*marker).write.mode("append").parquet(f"{base}/marker")
    drain()
    return spark.read.schema("window_start timestamp, window_end timestamp, n long, psi double").parquet(
        f"{base}/out")
