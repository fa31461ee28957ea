"""Reading CSV files whose quoted fields hold line breaks, in parallel.

Spark splits a text file at line breaks; whether a break ends a record depends
on all quotes before it. So the file is scanned twice. The first scan counts
the quote signs of every split; the parity of the counts before a split says
whether it starts inside quotes. The second scan cuts each split's lines into
records. A record that crosses a split's end leaves a piece in every split it
touches, at most two pieces a split; pieces are put together by a small shuffle.

What passes through the driver is one bit a split, less than the list of
splits that Spark itself holds there.

A quote sign in a field that is not quoted would count as an opening one: such
files break the CSV format, and ``load_raw_data(parallel=False)`` reads them.
Where lines end with CR LF, such breaks inside quotes become LF, as Spark's own
reader does it.
Splits must be the same in both scans; if the session's default parallelism
changes in between, the second scan stops with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import materialize

#: Where a piece stands: a whole record, one begun before the split, one that goes on after it.
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, block long, part int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        "value")


def starts_inside(lines: DataFrame) -> DataFrame:
    """(file, block, inside) of every split."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Split:
    """The lines of one split, taken batch by batch."""

    def __init__(self, file: str, block: int, inside: bool, header: bool):
        self.file, self.block, self.inside = file, block, inside
        self.part = HEAD if inside else WHOLE
        self.open: list[str] = []
        self.skip = header and block == 0

    def _piece(self, part: int) -> list[tuple[int, str]]:
        out = [(part, "\n".join(self.open))] if self.open else []
        self.open = []
        if out and part == WHOLE and self.skip:
            self.skip, out = False, []
        return out

    def take(self, values: pa.Array) -> list[tuple[int, str]]:
        """The pieces that these lines complete."""
        quotes = np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) + self.inside
        before = np.concatenate(([int(self.inside)], quotes[:-1])) % 2
        starts = np.flatnonzero(before == 0)
        texts, out = values.to_pylist(), []
        for a, b in zip(np.concatenate(([0], starts)), np.concatenate((starts, [len(texts)])), strict=True):
            if a in starts[:1] or len(starts) and a > starts[0]:  # a record begins here: what was open is complete
                out += self._piece(self.part)
                self.part = WHOLE
            self.open += texts[a:b]
        self.inside = bool(quotes[-1] % 2) if len(texts) else self.inside
        return out

    def end(self) -> list[tuple[int, str]]:
        """The last piece; one that began before the split and ends with it is a head too."""
        return self._piece(self.part if self.part == HEAD else TAIL if self.inside else WHOLE)


def _cut(states: dict[tuple[str, int], bool], header: bool):
    def table(split: _Split, pieces: list[tuple[int, str]]):
        n = len(pieces)
        yield pa.RecordBatch.from_arrays([
            pa.array([split.file] * n, pa.string()), pa.array([split.block] * n, pa.int64()),
            pa.array([p for p, _ in pieces], pa.int32()), pa.array([r for _, r in pieces], pa.string())],
            ["file", "block", "part", "record"])

    def run(batches):
        split = None
        for b in batches:
            ends = np.flatnonzero(np.diff(b["block"].to_numpy())) + 1 if len(b) else []
            files = pc.run_end_encode(b["file"]).run_ends.to_numpy()[:-1] if len(b) else []
            cuts = sorted({0, *map(int, ends), *map(int, files), len(b)})
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                file, block = b["file"][lo].as_py(), b["block"][lo].as_py()
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        yield from table(split, split.end())
                    if (file, block) not in states:
                        raise RuntimeError("the file's splits changed between two scans; read it again")
                    split = _Split(file, block, states[file, block], header)
                yield from table(split, split.take(b["value"].slice(lo, hi - lo)))
        if split is not None:
            yield from table(split, split.end())
    return run


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(record): records that cross splits, from the pieces they left."""
    upto = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("part") == TAIL, F.col("block")), ignorenulls=True).over(upto)
    whole = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("all"))
    return whole.select(F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))


def read_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the records of quoted CSV files, the first of each file left
    out if it is a header; empty lines are none. Written once."""
    lines = _lines(spark, path)
    states = {(r["file"], r["block"]): r["inside"] for r in starts_inside(lines).collect()}  # a bit a split
    pieces = materialize(lines.mapInArrow(_cut(states, header), PIECES), "csv-records")
    crossing = pieces.where(F.col("part") != WHOLE)
    records = pieces.where(F.col("part") == WHOLE).select("record").unionByName(joined_pieces(crossing))
    # a record that ends with \r\n is from a file whose line ends are that, inside quotes too
    plain = F.replace(F.rtrim(F.col("record"), F.lit("\r")), F.lit("\r\n"), F.lit("\n"))
    return records.select(F.when(F.col("record").endswith("\r"), plain).otherwise(F.col("record")).alias("record")).where(
        F.col("record") != "")


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of quoted CSV files with a header, as ``schema``."""
    row = F.from_csv("record", _ddl(schema), {"escape": '"', "mode": "PERMISSIVE"})
    names = [f.name for f in schema.fields]
    return read_records(spark, path).select(row.alias("row")).select(
        *[F.col("row").getField(n).alias(n) for n in names])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
