import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.sources import quoted_csv
from loanlens.sources.readers import load_raw_data

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "the end")])


@pytest.fixture
def small_splits(spark):
    """Files are split after a few dozen bytes, so records cross many splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}

    def set_to(size):
        for k, v in zip(names, (str(size), "0"), strict=True):
            spark.conf.set(k, v)
    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


def multi_line(spark, path):
    return (spark.read.schema(SCHEMA).option("header", "true").option("multiLine", "true").option("escape", '"')
            .csv(path))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(path, seed, n, newline="\n", last=True):
    draw = random.Random(seed)
    texts = ["plain", "", '"with, comma"', '"two\nlines"', '"a ""quoted"" word"', '"\n\n"', '"ends with break\n"',
             '"""starts"', '"x\r\ny"', '"' + "long\n" * 30 + '"', "é ü", '""']
    lines = ['id,"text","the\nend"' if seed % 2 else "id,text,the end"]
    for i in range(n):
        lines.append(",".join([str(i), draw.choice(texts), draw.choice(texts)]))
        if draw.random() < 0.05:
            lines.append("")
    path.write_bytes((newline.join(lines) + newline * last).encode())


@pytest.mark.parametrize("size", [60, 700, 10 ** 6])
def test_same_rows_as_the_multi_line_reader(spark, small_splits, tmp_path, size):
    for seed in (2, 4):
        write(tmp_path / f"part{seed}.csv", seed, 50, last=seed == 2)
    want = rows(multi_line(spark, str(tmp_path)))
    small_splits(size)
    df = quoted_csv.read_quoted_csv(spark, str(tmp_path), SCHEMA)
    assert rows(df) == want and len(want) == 100
    tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 40 if size == 60 else tasks >= 1


def test_header_with_breaks_and_windows_line_ends(spark, small_splits, tmp_path):
    write(tmp_path / "a.csv", 3, 40, newline="\r\n")
    small_splits(500)
    got = rows(quoted_csv.read_quoted_csv(spark, str(tmp_path), SCHEMA))
    assert len(got) == 40 and not any("\r" in (v or "") for r in got for v in r)


def test_one_record_over_many_splits(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,the end\n1,a,b\n2,"' + "line, of text\n" * 200 + '",c\n3,"d\n",e\n')
    small_splits(64)
    got = rows(quoted_csv.read_quoted_csv(spark, str(tmp_path), SCHEMA))
    assert got == [("1", "a", "b"), ("2", "line, of text\n" * 200, "c"), ("3", "d\n", "e")]


def test_split_states(spark):
    lines = spark.createDataFrame([("f", 0, 'a"b'), ("f", 10, "c"), ("f", 20, 'd"'), ("f", 30, '""'), ("g", 0, "x"), ("g", 9, "y")],
                                  "file string, block long, value string")
    got = {(r.file, r.block): r.inside for r in quoted_csv.starts_inside(lines).collect()}
    assert got == {("f", 0): False, ("f", 10): True, ("f", 20): True, ("f", 30): False, ("g", 0): False, ("g", 9): False}


def test_short_and_long_records_and_an_empty_file(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,the end\n1\n2,b\n3,c,d,e\n\n")
    want = rows(multi_line(spark, str(tmp_path)))
    assert rows(quoted_csv.read_quoted_csv(spark, str(tmp_path), SCHEMA)) == want and len(want) == 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "only.csv").write_text("id,text,the end\n")
    assert rows(quoted_csv.read_quoted_csv(spark, str(tmp_path / "b"), SCHEMA)) == []


def test_load_raw_data_both_ways(spark, small_splits, tmp_path):
    write(tmp_path / "a.csv", 6, 80)
    small_splits(400)
    a, b = (load_raw_data(spark, tmp_path, parallel=p) for p in (True, False))
    assert a.dtypes == b.dtypes and rows(a) == rows(b) and a.count() == 80
    assert a.select(F.countDistinct("loan_id")).first()[0] == 80
