import pytest
from pyspark.sql import functions as F

from loanlens.sources.schemas import FACT_LOANS_SCHEMA
from loanlens.sources.sinks import load_warehouse_months, read_warehouse, warehouse_frame

LOANS = "loan_id long, loan_amnt int, grade string, issue_d string, other string"


def loans(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LOANS)


def files(spark, path):
    return {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


def test_reloading_a_month_touches_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "warehouse")
    first = loans(spark, [(1, 100, "A", "Jan-2019"), (2, 200, "B", "Jan-2019"), (3, 300, "C", "Feb-2019"), (4, 400, "D", None)])
    assert load_warehouse_months(first, path) == ["2019-01", "2019-02", "unknown"]
    before = files(spark, path)
    again = loans(spark, [(3, 333, "C", "Feb-2019"), (5, 500, "E", "Feb-2019")])
    assert load_warehouse_months(again, path) == ["2019-02"]
    got = {r.loan_id: (r.loan_amnt, r.issue_month) for r in read_warehouse(spark, path).collect()}
    assert got == {1: (100.0, "2019-01"), 2: (200.0, "2019-01"), 3: (333.0, "2019-02"), 5: (500.0, "2019-02"), 4: (400.0, "unknown")}
    changed = before ^ files(spark, path)
    assert changed and all("issue_month=2019-02" in f for f in changed)
    february = read_warehouse(spark, path, ["2019-02"])
    assert february.count() == 2 and february.columns == [*FACT_LOANS_SCHEMA.names, "issue_month"]
    assert all("issue_month=2019-02" in f for f in {r.f for r in february.select(F.input_file_name().alias("f")).collect()})


def test_a_failed_load_leaves_the_warehouse_as_it_was(spark, tmp_path):
    path = str(tmp_path / "warehouse")
    load_warehouse_months(loans(spark, [(1, 100, "A", "Jan-2019"), (2, 200, "B", "Feb-2019")]), path)
    before = files(spark, path), sorted(map(tuple, read_warehouse(spark, path).collect()))
    broken = loans(spark, [(1, 111, "A", "Jan-2019"), (9, 900, "B", "Mar-2019")]).withColumn(
        "loan_amnt", F.when(F.col("loan_id") == 9, F.raise_error(F.lit("bad row")).cast("int")).otherwise(F.col("loan_amnt")))
    with pytest.raises(Exception, match="bad row"):
        load_warehouse_months(broken, path)
    assert (files(spark, path), sorted(map(tuple, read_warehouse(spark, path).collect()))) == before
    # the same load, mended and repeated, ends as one that never failed
    load_warehouse_months(loans(spark, [(1, 111, "A", "Jan-2019"), (9, 900, "B", "Mar-2019")]), path)
    once = {r.loan_id: r.loan_amnt for r in read_warehouse(spark, path).collect()}
    assert once == {1: 111.0, 2: 200.0, 9: 900.0}


def test_rows_without_a_key_get_the_same_at_every_load(spark):
    rows = loans(spark, [(i, 100 * (i % 3), "A", "Jan-2019") for i in range(40)]).drop("loan_id")
    a, b = (sorted(r.loan_id for r in warehouse_frame(x).collect()) for x in (rows, rows.repartition(5)))
    assert a == b and len(set(a)) == 40


def test_dates_and_empty_loads(spark, tmp_path):
    path = str(tmp_path / "warehouse")
    dated = loans(spark, [(1, 100, "A", "Jan-2019")]).withColumn("issue_d", F.lit("2020-05-17").cast("date"))
    assert load_warehouse_months(dated, path) == ["2020-05"]
    assert load_warehouse_months(dated.where("false"), path) == [] and read_warehouse(spark, path).count() == 1
    with pytest.raises(ValueError, match="no column"):
        load_warehouse_months(dated.drop("issue_d"), path)
