from pyspark.sql import functions as F

from loanlens.operators.cleaning import (LEAKY_COLUMNS, align_columns, clean_and_label,
                                         drop_leaky_columns, empty_columns, inf_to_null)

STATUSES = ["Fully Paid", "Charged Off", "Current", "Late (31-120 days)", "Late (16-30 days)",
            "In Grace Period", "Default", "Fully Paid", "Charged Off", "Fully Paid",
            "Charged Off", "Current", "Fully Paid", "Charged Off", "Default"]
GRADES = [" A", "B ", " C ", "D", "E", "A", "B", "C", "D", "E", "\tA", "B ", "C", "D", "E"]


def raw(spark):
    rows = [(s, 900 + 300 * i, g) for i, (s, g) in enumerate(zip(STATUSES, GRADES))]
    return spark.createDataFrame(rows, "loan_status string, loan_amnt int, grade string")


def test_only_resolved_statuses_kept_and_labelled(spark):
    out = raw(spark).transform(clean_and_label).collect()
    assert {r.loan_status for r in out} == {"Fully Paid", "Charged Off"}
    assert len(out) == 8
    for r in out:
        assert r.target_default == (1 if r.loan_status == "Charged Off" else 0)


def test_strings_stripped_of_unicode_whitespace(spark):
    out = raw(spark).transform(clean_and_label).collect()
    assert all(r.grade == r.grade.strip() for r in out)
    assert {r.grade for r in out} <= set("ABCDE")


def test_padded_status_is_kept(spark):
    df = spark.createDataFrame([(" Fully Paid ", 1)], "loan_status string, x int")
    assert df.transform(clean_and_label).count() == 1


def test_leaky_columns_dropped_and_absent_ignored(spark):
    cols = ["loan_status string", "loan_amnt int", "grade string"] + [
        f"{c} int" for c in LEAKY_COLUMNS]
    data = [tuple(["Fully Paid", 1000, "A"] + [1] * len(LEAKY_COLUMNS))] * 4
    df = spark.createDataFrame(data, ", ".join(cols))
    out = drop_leaky_columns(df)
    assert out.columns == ["loan_status", "loan_amnt", "grade"]
    assert len(LEAKY_COLUMNS) == 37
    # frames without any leaky column pass through
    assert drop_leaky_columns(out).columns == out.columns


def test_inf_to_null_and_align(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), float("nan"))],
                               "a double, b double")
    rows = inf_to_null(df).collect()
    assert rows[0].a is None and rows[1].a is None and rows[1].b is None
    al = align_columns(df, ["b", "zz", "a"])
    assert al.columns == ["b", "zz", "a"]
    assert al.collect()[0].zz is None


def test_empty_columns(spark):
    ref = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, e double")
    cur = spark.createDataFrame([(None, 1.0)], "x double, e double")
    assert empty_columns(ref, cur) == ["x", "e"]
    assert F  # keep import
