import pytest
from pyspark.sql import functions as F

from loanlens.operators import metrics as me
from loanlens.operators.splits import time_based_split


def test_lift_without_events(spark):
    df = spark.range(40).selectExpr("id AS loan_id", "0 AS target_default", "id / 40.0 AS p")
    rows = me.decile_lift_table(df, "target_default", "p").collect()
    assert len(rows) == 10
    assert {(r.n_events, r.lift, r.cumulative_pct_events, r.cumulative_lift) for r in rows} == {(0, None, None, None)}


def test_text_keys_rank_and_split_like_sorted_keys(spark):
    keys = [f"LC{i:04d}" for i in range(200)]
    df = spark.createDataFrame([(k, "Jan-2020", int(i % 3 == 0), 0.5) for i, k in enumerate(reversed(keys))],
                               "loan_id string, issue_d string, target_default int, p double")
    split = {r.loan_id: r.split for r in time_based_split(df, "issue_d").collect()}
    assert split == {k: "train" if i < 140 else "val" if i < 170 else "test" for i, k in enumerate(keys)}
    assert sum(r.n for r in me.decile_lift_table(df, "target_default", "p").collect()) == 200


def test_vintages_of_month_texts_and_missing_dates(spark):
    rows = [("Jan-2019", 1, 0.9), ("Jan-2019", 0, 0.1), ("Feb-2019", 1, 0.2), (None, 1, 0.5), ("soon", 0, 0.5)]
    df = spark.createDataFrame(rows, "issue_d string, target_default int, probability_default double")
    got = {r.vintage: (r.auc, r.n) for r in me.per_vintage_auc(df, "issue_d", "target_default",
                                                               "probability_default").collect()}
    assert got == {"2019-01": (1.0, 2), "2019-02": (None, 1)}


@pytest.fixture()
def raw_csv(tmp_path):
    def write(*lines):
        path = tmp_path / "loans.csv"
        path.write_text("\n".join(lines) + "\n")
        return path
    return write


def test_raw_columns_are_typed_by_content(spark, raw_csv):
    from loanlens.sources.readers import load_raw_data
    df = load_raw_data(spark, raw_csv("id,open_act_il,int_rate,empty,note", ",10,13.5%,,a", ",,7.1,,a", ",20,8,,7"))
    assert dict(df.dtypes) == {"id": "double", "open_act_il": "double", "int_rate": "string",
                               "empty": "double", "note": "string", "loan_id": "bigint"}
    assert sorted(r.int_rate for r in df.collect()) == ["13.5%", "7.1", "8"]


def test_keys_are_unique_and_follow_the_rows(spark, raw_csv):
    from loanlens.sources.readers import load_raw_data
    lines = ["id,v"] + [f",{i % 5}" for i in range(30)]
    a = load_raw_data(spark, raw_csv(*lines))
    keys = sorted((r.v, r.loan_id) for r in a.collect())
    assert len({k for _, k in keys}) == 30
    b = load_raw_data(spark, raw_csv(lines[0], *reversed(lines[1:]))).repartition(7)
    assert sorted((r.v, r.loan_id) for r in b.collect()) == keys
    c = load_raw_data(spark, raw_csv("id,v", "7,a", "8,b"))
    assert sorted(r.loan_id for r in c.collect()) == [7, 8]
    d = load_raw_data(spark, raw_csv("id,v", "7,a", "7,b"))
    assert d.select(F.countDistinct("loan_id")).first()[0] == 2 and 7 not in [r.loan_id for r in d.collect()]
