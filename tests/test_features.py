import math

import pytest

from loanlens.operators.features import (FEATURE_COLUMNS, build_features,
                                         padded_loan_size_bucket)

SCHEMA = ("annual_inc double, loan_amnt int, revol_util double, dti double, emp_length string, "
          "issue_d string, earliest_cr_line string, inq_last_6mths double, "
          "delinq_2yrs double, revol_bal double, installment int")
ROWS = [
    (0.0, 8000, 45.0, 18.0, "10+ years", "Jan-2019", "Jan-2010", 0.0, 0.0, 5000.0, 300),
    (None, 2000, None, None, None, None, None, None, None, None, 60),
    (60000.0, 15000, 30.0, 999.0, "< 1 year", "Feb-2019", "Mar-2012", 2.0, 6.0, 1000.0, 450),
    (60000.0, 10000, 60.0, 10.0, "1 year", "Mar-2018", "Mar-2015", 7.0, 1.0, 2000.0, 700),
    (50000.0, 25000, 90.0, 30.0, "2 years", "Apr-2018", "Apr-2010", 1.0, 2.0, 3000.0, 500),
    (40000.0, 5000, 10.0, 5.0, "3 years", "May-2017", "May-2007", 3.0, 3.0, 100.0, 100),
    (45000.0, 7000, 70.0, 25.0, "4 years", "Jun-2017", "Jun-2016", 4.0, 4.0, 150.0, 200),
    (70000.0, 12000, 95.0, 35.0, "5 years", "Jul-2016", "Jul-2006", 5.0, 5.0, 160.0, 250),
    (80000.0, 20000, 20.0, 15.0, "6 years", "Aug-2016", "Aug-2010", 6.0, 0.0, 170.0, 350),
    (90000.0, 22000, 50.0, 22.0, "7 years", "Sep-2015", "Sep-2005", 0.0, 1.0, 180.0, 400),
    (100000.0, 3000, 80.0, 28.0, "8 years", "Oct-2015", "Oct-2012", 1.0, 2.0, 190.0, 600),
    (110000.0, 9000, 100.0, 40.0, "9 years", "Nov-2014", "Nov-2004", 2.0, 3.0, 200.0, 650),
]


@pytest.fixture(scope="module")
def feats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {r.loan_amnt: r for r in build_features(df).collect()}, df


def test_adds_twelve_columns_same_rows(feats, spark):
    rows, df = feats
    out = build_features(df)
    assert set(out.columns) - set(df.columns) == set(FEATURE_COLUMNS)
    assert len(FEATURE_COLUMNS) == 12
    assert out.count() == df.count()
    assert df.columns[5] == "issue_d" and dict(df.dtypes)["issue_d"] == "string"


def test_ratios_and_zero_income(feats):
    rows, _ = feats
    assert rows[10000].income_to_loan_ratio == pytest.approx(60000 / 10000)
    z = rows[8000]
    assert z.income_to_loan_ratio == 0.0
    assert math.isinf(z.revol_bal_to_income) and math.isinf(z.installment_to_income)


def test_buckets_left_open(feats):
    rows, _ = feats
    assert rows[8000].revol_util_bucket == "moderate"
    assert rows[15000].revol_util_bucket == "low"       # 30 is in (0, 30]
    assert rows[25000].revol_util_bucket == "high"      # 90 in (60, 90]
    assert rows[8000].dti_bucket == "moderate_dti"
    assert rows[15000].dti_bucket is None               # 999 outside the bins
    assert rows[2000].dti_bucket is None


def test_employment(feats):
    rows, _ = feats
    assert rows[8000].emp_length_clean == 10 and rows[8000].employment_stability == "medium_term"
    assert rows[2000].emp_length_clean == 0 and rows[2000].employment_stability == "new"
    assert rows[15000].emp_length_clean == 1 and rows[15000].employment_stability == "new"


def test_credit_history_and_risk_buckets(feats):
    rows, _ = feats
    assert 8.9 < rows[8000].credit_history_years < 9.1
    assert rows[2000].credit_history_years is None
    assert rows[8000].inquiry_risk_bucket == "low_inquiry"
    assert rows[15000].inquiry_risk_bucket == "moderate_inquiry"
    assert rows[8000].delinquency_risk == "no_delinquency"
    assert rows[15000].delinquency_risk == "high_delinquency"
    r7 = [r for r in rows.values() if r.inq_last_6mths == 7.0][0]
    assert r7.inquiry_risk_bucket == "very_high_inquiry"


def test_loan_size_and_exposure(feats):
    rows, _ = feats
    assert all(r.loan_size_bucket is not None for r in rows.values())
    assert rows[2000].loan_size_bucket == "small"      # the minimum is included
    assert rows[25000].loan_size_bucket == "very_large"
    assert rows[8000].credit_exposure_score == 45 + 18 + 0
    assert rows[2000].credit_exposure_score == 0


def test_duplicate_quartile_edges_raise(spark):
    df = spark.createDataFrame([(1000,)] * 5 + [(2000,)], "loan_amnt int")
    from loanlens.operators.features import loan_size_edges
    with pytest.raises(ValueError):
        loan_size_edges(df)


def test_padded_serving_quartiles(spark):
    import numpy as np
    amounts = [500.0, 1000.0, 8000.0, 12000.0, 40000.0, 50000.0]
    df = spark.createDataFrame([(a,) for a in amounts], "loan_amnt double")
    got = [r[0] for r in df.select(padded_loan_size_bucket()).collect()]
    labels = ["small", "medium", "large", "very_large"]
    for a, g in zip(amounts, got):
        arr = np.array([a, 1000.0, 8000.0, 15000.0, 25000.0, 40000.0])
        q = np.quantile(arr, [0, .25, .5, .75, 1])
        idx = 0 if a <= q[1] else 1 if a <= q[2] else 2 if a <= q[3] else 3
        assert g == labels[idx]


def test_text_numbers_with_gaps_are_numeric(spark):
    from loanlens.operators import matrix as mx
    rows = [(0, "1", "a", None, "7"), (1, None, "nan", None, "NaN"), (2, "2", None, None, ""), (3, "nan", "b", None, "9.5"),
            (4, "6", "1", None, None)]
    df = spark.createDataFrame([(*r, 1.0, 0) for r in rows],
                               "loan_id long, n string, c string, e string, f string, x double, target_default int")
    model = mx.MatrixPrep().fit(df)
    assert set(model.coerced_columns) == {"n", "e", "f"} and model.vocabulary == {"c": ["1", "a", "b", "nan"]}
    assert model.medians["n"] == 2.0 and model.medians["f"] == 8.25 and model.medians["e"] is None
    got = {r.loan_id: (r.n, r.c, r.e, r.f) for r in model.transform(df, assemble=False).collect()}
    assert got == {0: (1.0, 1.0, None, 7.0), 1: (2.0, 3.0, None, 8.25), 2: (2.0, 3.0, None, 8.25),
                   3: (2.0, 2.0, None, 9.5), 4: (6.0, 0.0, None, 8.25)}


def test_one_dictionary_for_all_columns(spark):
    """Codes are places among a column's sorted values, wherever the sort cuts."""
    from loanlens.operators import matrix as mx
    rng = __import__("random").Random(1)
    rows = [(f"{rng.randrange(900):03d}", rng.choice("xyz"), rng.choice(["é", "e", "E", None]), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "`many/odd=name` string, few string, gaps string, none string").repartition(6)
    got = {}
    for r in mx.read_dictionary(spark, mx.dictionary(mx.column_values(df, df.columns))).collect():
        got.setdefault(r["column"], []).append((r["code"], r["value"]))
    for i, c in enumerate(df.columns):
        assert sorted(got.get(c, [])) == list(enumerate(sorted({r[i] for r in rows if r[i] is not None})))
    vocab, paths = mx.category_vocabulary(df, df.columns, max_literal=10)
    assert set(paths) == {"many/odd=name"} and vocab["gaps"] == ["E", "e", "nan", "é"] and vocab["none"] == ["nan"]
    one = mx.encode_with_table(df, "many/odd=name", paths["many/odd=name"], "code").select("many/odd=name", "code").distinct()
    values = sorted({r[0] for r in rows})
    assert dict(map(tuple, one.collect())) == {v: i for i, v in enumerate(values)}


def test_large_vocabulary_uses_distributed_code_table(spark):
    from loanlens.operators import matrix as mx
    rng = __import__("random").Random(3)
    words = [f"w{rng.randrange(10**6):06d}" for _ in range(400)] + [None] * 5
    df = spark.createDataFrame([(i, w, float(i % 7), i % 2) for i, w in enumerate(words)],
                               "loan_id long, title string, x double, target_default int")
    model = mx.MatrixPrep(max_literal_vocabulary=50).fit(df)
    assert "title" in model.code_tables and "title" not in model.vocabulary
    got = {r.loan_id: r.title for r in model.transform(df, assemble=False).collect()}
    vocab = sorted({w if w is not None else "nan" for w in words})
    for i, w in enumerate(words):
        assert got[i] == vocab.index(w if w is not None else "nan")
    unseen = spark.createDataFrame([(999, "zzz", 1.0, 0)], df.schema)
    assert model.transform(unseen, assemble=False).first().title == -1
