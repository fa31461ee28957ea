import importlib


def test_entry_and_registry(spark):
    mod = importlib.import_module("__spark_entry__")
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["dti_segment", "borrower_count", "default_rate"]
    qs, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 65


def test_fixture_golden_counts(spark):
    from loanlens.plans import frames as fr
    df = fr.cleaned(spark, "/root/testdata/sf0.01")
    assert df.count() == 9912
    from loanlens.operators.reports import dti_segmentation
    got = {r.dti_segment: (r.borrower_count, r.default_rate)
           for r in dti_segmentation(df).collect()}
    assert got == {"Moderate DTI": (2475, 50.30), "Very High DTI": (3580, 50.00),
                   "Low DTI": (1233, 49.88), "High DTI": (2624, 48.89)}


def test_matrix_constants_match_prep(spark):
    from loanlens.operators.matrix import MatrixPrep
    from loanlens.plans import frames as fr
    from loanlens.plans.catalog import FEATURE_TABLE
    from loanlens.plans.catalog_models import MATRIX_CATEGORICAL, MATRIX_NUMERIC
    feats = fr.features(spark, "/root/testdata/sf0.001")
    assert [(c, t) for c, t in feats.dtypes] == list(FEATURE_TABLE)
    prep = MatrixPrep().fit(feats)
    assert sorted(prep.numeric_columns) == sorted(MATRIX_NUMERIC)
    assert sorted(prep.categorical_columns) == sorted(MATRIX_CATEGORICAL)
