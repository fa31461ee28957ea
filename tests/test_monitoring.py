import numpy as np
import pytest

from loanlens.operators import monitoring as mo


def snap(spark, seed, shift=0.0, target=True, empty=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(200):
        r = [float(rng.uniform(1000, 30000) + shift), "ABCD"[int(rng.integers(0, 4))]]
        if target:
            r.append(int(rng.integers(0, 2)))
        if empty:
            r.append(None)
        rows.append(tuple(r))
    schema = "loan_amnt double, grade string" + (", target_default int" if target else "") + (
        ", empty double" if empty else "")
    return spark.createDataFrame(rows, schema)


def test_drift_table_sections_and_empty_column(spark):
    t = mo.drift_table(snap(spark, 1, empty=True), snap(spark, 2, shift=20000, empty=True))
    rows = {(r.section, r.column): r for r in t.collect()}
    assert ("features", "empty") not in rows
    assert rows[("features", "loan_amnt")].drifted
    moved = rows[("features", "loan_amnt")]
    assert moved.method == "wasserstein_normed" and moved.ks_p_value < 1e-6 and moved.psi > 0.2
    assert rows[("features", "grade")].chi2_statistic is not None
    assert ("target", "target_default") in rows
    assert mo.dataset_drift(t).first().n_columns == 2


def test_no_target_section_without_target(spark):
    t = mo.drift_table(snap(spark, 1, target=False), snap(spark, 2, target=False))
    assert {r.section for r in t.collect()} == {"features"}


def test_stat_helpers():
    assert mo.ks_pvalue(0.0, 100, 100) == 1.0
    assert mo.ks_pvalue(0.5, 200, 200) < 1e-10
    assert mo.chi2_pvalue(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-6)
    assert mo.chi2_pvalue(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-6)


def test_numeric_stats_identical_frames(spark):
    a = snap(spark, 3)
    s = mo.numeric_drift_stats(a, a, ["loan_amnt"]).first()
    assert s.ks_distance == 0.0 and s.wasserstein_normed == 0.0


def test_verdict_does_not_depend_on_size(spark):
    for n in (900, 2000):
        a = spark.range(n).selectExpr("5.0D AS v", "CAST(id % 7 AS DOUBLE) AS w")
        b = spark.range(n).selectExpr("9999.0D AS v", "CAST(id % 7 AS DOUBLE) AS w")
        for test in ("wasserstein_normed", "ks"):
            t = {r["column"]: r for r in mo.drift_table(a, b, numeric_test=test).collect()}
            assert t["v"].drifted and not t["w"].drifted and t["v"].method == test


def test_dates_unseen_categories_and_missing_sides(spark):
    a = spark.sql("SELECT date_add(DATE '2020-01-01', CAST(id AS INT)) d, 'x' c, CAST('NaN' AS DOUBLE) n, "
                  "1.0D k FROM range(50)")
    b = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) d, 'y' c, 3.0D n, "
                  "1.0D k FROM range(50)")
    t = {r["column"]: r for r in mo.drift_table(a, b, categorical_test="chisquare").collect()}
    assert set(t) == {"d", "c", "n", "k"}
    assert t["d"].drifted and t["c"].drifted and t["c"].chi2_statistic > 1000
    assert t["n"].ks_distance is None and not t["n"].drifted and not t["k"].drifted
    with pytest.raises(ValueError):
        mo.drift_table(a, b, numeric_test="none")
