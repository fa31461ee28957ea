import numpy as np
import pytest

from loanlens.operators import metrics as me


def frame(spark, y, s):
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "loan_id long, target_default int, score double")


def test_ks_perfect_ties_constant(spark):
    assert me.ks_statistic(frame(spark, [0] * 5 + [1] * 5, np.arange(1, 11) / 10)) == 1.0
    assert me.ks_statistic(frame(spark, [0, 0, 0, 0, 1, 1, 1, 1],
                                 [.1, .2, .3, .4, .3, .4, .5, .6])) == 0.5
    assert me.ks_statistic(frame(spark, [0, 1] * 5, [0.5] * 10)) == 0.0


def test_ks_is_one_sided(spark):
    # an inverted score separates perfectly but the one-sided KS is 0
    assert me.ks_statistic(frame(spark, [1] * 5 + [0] * 5, np.arange(1, 11) / 10)) == 0.0


def test_gini_and_auc(spark):
    assert me.gini_coefficient(frame(spark, [0] * 3 + [1] * 3, [.1, .2, .3, .7, .8, .9])) == 1.0
    assert me.gini_coefficient(frame(spark, [0, 0, 1, 1], [.1, .4, .35, .8])) == 0.5
    assert me.roc_auc(frame(spark, [0, 0, 1, 1], [.1, .4, .35, .8])) == 0.75


def test_auc_symmetry_and_single_class(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.random(300).round(2)
    a = me.roc_auc(frame(spark, y, s))
    b = me.roc_auc(frame(spark, y, -s))
    assert a + b == pytest.approx(1.0, abs=1e-6)
    assert me.roc_auc(frame(spark, [1, 1, 1], [.1, .2, .3])) is None


def test_decile_lift(spark):
    t = me.decile_lift_table(frame(spark, [1, 1, 1] + [0] * 7, list(range(10, 0, -1))),
                             score="score").orderBy("decile").collect()
    assert [r.n_events for r in t] == [1, 1, 1] + [0] * 7
    assert t[0].event_rate == 1.0
    assert t[0].lift == pytest.approx(1 / 0.3, rel=1e-5)
    assert all(r.cumulative_pct_events == 1.0 for r in t[2:])
    assert sum(r.n for r in t) == 10


def test_decile_matches_quantile_cut_of_positions(spark):
    import pandas as pd
    for n in (10, 103, 1237):
        rng = np.random.default_rng(n)
        y, s = rng.integers(0, 2, n), rng.integers(0, 20, n) / 20
        df = frame(spark, y, s)
        t = me.decile_lift_table(df, score="score").orderBy("decile").collect()
        # reference: sort by score desc (ties by id), qcut positions into 10 bins
        order = sorted(range(n), key=lambda i: (-s[i], i))
        dec = pd.qcut(np.arange(n), 10, labels=False) + 1
        exp = {d: 0 for d in range(1, 11)}
        for pos, i in enumerate(order):
            exp[dec[pos]] += 1
        assert [r.n for r in t] == [exp[d] for d in range(1, 11)]


def test_psi(spark):
    def one(vals):
        return spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert me.psi(one([1, 2, 3, 4, 5] * 4), one([1, 2, 3, 4, 5] * 4), "x") == 0.0
    got = me.psi(one([1] * 5 + [2] * 5), one([1] * 9 + [2]), "x", bins=2)
    assert got == pytest.approx(0.87889, abs=1e-4)
    rng = np.random.default_rng(0)
    assert me.psi(one(rng.normal(0, 1, 2000)), one(rng.normal(2, 1, 2000)), "x") > 0.25
    assert me.psi(one([3.0] * 10), one([1, 2, 3]), "x") == 0.0


def test_threshold_sweep_defaults(spark):
    ts = me.default_thresholds()
    assert len(ts) == 18 and ts[1] == 0.15000000000000002
    df = frame(spark, [0, 1, 1, 0], [.05, .5, .9, .95]).withColumnRenamed(
        "score", "probability_default")
    rows = me.sweep_thresholds(df).collect()
    assert rows[0].recall == 1.0 and rows[0].precision == pytest.approx(2 / 3, abs=1e-6)


def test_classification_and_reliability(spark):
    df = frame(spark, [0, 1, 1, 0], [.2, .5, .9, .6]).withColumnRenamed(
        "score", "probability_default")
    r = me.classification_metrics(df).first()
    # exactly 0.5 is class 0
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 1)
    bins = {b.bin: b for b in me.reliability_curve(df).collect()}
    assert set(bins) == {1, 4, 5, 8}


def test_vintage_auc(spark):
    import datetime as dt
    rows = [(dt.date(2019, 1, 1), 0, .1), (dt.date(2019, 1, 1), 1, .9),
            (dt.date(2019, 2, 1), 0, .9), (dt.date(2019, 2, 1), 1, .1),
            (dt.date(2019, 3, 1), 1, .5), (dt.date(2019, 3, 1), 1, .6)]
    df = spark.createDataFrame(rows, "issue_d date, target_default int, score double")
    got = {r.vintage: r.auc for r in me.per_vintage_auc(df).collect()}
    assert got == {"2019-01": 1.0, "2019-02": 0.0, "2019-03": None}
