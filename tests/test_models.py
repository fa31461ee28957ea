import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from loanlens.operators import explain as ex
from loanlens.operators import training as tr


def labelled(spark, n, pos):
    return spark.createDataFrame([(i, 1 if i < pos else 0) for i in range(n)],
                                 "loan_id long, target_default int")


def test_scale_pos_weight(spark):
    assert tr.compute_scale_pos_weight(labelled(spark, 100, 10)) == 9.0
    assert tr.compute_scale_pos_weight(labelled(spark, 6, 2)) == 2.0
    assert tr.compute_scale_pos_weight(labelled(spark, 5, 0)) == 1.0


def test_balanced_weights(spark):
    w = {r.target_default: r.w for r in tr.with_weights(labelled(spark, 100, 10), "balanced")
         .select("target_default", "w").distinct().collect()}
    assert w[1] == pytest.approx(100 / 20) and w[0] == pytest.approx(100 / 180)


def test_unknown_model_raises(spark):
    with pytest.raises(ValueError):
        tr.train(labelled(spark, 4, 2), "svm")


@pytest.fixture(scope="module")
def uniform(spark):
    rng = np.random.default_rng(0)
    X = rng.random((400, 4))
    y = (X[:, 0] + X[:, 1] > 1).astype(int)
    rows = [(i, int(y[i]), *map(float, X[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "loan_id long, target_default int, a double, b double, "
                                     "c double, d double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


def test_calibration_valid_probabilities(uniform):
    train = uniform.filter("loan_id < 200")
    val = uniform.filter("loan_id >= 200")
    model = tr.train(train, "random_forest", numTrees=10, maxDepth=4)
    before = [r.p_raw for r in tr.score(model, val).collect()]
    iso = tr.fit_isotonic(tr.score(model, val))
    cal = tr.apply_isotonic(iso, tr.score(model, val), "p_raw", "p_cal").collect()
    assert all(0.0 <= r.p_cal <= 1.0 for r in cal)
    # the base model is untouched
    assert [r.p_raw for r in tr.score(model, val).collect()] == before


def test_tree_shap_additivity_and_importance(uniform):
    names = ["a", "b", "c", "d"]
    for name, params in (("xgboost", {"maxIter": 5, "maxDepth": 3}),
                         ("random_forest", {"numTrees": 5, "maxDepth": 4})):
        model = tr.train(uniform, name, **params)
        shap = ex.tree_shap(uniform, model, names, keep=["loan_id", *names])
        sc = {r.loan_id: r.p_raw for r in tr.score(model, uniform).collect()}
        for r in shap.collect():
            p = sc[r.loan_id]
            target = np.log(p / (1 - p)) if name == "xgboost" else p
            assert r.model_output == pytest.approx(target, abs=1e-6)
        imp = ex.global_importance(shap, names).collect()
        assert {r.feature for r in imp} == set(names)
        assert imp[0].feature in ("a", "b")
        reasons = ex.local_explanation(shap, names, n=3).filter("loan_id = 0").collect()
        assert [r.rank for r in reasons] == [1, 2, 3]
        assert reasons[0].magnitude >= reasons[1].magnitude >= reasons[2].magnitude
        assert all(r.direction == ("increases_risk" if r.shap_value > 0 else "decreases_risk")
                   for r in reasons)


def test_top_feature_names(uniform):
    model = tr.train(uniform, "random_forest", numTrees=5, maxDepth=3)
    top = tr.top_feature_names(model, ["a", "b", "c", "d"], 2)
    assert set(top) == {"a", "b"}


@pytest.mark.parametrize("query", [
    "train_logistic", "train_forest", "train_boosted", "model_comparison", "calibrate_isotonic", "global_importance",
    "local_reasons", "shap_sample_importance", "score_batch", "score_stream"])
def test_registered_queries_train_full_sizes(monkeypatch, query):
    from unittest.mock import MagicMock

    from loanlens.plans import catalog_models as cm
    from loanlens.plans.registry import queries

    class Reached(Exception):
        pass

    def trained(*args, **params):
        raise Reached(args, params)

    for name in ("run_training", "compare_models"):
        monkeypatch.setattr(cm, name, trained)
    monkeypatch.setattr(cm.tr, "train", trained)
    for name in ("loan_view", "materialize", "MatrixPrep", "applications_from_loans"):
        monkeypatch.setattr(cm, name, MagicMock())
    monkeypatch.setattr(cm.fr, "split_features", MagicMock())
    with pytest.raises(Reached) as reached:
        queries()[query](None, "")
    args, params = reached.value.args
    assert not {"maxIter", "numTrees", "maxDepth"} & set(params)
    if query == "model_comparison":
        assert args[-1] == {"logistic": {}, "random_forest": {}, "xgboost": {}}


def test_library_sizes_are_those_of_the_survey(spark):
    from loanlens.operators.training import _boosted, _forest, _logistic
    size = lambda p, *names: tuple(p.getStages()[-1].getOrDefault(n) for n in names)
    assert size(_logistic(10, "y", {}), "maxIter") == (1000,)
    assert size(_forest(10, "y", {}), "numTrees", "maxDepth") == (100, 10)
    assert size(_boosted(10, "y", {}), "maxIter", "maxDepth") == (100, 6)


def test_comparison_prepares_its_table_once(spark, monkeypatch):
    """Split, matrix and defaults are the same for every model, and no scores stay in the executors."""
    from loanlens.plans import jobs
    from loanlens.sources.fixture import loan_view
    written = []
    materialize = jobs.materialize
    monkeypatch.setattr(jobs, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = jobs.compare_models(spark, loan_view(spark, "/root/testdata/sf0.001"),
                              {"logistic": {"maxIter": 3}, "random_forest": {"numTrees": 2, "maxDepth": 2}})
    assert [r.model for r in out.collect()] == ["logistic", "random_forest"]
    assert [written.count(n) for n in ("train-base", "split", "matrix", "scored-test")] == [1, 1, 1, 2]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
