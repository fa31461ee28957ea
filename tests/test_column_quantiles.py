import numpy as np
import pandas as pd

from loanlens.operators.ranking import column_quantiles
from loanlens.plans import jobs
from loanlens.sources.fixture import loan_view


def frame(n=5000):
    rng = np.random.default_rng(3)
    odd = rng.normal(size=n)
    odd[::7], odd[1::7], odd[2::50] = np.nan, 0.0, -0.0
    return {"odd": odd, "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n), "code": rng.integers(0, 3, n) * 1.0,
            "close": 1 + rng.integers(0, 900, n) * 2.0 ** -52, "below": -np.abs(rng.lognormal(9, 4, n)),
            "ends": np.where(rng.random(n) < 0.4, np.inf, -rng.random(n))}


def test_matches_numpy(spark, monkeypatch):
    values = frame()
    df = spark.createDataFrame(pd.DataFrame(values)).repartition(5)
    monkeypatch.setattr("loanlens.operators.ranking.BLOCK_ROWS", 300)
    probs = [0.0, 0.25, 0.5, 0.613, 1.0]
    got = column_quantiles(df, list(values), probs, finite=True)
    for c, x in values.items():
        assert got[c] == [float(q) for q in np.quantile(x[np.isfinite(x)], probs)], c
    assert column_quantiles(df, ["ends"], [0.2, 0.9])["ends"] == [np.quantile(values["ends"], 0.2), np.inf]


def test_gaps_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (4, None), (None, float("nan"))], "a int, b double")
    assert column_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.5], "b": None}
    assert column_quantiles(df.where("false"), ["a"], [0.5]) == {"a": None}
    assert column_quantiles(df, [], [0.5]) == {}


def test_preparation_writes_no_vector_and_compiles(spark, monkeypatch):
    """The matrix is written once by column; wide steps run under the limit of compiled methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(name), {}
    materialize = jobs.materialize

    def watched(df, what):
        seen[what] = (spark.conf.get(name), "features" in df.columns)
        return materialize(df, what)

    monkeypatch.setattr(jobs, "materialize", watched)
    data = jobs.prepare_training(spark, loan_view(spark, "/root/testdata/sf0.001"))
    assert seen == {w: ("8000", False) for w in ("train-base", "split", "matrix")}
    assert spark.conf.get(name) == before and "features" in data.matrix.columns
    train = data.matrix.where("split = 'train'").toPandas()
    assert data.defaults == {c: float(train[c].median()) for c in data.prep.feature_names}
