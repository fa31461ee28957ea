import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators.ranking import (assign_segments, exact_quantiles,
                                        grouped_exact_quantiles, running_totals)


def test_running_totals_brute_force(spark):
    rng = np.random.default_rng(1)
    vals = sorted(set(rng.integers(0, 5000, 800).tolist()))
    w = rng.integers(1, 9, len(vals))
    df = spark.createDataFrame([(int(v), int(c)) for v, c in zip(vals, w)], "v long, c long")
    for desc in (False, True):
        got = {r.v: r.cum_c for r in running_totals(df, "v", ["c"], descending=desc,
                                                    n_buckets=7).collect()}
        order = vals[::-1] if desc else vals
        acc, exp = 0, {}
        for v in order:
            acc += int(w[vals.index(v)])
            exp[v] = acc
        assert got == exp


def test_segments_with_hot_key(spark):
    # one order value holds a third of the rows and straddles cuts
    n = 900
    vals = [5] * 300 + list(range(600))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "id long, v long")

    def seg(pos, n):
        return F.when(pos < int(n * 0.7), 0).when(pos < int(n * 0.85), 1).otherwise(2)

    out, total = assign_segments(df, "v", "id", seg, n_buckets=6)
    assert total == n
    got = {r.id: r.segment for r in out.collect()}
    order = sorted(range(n), key=lambda i: (vals[i], i))
    for pos, i in enumerate(order):
        exp = 0 if pos < 630 else 1 if pos < 765 else 2
        assert got[i] == exp


def test_same_result_at_1_and_8_partitions(spark):
    df = spark.createDataFrame([(i, i % 37) for i in range(500)], "id long, v long")

    def seg(pos, n):
        return (pos * 10 / n).cast("int")

    a, _ = assign_segments(df.coalesce(1), "v", "id", seg, n_buckets=1)
    b, _ = assign_segments(df.repartition(8), "v", "id", seg, n_buckets=8)
    assert sorted(a.collect()) == sorted(b.collect())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(10, 3, 1001), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0, .1, .25, .5, .75, .9, 1]
    got = exact_quantiles(df, "x", probs, n_buckets=5)
    assert got == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-9)
    long = df.select(F.lit("a").alias("k"), "x").unionByName(
        df.select(F.lit("b").alias("k"), (F.col("x") * 2).alias("x")))
    g = {(r.k, r.q): r.value for r in grouped_exact_quantiles(long, "k", "x", [.5]).collect()}
    assert g[("a", .5)] == pytest.approx(np.median(x))
    assert g[("b", .5)] == pytest.approx(np.median(x * 2))


def test_fixture_metrics_invariant_to_partitioning(spark):
    from loanlens.operators import metrics as me
    from loanlens.plans import frames as fr
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            s = fr.split_scored(spark, "/root/testdata/sf0.001")
            p = "probability_default"
            out.append((
                sorted(tuple(r) for r in me.decile_lift_table(s, score=p).collect()),
                tuple(me.binary_metrics(s, score=p).first()),
                me.psi(s.filter("split = 'train'"), s.filter("split = 'test'"), p),
                sorted((r.loan_id, r.split) for r in s.select("loan_id", "split").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


@pytest.mark.parametrize("accuracy", [20, 300])
def test_brackets_enclose_every_quantile(spark, accuracy, monkeypatch):
    """With coarse sketches most values fall between brackets, and the
    quantiles stay exact."""
    from loanlens.operators import ranking
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    monkeypatch.setattr(ranking.bracketed_counts, "__defaults__", (accuracy,))
    rng = np.random.default_rng(accuracy)
    columns = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 7, 3000).astype(float),
               "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.random(3000) * 10), "one": np.full(50, 2.5),
               "two": np.array([1.0, 2.0]), "tails": np.concatenate((rng.random(500), [-1e300, 1e300]))}
    rows = [(k, float(x)) for k, v in columns.items() for x in v] + [("none", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r.k, r.q): r.value for r in grouped_exact_quantiles(df, "k", "x", probs).collect()}
    assert set(got) == {(k, q) for k in columns for q in probs}
    for k, v in columns.items():
        for q in probs:
            assert got[k, q] == pytest.approx(float(np.quantile(v, q)), rel=1e-12), (k, q)
    assert exact_quantiles(df.where("k = 'normal'"), "x", probs) == pytest.approx(
        [float(np.quantile(columns["normal"], q)) for q in probs])
    long = df.where("x is not null and not isnan(x)").selectExpr("k as _k", "x as _v")
    counted = ranking.bracketed_counts(long, [0.5])
    assert counted.agg(F.sum("_c")).first()[0] == sum(map(len, columns.values()))
    if accuracy == 300:
        assert counted.count() < 500  # of some 6,500 distinct values


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "k string, x double")
    assert exact_quantiles(df, "x", [0.5]) is None
    assert grouped_exact_quantiles(df, "k", "x", [0.5]).count() == 0


def test_column_medians_take_few_passes(spark):
    """A sketch and a counting pass; what follows reads the counts, not the rows."""
    from loanlens.operators.matrix import column_medians, median_table
    rng = np.random.default_rng(5)
    n = 30_000
    odd = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
    odd[:5] = [np.inf, -np.inf, 0.0, -0.0, 1e300]
    frame = {"odd": odd, "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.0),
             "skewed": np.exp(rng.normal(size=n) * 5), "gone": np.full(n, np.nan)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in frame.values()))), ", ".join(f"{c} double" for c in frame))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = column_medians(df.mapInPandas(counted, df.schema), list(frame))
    assert read.value == 2 * n
    want = {c: float(np.median(v[np.isfinite(v)])) if c != "gone" else None for c, v in frame.items()}
    assert got.pop("gone") is want.pop("gone") is None and got == pytest.approx(want, rel=1e-12)
    assert {r["column"]: r["median"] for r in median_table(df, list(frame)).collect()} == pytest.approx(want, rel=1e-12)
    assert column_medians(df.where("false"), ["odd"]) == {"odd": None}
