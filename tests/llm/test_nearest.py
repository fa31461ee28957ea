import numpy as np
from pyspark.sql import functions as F

from loanlens.llm import nearest


def brute(vectors, is_query, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for a, i in enumerate(ids):
        if is_query(i):
            s = (x * x[a]).sum(axis=1) / (norm * norm[a])
            out[i] = sorted(((-s[b], j) for b, j in enumerate(ids) if j != i))[:k]
    return out


def test_matches_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(700, 24)).astype(np.float32)
    data[100:160] = data[5]  # one vector that many rows share
    data[200:210] = data[6] * np.linspace(1, 9, 10, dtype=np.float32)[:, None]
    data[300] *= np.float32(1e30)
    data[301] *= np.float32(1e-30)
    vectors = {i: data[i] for i in range(700)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest(df, F.col("id") % 5 == 0, block=64, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(vectors, lambda i: i % 5 == 0, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [f[1] for f in found] == [j for _, j in want[q]]
        np.testing.assert_allclose([f[2] for f in found], [-s for s, _ in want[q]], rtol=0, atol=1e-15)


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e-20, 1e20):
        x = rng.normal(size=(50, 300)) ** 3 * scale
        side = nearest.Side.__new__(nearest.Side)
        side.codes, side.scale, side.lost = nearest.quantise(x)
        near, off = nearest.approximate(side, side)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert (np.abs(unit @ unit.T - near) <= off).all() and off.max() < 0.2


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, [1.0, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (6, [1.0, 1.0]), (50, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = sorted((tuple(r)[:3] for r in nearest.nearest(df, F.col("id") % 50 == 0).collect()))
    # both rows 6 are candidates, and so is the row without an id, after the named ones of its score
    assert [x for x in got if x[1] > 2] == [(0, 3, 6), (0, 4, 6), (50, 3, 6), (50, 4, 6)]
    assert {x for x in got if x[1] <= 2} == {(0, 1, 50), (0, 2, None), (50, 1, 0), (50, 2, None)}


def test_rows_repeating_an_id_are_candidates_and_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (None, [1.0, -0.2]),
            (50, [0.0, 2.0]), (50, [0.0, 2.0]), (50, [3.0, 3.0]), (None, [1.0, -0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("id") % 50 == 0, k=3, block=2, query_block=2).collect()
    x = np.array([v for _, v in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    want = []
    for i, (q, _) in enumerate(rows):
        if q is not None and q % 50 == 0:
            s = (x * x[i]).sum(axis=1) / (norm * norm[i])
            best = sorted((-s[j], rows[j][0] is None, rows[j][0] or 0, j) for j in range(len(rows)) if j != i)[:3]
            want += [(q, r, rows[j][0], -d) for r, (d, _, _, j) in enumerate(best, 1)]
    key = lambda t: (t[0], t[1], t[2] is None, t[2] or 0, t[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], atol=1e-15)
    assert (0, 1, 1) in {g[:3] for g in got}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(empty, F.col("id") % 50 == 0).count() == 0


def test_pieces_of_a_tile_give_the_best_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    x[50:70] = x[3]  # ties beyond a piece
    ids = np.arange(90)[::-1].copy()
    side = nearest.Side(np.arange(90), ids, ids % 7 > 0, x)
    monkeypatch.setattr(nearest, "PIECE", (4, 16))
    qi, ci, score = nearest.tile_best(side.part(0, 9), side, 5)
    for i in range(9):
        s = nearest.cosine(x, np.broadcast_to(x[i], x.shape))
        want = sorted((-s[j], ids[j] % 7 == 0, ids[j], j) for j in range(90) if j != i)[:5]
        assert ci[qi == i].tolist() == [w[3] for w in want]
        np.testing.assert_allclose(score[qi == i], [-w[0] for w in want], rtol=0, atol=1e-15)


def test_tasks_get_no_batch_of_tiles(spark):
    """A joined row held a whole block of candidates, an Arrow batch up to 10,000 of them."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))],
                               "vec_id long, embedding array<float>")
    got = nearest.nearest(df, F.col("id") % 2 == 0, block=32, query_block=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    block = nearest.packed(df.selectExpr("vec_id AS row", "vec_id AS id", "embedding AS v"), 1).first()
    assert len(block.vectors) == 300 * 8 * 4  # as stored, not doubles
    assert got.count() == 150 * 5
