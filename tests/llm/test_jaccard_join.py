import itertools
import random

import numpy as np
import pytest

from loanlens.llm import jaccard_join, shingles
from loanlens.llm.components import components


def brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], links


def corpus(seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "one", "two words", "two  words", "a b c d", "a b c d e"]
    passage = [rnd.choice(words) for _ in range(60)]
    for _ in range(12):  # texts, their copies and copies with a few words changed
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 400))]
        texts += [" ".join(base)] * rnd.randint(1, 3)
        for _ in range(rnd.randint(0, 6)):
            other = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 60))):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            texts.append(" ".join(other))
    for _ in range(25):  # unrelated texts that share a passage
        own = [rnd.choice(words) for _ in range(rnd.randint(100, 300))]
        at = rnd.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    rnd.shuffle(texts)
    return texts


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard_join.similarity_classes(docs, **options).collect()}
    classes, links = brute(texts)
    assert [got[i].class_id for i in range(len(texts))] == classes
    assert [got[i].n_links for i in range(len(texts))] == links


def test_matches_brute_force(spark):
    check(spark, corpus())


def test_large_buckets_and_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 6)
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(40)]
    check(spark, near + corpus(4)[:30], bucket=4)


def test_runs_reach_the_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    runs, found = jaccard_join.runs_needed(), 0
    for _ in range(200):
        both = rng.integers(0, 2 ** 63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 2 ** 63, 20, dtype=np.uint64)))) for _ in "ab")
        paths = [shingles.chosen_paths(s, runs, 3, 0.8, 11)[2][0] for s in (a, b)]
        found += bool(set(paths[0]) & set(paths[1]))
    assert found >= 198


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    for n in (9, 40, 400):
        for _ in range(100):
            both = rng.integers(0, 2 ** 63, 8 * n, dtype=np.uint64)
            sets = [np.unique(np.concatenate((both, rng.integers(0, 2 ** 63, n, dtype=np.uint64)))) for _ in "ab"]
            a, b = (np.frombuffer(shingles.sketch(s), np.uint8)[None, :] for s in sets)
            assert shingles.alike(a, b, 0.8).all()


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    got = jaccard_join.intersections(sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, i) for i in range(9)],
    [(1, 2), (3, 4), (2, 3), (7, 8), (5, 5)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_one_of_each(spark):
    texts = corpus(6)
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[20], "x"), (3, texts[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes, _ = brute([r[1] for r in rows])
    wordless = sum(not (r[1] or "").split() for r in rows)
    with_words = {c for c, r in zip(classes, rows) if (r[1] or "").split()}
    ids = [r.doc_id for r in kept.collect() if (r.text or "").split()]
    assert kept.count() == wordless + len(with_words) and sorted(ids) == sorted(
        min(i for i, c in enumerate(classes[:len(texts)]) if c == k) for k in with_words)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similarity_classes(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0
