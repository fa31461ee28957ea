import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import toxicity

DOCS = "doc_id long, text string, score string, predicted int, toxic int"
LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "scum", "worthless", "clown"]


def texts(n, seed=4):
    """(id, text, toxic): invented prose, every fifth with insults strewn in."""
    draw = random.Random(seed)
    parts = ["er", "on", "th", "in", "lo", "mi", "sta", "re", "an", "ve", "du", "ca"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(1, 3)))
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(30, 200))]
        if i % 5 == 0:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(INSULTS)
        out.append((i, " ".join(words) + ".", int(i % 5 == 0)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = texts(400)
    docs = spark.createDataFrame([(i, t, "x", 7, 0) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_held_out_documents_are_told_apart(spark, learned):
    rows, docs, _, model = learned
    toxic = {i: y for i, _, y in rows}
    out = toxicity.classify(docs, model).collect()
    assert len(out) == 400 and out[0].asDict().keys() == {"doc_id", "text", "toxic", "held_out", "score", "predicted"}
    held = [r for r in out if r.held_out]
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    caught = [r.predicted for r in held if toxic[r.doc_id]]
    false = [r.predicted for r in held if not toxic[r.doc_id]]
    assert np.mean(caught) >= 0.9 and np.mean(false) <= 0.05 and len(caught) > 5


def test_accuracy_on_the_fixture(spark):
    sf = "/root/testdata/sf0.1/"
    docs, labels = (spark.read.parquet(f"{sf}{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = labels.select("doc_id", "toxic").where(toxicity.held_out(F.col("doc_id")))
    rows = toxicity.classify(docs.select("doc_id", "text").join(known, "doc_id"), model).select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic]
    false = [r.predicted for r in rows if not r.toxic]
    assert np.mean(caught) >= 0.7 and np.mean(false) <= 0.03 and len(caught) > 50


def test_only_texts_and_training_labels_matter(spark, learned):
    _, docs, labels, model = learned
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.repartition(7), turned.repartition(5))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary and (again.weights == model.weights).all()
    same = spark.createDataFrame([(1, "you clown, you scum", "a", 0, 0), (99, "you clown, you scum", "b", 1, 1)], DOCS)
    a, b = toxicity.classify(same, model).collect()
    assert a.score == b.score


def test_whole_texts_are_measured(spark, learned):
    _, _, _, model = learned
    clean = " ".join(t for i, t, y in texts(2000, seed=9) if not y and i % 3 == 0)
    rows = [(1, clean, None, None, None), (2, clean[:3000] + " idiot scum clown worthless scum clown", None, None, None)]
    a, b = toxicity.classify(spark.createDataFrame(rows, DOCS), model).orderBy("doc_id").collect()
    assert len(clean) > 300_000 and b.predicted == 1 and a.score < b.score
    measured = model.measure()(toxicity.windows(clean + " idiot"))
    assert len(measured) == len(toxicity.WORD.findall(clean)) + 1 and measured[-1] >= 3


def test_a_toxic_window_is_shorter_behind_the_toxic_dictionary():
    toxic, ordinary = toxicity.extended(toxicity.trained([], 256, [" house ", " river "]), [" idiot ", " clown "])
    assert toxic.endswith(toxicity.TAIL) and b" idiot " in toxic and b" river " in ordinary
    saved = toxicity.Measure(toxic, ordinary)([" idiot ", " house ", " xyz "])
    assert saved[0] >= 3 and saved[1] <= 0 and saved[2] == 0


def test_telling_groups_cover_one_after_another():
    toxic = [{" idiot ", " house ", " achlichpf ", " tree "}, {" idiot ", " achlichau "}, {" idiot ", " achlichen ", " lamp "}] * 4
    ordinary = [{" house ", " tree ", " lamp ", " zulicher ", " ach "}] * 40
    assert set(toxicity.telling_groups(toxic, ordinary)) == {" idiot ", " achlich"}
    assert toxicity.telling_groups(ordinary[:5], ordinary) == []


def test_logistic_is_the_minimum():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 3))
    y = (x.sum(axis=1) + 2 * draw.normal(size=60) > 0.5).astype(int)
    own = np.where(y == 1, 30 / y.sum(), 30 / (1 - y).sum())

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (own * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (w[:-1] ** 2).sum()

    w = toxicity.logistic(x, y)
    assert (w[:-1] > 0).all()
    assert all(loss(w) <= loss(w + draw.normal(size=4) * 10.0 ** -k) + 1e-6 for k in range(4) for _ in range(30))
    against = toxicity.logistic(np.column_stack([x, -x[:, 0]]), y)
    assert against[3] == 0 and (against[:3] > 0).all()


def test_edges(spark, learned):
    _, docs, labels, model = learned
    odd = spark.createDataFrame([(None, None, "x", 1, 1), (1, "", None, None, None), (1, "", None, None, None),
                                 (2, "ab " * 60_000, None, None, None), (3, "\u0000 😀 ßé 漢字", None, None, None)], DOCS)
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].held_out and rows[1].score == rows[2].score == rows[0].score
    assert toxicity.classify(docs.where("false"), model).count() == 0
    one_kind = labels.where("toxic = 1")
    none = labels.where("false")
    assert toxicity.fit(docs, one_kind) is None and toxicity.fit(docs, none) is None
    rows = toxicity.classify(odd, None).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * 5
    more = labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], LABELS))
    assert toxicity.fit(docs, more).toxic == model.toxic


def test_sample_is_bounded(spark, learned):
    _, docs, labels, _ = learned
    sample = toxicity.labelled_sample(docs.union(docs.where("doc_id = 6")), labels, "toxic", "text", "doc_id", 40, 900).collect()
    assert 30 < len(sample) < 100 and all(len(r.text) <= 900 for r in sample) and 6 not in {r["_id"] for r in sample}
