import zlib

from loanlens.llm import classifier

GOOD = "Clear words about some {} thing, written for people who read them one after another."
BAD = "BUY{}!! NOW!! ### $$$ %%% CLICK!! | MENU | HOME | &&& *** ###"


def corpus(spark, n=300):
    rows = [(i, (GOOD if i % 4 else BAD).format(f"x{i}"), None) for i in range(n)]
    labels = [(i, int(bool(i % 4)), 0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus(spark)
    weights, threshold = classifier.fit(docs, labels)
    rows = classifier.classify(docs, weights, threshold).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(bool(r.doc_id % 4)) == int(r.score >= 0.3) and 0 <= r.score <= 1
    assert any(r.held_out for r in rows)


def test_accuracy_on_the_fixture(spark):
    sf = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(sf + "documents.parquet"), spark.read.parquet(sf + "labels.parquet")
    out = classifier.classify(docs, *classifier.fit(docs, labels)).join(labels.select("doc_id", "quality"), "doc_id")
    rows = out.where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows) and len(rows) > 50


def test_only_texts_and_training_labels_matter(spark):
    docs, labels = corpus(spark)
    model = classifier.fit(docs, labels)
    turned = labels.withColumn("quality", classifier.F.when(
        classifier.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    assert classifier.fit(docs, turned) == model
    same = spark.createDataFrame([(1, "same text", "a"), (99, "same text", "b")], docs.schema)
    a, b = classifier.classify(same, *model).collect()
    assert a.score == b.score


def test_pairs_point_from_bad_to_good(spark):
    rows = [(i, i % 3 > 0, [float(i % 3 > 0), 1.0]) for i in range(30)]
    pairs = classifier.preference_pairs(spark.createDataFrame(rows, "_id long, good boolean, x array<double>")).collect()
    assert len(pairs) == 20 * classifier.ROUNDS and {p.label for p in pairs} == {0.0, 1.0}
    assert all(list(p.features) == ([1.0, 0.0] if p.label else [-1.0, 0.0]) for p in pairs)


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark)
    n = classifier.labelled_sample(docs, labels, "quality", "text", "doc_id", 60).count()
    assert 20 < n < 110


def test_edges(spark):
    docs, labels = corpus(spark, 60)
    none = labels.where("false")
    odd = spark.createDataFrame([(None, None, "x"), (1, "", None), (1, "", None), (2, "word " * 30000, None)], docs.schema)
    rows = classifier.classify(odd, *classifier.fit(docs, none)).collect()
    assert [r.score for r in rows] == [0.3] * 4 and [r.predicted for r in rows] == [1] * 4 and rows[0].held_out
    one_kind = labels.where("quality = 1")
    assert classifier.fit(docs, one_kind) == ([], 0.0)
    weights = classifier.fit(docs, labels.union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema)))
    rows = classifier.classify(odd, *weights).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 4
    assert classifier.classify(docs.where("false"), *weights).count() == 0


def test_every_label_is_learnt_from(spark, monkeypatch):
    """Nothing bounds the labelled rows: pairs hold all of them, by either way of meeting the texts."""
    n = 26_000
    rows = spark.range(n).select(classifier.F.col("id").alias("doc_id"), classifier.F.when(
        classifier.F.col("id") % 4 > 0, "plain words here").otherwise("BUY!! NOW ###").alias("text"))
    labels = rows.select("doc_id", (classifier.F.col("doc_id") % 4 > 0).cast("int").alias("quality"))
    used = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n))
    met = []
    pairs = classifier.preference_pairs
    monkeypatch.setattr(classifier, "preference_pairs", lambda sample: met.append(sample.count()) or pairs(sample))
    model = classifier.fit(rows, labels)
    assert met == [used] and used > 20_000
    monkeypatch.setattr(classifier, "BROADCAST_LABELS", 10)
    monkeypatch.setattr(classifier, "PAIRS_A_TASK", 9_000)
    again, threshold = classifier.fit(rows, labels)
    assert met == [used, used] and max(abs(a - b) for a, b in zip(again, model[0])) < 1e-6
    assert abs(threshold - model[1]) < 1e-6
