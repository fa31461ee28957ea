import corpus_pipeline
from loanlens.llm import classifier, jaccard_join, pii
from loanlens.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns, made = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "test-stage")
        made.append((docs, out))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == columns, name
        docs = out
    (raw, good), (_, single), (_, masked), (_, mixed), (_, packed) = made
    labels = spark.read.parquet(SF + "/labels.parquet")
    scores = classifier.classify(raw, *classifier.fit(raw, labels))
    assert good.count() == scores.where("predicted = 1").count() < raw.count()
    assert jaccard_join.similarity_classes(single).where("n_links > 0").isEmpty()
    classes = jaccard_join.similarity_classes(good)
    assert single.count() == classes.select("class_id").distinct().count()
    assert masked.count() == single.count()
    assert pii.report(masked).where("n_email + n_ip + n_card + n_phone > 0").isEmpty()
    sizes = [d.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0] for d in (masked, mixed)]
    assert abs(sizes[1] - 1.5 * sizes[0]) < 0.02 * sizes[0]
    spans = {}
    for r in packed.collect():
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100


def test_quality_stage_asks_for_every_label(spark, monkeypatch):
    asked = []

    def sample(docs, labels, label, text, doc_id, max_labelled=None):
        asked.append(max_labelled)
        return spark.createDataFrame([], "_id long, good boolean, x array<double>")

    monkeypatch.setattr(classifier, "labelled_sample", sample)
    corpus_pipeline.quality(spark, spark.read.parquet(SF + "/documents.parquet"), SF)
    assert asked == [None]
