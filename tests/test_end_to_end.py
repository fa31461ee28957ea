"""End-to-end: synthetic lending CSV (with a real signal) -> training run ->
artifacts -> batch and streaming scoring, sinks, monitor job."""
import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

GRADES = "ABCDEFG"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def write_synthetic_csv(path, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    cols = ["id", "loan_status", "loan_amnt", "term", "int_rate", "installment", "grade",
            "sub_grade", "emp_length", "home_ownership", "annual_inc", "verification_status",
            "purpose", "dti", "issue_d", "earliest_cr_line", "revol_util", "revol_bal",
            "inq_last_6mths", "delinq_2yrs", "open_acc", "pub_rec", "total_acc",
            "initial_list_status", "application_type", "total_pymnt", "recoveries", "desc",
            "title"]
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(cols)
        for i in range(n):
            g = int(rng.integers(0, 7))
            dti = float(np.round(rng.uniform(0, 40), 2))
            logit = -2.2 + 0.45 * g + 0.04 * dti
            default = rng.random() < 1 / (1 + np.exp(-logit))
            status = "Charged Off" if default else "Fully Paid"
            if rng.random() < 0.1:
                status = ["Current", "Late (31-120 days)", "In Grace Period"][i % 3]
            amt = float(rng.integers(10, 400) * 100)
            y, m = 2015 + (i * 4) // n, int(rng.integers(0, 12))
            w.writerow([
                i, status, amt, "36 months" if i % 3 else " 60 months ",
                round(6 + 3 * g + rng.normal(), 2), round(amt / 36, 2), GRADES[g],
                f"{GRADES[g]}{int(rng.integers(1, 6))}",
                ["< 1 year", "1 year", "5 years", "10+ years", "n/a", ""][i % 6],
                ["RENT", "OWN", "MORTGAGE"][i % 3], float(rng.integers(20, 200) * 1000),
                ["Verified", "Not Verified", "Source Verified"][i % 3],
                ["debt_consolidation", "credit_card", "car"][i % 3], dti,
                f"{MONTHS[m]}-{y}", f"{MONTHS[m]}-{y - int(rng.integers(2, 25))}",
                round(float(rng.uniform(0, 100)), 1), float(rng.integers(0, 30000)),
                int(rng.integers(0, 6)), int(rng.integers(0, 3)), int(rng.integers(1, 30)),
                int(rng.integers(0, 2)), int(rng.integers(5, 60)), "w" if i % 2 else "f",
                "Individual", amt * 1.1, 0.0,
                'line one\nline "two"' if i % 50 == 0 else "plain",
                f"title {int(rng.integers(0, 2000))}"])


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    from loanlens.plans.jobs import run_training
    from loanlens.sources.readers import load_raw_data
    d = tmp_path_factory.mktemp("csv")
    path = d / "synthetic_lending.csv"
    write_synthetic_csv(path)
    loans = load_raw_data(spark, path)          # a Path works as well as a str
    # a small literal limit sends the free-text title through a code table
    return loans, run_training(spark, loans, "xgboost", maxIter=15, maxDepth=3,
                               shap_sample=300, prep_options={"max_literal_vocabulary": 500})


def test_csv_read_keeps_multiline_text_and_types(run):
    loans, _ = run
    assert loans.count() == 3000
    types = dict(loans.dtypes)
    assert types["loan_amnt"] == "double" and types["grade"] == "string"
    multi = loans.filter(F.col("desc").contains("\n")).count()
    assert multi == 60
    # "" and "n/a" are both missing-value tokens of a pandas CSV read
    assert loans.filter(F.col("emp_length").isNull()).count() == 1000


def test_training_gate_auc(run):
    _, r = run
    assert set(r.artifacts.code_tables) == {"title"}
    m = r.metrics.first()
    assert m.roc_auc > 0.6                      # the original CI gate
    assert m.brier_calibrated <= m.brier_raw + 0.01
    assert m.n_train + m.n_val + m.n_test == r.bounds.agg(F.sum("n")).first()[0]
    lift = r.decile_lift.collect()
    assert sum(x.n for x in lift) == m.n_test
    assert {x.feature for x in r.importance.collect()} == set(r.artifacts.feature_names)


def test_logistic_gate(spark, run):
    from loanlens.plans.jobs import run_training
    loans, _ = run
    r = run_training(spark, loans, "logistic", maxIter=50, shap_sample=200)
    assert r.metrics.first().roc_auc > 0.6


def test_artifacts_roundtrip_batch_equals_stream(spark, run, tmp_path):
    from loanlens.operators.scoring import score_applications
    from loanlens.plans.jobs import load_champion
    from loanlens.streaming.scoring_stream import run_scoring_stream_once
    loans, r = run
    out = str(tmp_path / "champion")
    r.artifacts.save(spark, out)
    art = load_champion(spark, str(tmp_path / "missing"), out)
    apps = (loans.select(F.col("loan_id").alias("app_id"), "*")
            .drop("loan_id", "loan_status", "id", "desc", "title", "total_pymnt", "recoveries",
                  "issue_d")
            .withColumn("delinq_2yrs", F.col("delinq_2yrs").cast("long"))
            .withColumn("inq_last_6mths", F.col("inq_last_6mths").cast("long"))
            .withColumn("open_acc", F.col("open_acc").cast("long"))
            .withColumn("pub_rec", F.col("pub_rec").cast("long"))
            .withColumn("total_acc", F.col("total_acc").cast("long"))
            .withColumn("mths_since_last_delinq", F.lit(None).cast("double"))
            .withColumn("mths_since_last_record", F.lit(None).cast("double"))
            .limit(400))
    apps = apps.cache()
    batch = {x.app_id: x for x in score_applications(apps, art, issue_month="Jan-2020").collect()}
    stream = {x.app_id: x for x in run_scoring_stream_once(spark, apps, art,
                                                           issue_month="Jan-2020").collect()}
    assert len(batch) == len(stream) > 0
    for k, b in batch.items():
        s = stream[k]
        assert s.pd == pytest.approx(b.pd) and s.decision == b.decision
        assert len(b.top_reasons) == 5
        assert 0.0 <= b.pd <= 1.0


def test_sinks_and_dashboard_bundle(spark, run, tmp_path):
    from loanlens.plans.jobs import dashboard_tables
    from loanlens.sources.readers import read_processed
    from loanlens.sources.sinks import export_dashboard_bundle, load_warehouse
    _, r = run
    scored = r.scored_test.withColumnRenamed("p_cal", "probability_default")
    tables = dashboard_tables(scored)
    assert len(tables) == 7
    paths = export_dashboard_bundle(tables, str(tmp_path / "bundle"), fmt="csv")
    back = read_processed(spark, paths[1], fmt="csv")
    assert back.count() == scored.count()
    wh = load_warehouse(scored.withColumn("risk_band", F.lit("Low Risk")))
    assert wh.columns[0] == "loan_id" and len(wh.columns) == 25


def test_monitor_job(spark, run, tmp_path):
    from loanlens.plans.jobs import run_monitor
    loans, _ = run
    ref = loans.filter("loan_id % 2 = 0").select("loan_amnt", "grade", "dti")
    cur = loans.filter("loan_id % 2 = 1").select("loan_amnt", "grade", "dti",
                                                  (F.col("dti") * 0).alias("zero"))
    ref.write.parquet(str(tmp_path / "ref"))
    cur.write.parquet(str(tmp_path / "cur"))
    table, summary = run_monitor(spark, str(tmp_path / "ref"), str(tmp_path / "cur"),
                                 str(tmp_path / "drift"))
    assert {x.column for x in table.collect()} == {"loan_amnt", "grade", "dti"}
    assert summary.first().n_columns == 3
    assert spark.read.parquet(str(tmp_path / "drift")).count() == 3


def test_evaluate_saved_model_on_rebuilt_holdout(spark, run):
    from loanlens.plans.jobs import evaluate_saved
    loans, r = run
    got = evaluate_saved(spark, loans, r.artifacts).first()
    assert got.n == r.metrics.first().n_test
    assert got.roc_auc > 0.6


def test_fitted_matrix_is_a_stage_that_is_saved_with_the_model(spark, run, tmp_path):
    """A loaded champion encodes and imputes as in training, large vocabularies included."""
    from pyspark.ml import PipelineModel

    from loanlens.operators.cleaning import TARGET
    from loanlens.plans.jobs import ScoringArtifacts, build_features, evaluate_saved, prepare_loans
    loans, r = run
    art = ScoringArtifacts.load(spark, r.artifacts.save(spark, str(tmp_path / "champion")))
    assert art.matrix.fitted.medians == r.artifacts.matrix.fitted.medians
    path = art.matrix.fitted.code_tables["title"]
    assert path.startswith(str(tmp_path)) and spark.read.parquet(path).count() > 500
    a, b = evaluate_saved(spark, loans, art).first(), r.metrics.first()
    assert (a.roc_auc, a.ks, a.score_psi) == pytest.approx((b.roc_auc, b.ks, b.score_psi), abs=1e-9)
    whole = PipelineModel([art.matrix, *art.model.stages])
    feats = build_features(prepare_loans(loans), loan_size_edges=art.loan_size_edges)
    p = whole.transform(feats.limit(200)).select("loan_id", TARGET, "probability").collect()
    assert len(p) == 200 and all(0 <= x.probability[1] <= 1 for x in p)


def test_evaluation_tables_of_a_saved_model(spark, run):
    from loanlens.plans.jobs import TOP_N_FEATURES_FOR_PSI, evaluation_tables
    loans, r = run
    t = evaluation_tables(spark, loans, r.artifacts)
    first = t["metrics"].first()
    assert first.score_psi >= 0 and first.model == "xgboost"
    assert sum(x.n for x in t["decile_lift"].collect()) == first.n
    assert sum(x.n for x in t["vintage_auc"].collect()) == first.n
    assert t["feature_psi"].count() == TOP_N_FEATURES_FOR_PSI
    cls = t["classification"].first()
    assert cls.tn + cls.fp + cls.fn + cls.tp == first.n
    smaller = evaluation_tables(spark, loans, r.artifacts, train_frac=0.8, val_frac=0.1)["metrics"].first()
    assert smaller.n < first.n


@pytest.mark.parametrize("asked", [None, 100])
def test_linear_background_is_the_train_split(spark, run, monkeypatch, asked):
    from loanlens.plans import jobs

    class Reached(Exception):
        pass

    def linear_shap(df, model, names, background):
        raise Reached(background.count(), df.count())

    loans, _ = run
    monkeypatch.setattr(jobs.ex, "linear_shap", linear_shap)
    with pytest.raises(Reached) as reached:
        jobs.run_training(spark, loans, "logistic", maxIter=5, background_sample=asked)
    rows, explained = reached.value.args
    assert explained > 100 and rows == (asked or explained)
