"""End-to-end jobs: training run (K10), evaluation of a saved model (K11),
model comparison (K9), artifacts (A8, A9), monitor (O3).

Lineage is cut twice - after cleaning and after the model matrix is built:
both are written as Parquet to the cluster's shared checkpoint folder and
read back, so a lost executor never replays the joins or the features.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators import explain as ex
from loanlens.operators import metrics as me
from loanlens.operators import training as tr
from loanlens.operators.cleaning import TARGET, clean_and_label, drop_leaky_columns
from loanlens.operators.decisions import APPROVE_BELOW, REJECT_ABOVE
from loanlens.operators.features import build_features, loan_size_edges
from loanlens.operators.matrix import MatrixPrep, MatrixPrepModel, MatrixStage, category_vocabulary, feature_defaults
from loanlens.operators.splits import seeded_sample, split_bounds, time_based_split
from loanlens.session import compiled_in_parts, ensure_checkpoint_dir, materialize
from loanlens.sources.sinks import path_exists, read_json_artifact, write_json_artifact

# Raw categorical fields of the application form.
API_CATEGORICAL_FIELDS = ("term", "grade", "sub_grade", "emp_length", "home_ownership",
                          "verification_status", "purpose", "initial_list_status",
                          "application_type")
TOP_N_FEATURES_FOR_PSI = 5


@dataclass
class ScoringArtifacts:
    """Everything scoring needs; nothing is recomputed at scoring time."""

    model: PipelineModel
    calibrator: IsotonicRegressionModel
    feature_names: list[str]
    vocabulary: dict[str, list[str]]
    defaults: dict[str, float | None]
    loan_size_edges: list[float] | None
    approve_below: float = APPROVE_BELOW
    reject_above: float = REJECT_ABOVE
    metadata: dict = field(default_factory=dict)
    code_tables: dict[str, str] = field(default_factory=dict)
    matrix: MatrixStage | None = None

    def save(self, spark: SparkSession, path: str) -> str:
        """Model, calibrator, code tables and JSON state under one folder."""
        base = path.rstrip("/")
        self.model.write().overwrite().save(f"{base}/model")
        self.calibrator.write().overwrite().save(f"{base}/calibrator")
        tables = {}
        for c, src in self.code_tables.items():
            tables[c] = f"{base}/codes/{c}"
            spark.read.parquet(src).write.mode("overwrite").parquet(tables[c])
        if self.matrix is not None:
            self.matrix.with_tables(tables).write().overwrite().save(f"{base}/matrix")
        write_json_artifact(spark, {"code_tables": tables, "has_matrix": self.matrix is not None,
            "feature_names": self.feature_names, "vocabulary": self.vocabulary,
            "defaults": self.defaults, "loan_size_edges": self.loan_size_edges,
            "approve_below": self.approve_below, "reject_above": self.reject_above,
            "metadata": self.metadata}, f"{base}/state")
        return base

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringArtifacts:
        base = path.rstrip("/")
        st = read_json_artifact(spark, f"{base}/state")
        return cls(model=PipelineModel.load(f"{base}/model"),
                   calibrator=IsotonicRegressionModel.load(f"{base}/calibrator"),
                   feature_names=st["feature_names"], vocabulary=st["vocabulary"],
                   defaults=st["defaults"], loan_size_edges=st["loan_size_edges"],
                   approve_below=st["approve_below"], reject_above=st["reject_above"],
                   metadata=st["metadata"], code_tables=st.get("code_tables", {}),
                   matrix=MatrixStage.load(f"{base}/matrix") if st.get("has_matrix") else None)


def load_champion(spark: SparkSession, primary: str | None, fallback: str | None = None
                  ) -> ScoringArtifacts:
    """The exported champion first, else the fallback location."""
    tried = [p for p in (primary, fallback) if p]
    for p in tried:
        if path_exists(spark, f"{p.rstrip('/')}/state"):
            return ScoringArtifacts.load(spark, p)  # a champion that is there but broken is an error
    raise FileNotFoundError("no champion model at " + " or ".join(tried or ["any place"]))


@dataclass
class TrainingRun:
    metrics: DataFrame
    decile_lift: DataFrame
    vintage_auc: DataFrame
    feature_psi: DataFrame
    importance: DataFrame
    bounds: DataFrame
    artifacts: ScoringArtifacts
    scored_test: DataFrame


def prepare_loans(loans: DataFrame) -> DataFrame:
    """Steps 2-4: clean/label, leakage drop, features (quartile edges once)."""
    base = loans.transform(clean_and_label).transform(drop_leaky_columns)
    return base


@dataclass
class TrainingData:
    """What every model of one training table shares: the split, the fitted
    matrix and its rows, the training defaults."""

    edges: list[float]
    vocabulary: dict[str, list[str]]
    code_tables: dict[str, str]
    split: DataFrame
    prep: MatrixPrepModel
    matrix: DataFrame
    defaults: dict[str, float | None]


def prepare_training(spark: SparkSession, loans: DataFrame, train_frac: float = 0.7, val_frac: float = 0.15,
                     fit_on: str = "all", prep_options: dict | None = None) -> TrainingData:
    """Steps 2-6 of K10: everything before a model is fitted."""
    ensure_checkpoint_dir(spark)
    with compiled_in_parts(spark):
        # The cleaned frame feeds several passes (edges, vocabulary, split, matrix
        # statistics): written once to the shared folder, read back columnar.
        base = materialize(prepare_loans(loans), "train-base")
        edges = loan_size_edges(base)
        feats = build_features(base, loan_size_edges=edges)
        vocab_api, tables_api = category_vocabulary(feats, API_CATEGORICAL_FIELDS)
        # the labelled split feeds the matrix statistics and the matrix itself
        split = materialize(time_based_split(feats, "issue_d", train_frac, val_frac), "split")
        prep = MatrixPrep(**(prep_options or {}))
        prep_model = prep.fit(split, fit_on=split.filter("split = 'train'") if fit_on == "train"
                              else None)
        # the vector is put together where it is read: written, it would double the table
        matrix = prep_model.assemble(materialize(
            prep_model.transform(split, assemble=False, keep=["split", "issue_d"]), "matrix"))
        defaults = feature_defaults(matrix.filter("split = 'train'"), prep_model.feature_names)
    return TrainingData(edges, vocab_api, tables_api, split, prep_model, matrix, defaults)


def run_training(spark: SparkSession, loans: DataFrame, model_name: str = "xgboost",
                 train_frac: float = 0.7, val_frac: float = 0.15, fit_on: str = "all",
                 shap_sample: int | None = None, out_dir: str | None = None,
                 evaluate: bool = True, importance: bool = True, prep_options: dict | None = None,
                 background_sample: int | None = None, prepared: TrainingData | None = None,
                 **params) -> TrainingRun:
    """The full training run as Spark jobs; returns metric tables.

    ``evaluate=False`` fits only what scoring needs (matrix state, model,
    training defaults, isotonic map) and skips the holdout metrics.
    Importance explains every training row; ``shap_sample`` asks for a seeded
    sample instead, ``importance=False`` leaves it out. The background of the
    linear model is the train split; ``background_sample`` asks for a seeded
    sample (the original takes 100 rows). ``prepared`` is the outcome of
    ``prepare_training`` with the same options, for several models of one table."""
    data = prepared or prepare_training(spark, loans, train_frac, val_frac, fit_on, prep_options)
    edges, vocab_api, tables_api = data.edges, data.vocabulary, data.code_tables
    split, prep_model, matrix, defaults = data.split, data.prep, data.matrix, data.defaults
    train = matrix.filter("split = 'train'")
    val = matrix.filter("split = 'val'")
    test = matrix.filter("split = 'test'")
    names = prep_model.feature_names

    model = tr.train(train, model_name, **params)
    s_val = tr.score(model, val)
    if not evaluate:
        iso = tr.fit_isotonic(s_val, "p_raw")
        artifacts = ScoringArtifacts(
            model=model, calibrator=iso, feature_names=names,
            vocabulary={**vocab_api, **prep_model.vocabulary}, defaults=defaults,
            loan_size_edges=edges, code_tables={**tables_api, **prep_model.code_tables}, matrix=MatrixStage(prep_model),
            metadata={"model": model_name, "split": {"train_frac": train_frac, "val_frac": val_frac},
                      "training_date": dt.datetime.now(dt.UTC).isoformat()})
        if out_dir:
            artifacts.save(spark, out_dir)
        counts = split_bounds(split)
        return TrainingRun(metrics=counts, decile_lift=None, vintage_auc=None,
                           feature_psi=None, importance=None, bounds=counts,
                           artifacts=artifacts, scored_test=None)
    # every metric rescans the scores: written once, no executor holds them for the session
    s_test = materialize(tr.score(model, test), "scored-test")
    s_train = materialize(tr.score(model, train).select("loan_id", "p_raw"), "scored-train")

    summary = me.binary_metrics(s_test, TARGET, "p_raw").first()
    cls = me.classification_metrics(s_test, TARGET, "p_raw").first()
    lift = me.decile_lift_table(s_test, TARGET, "p_raw")
    vint = me.per_vintage_auc(s_test, "issue_d", TARGET, "p_raw")

    iso = tr.fit_isotonic(s_val, "p_raw")
    cal_test = tr.apply_isotonic(iso, s_test, "p_raw", "p_cal")
    brier = cal_test.agg(me.brier_score(None, TARGET, "p_raw").alias("raw"),
                         me.brier_score(None, TARGET, "p_cal").alias("cal")).first()
    score_psi = me.psi(s_train, s_test, "p_raw")
    top = tr.top_feature_names(model, names, TOP_N_FEATURES_FOR_PSI)
    feature_psi = me.psi_by_column(train, test, top)

    explained = None
    if importance:
        sample = seeded_sample(train, shap_sample) if shap_sample else train
        if hasattr(model.stages[-1], "featureImportances"):
            shap = ex.tree_shap(sample, model, names)
        else:
            background = seeded_sample(train, background_sample, seed=7) if background_sample else train
            shap = ex.linear_shap(sample, model, names, background)
        explained = ex.global_importance(shap, names)

    metrics = spark.createDataFrame([(
        model_name, int(train.count()), int(val.count()), int(summary["n"]), len(names),
        summary["roc_auc"], summary["ks"], summary["gini"], cls["accuracy"], cls["precision"],
        cls["recall"], cls["f1"], float(brier["raw"]), float(brier["cal"]),
        round(score_psi, 6))],
        "model string, n_train long, n_val long, n_test long, n_features int, roc_auc double, "
        "ks double, gini double, accuracy double, precision double, recall double, f1 double, "
        "brier_raw double, brier_calibrated double, score_psi double")
    artifacts = ScoringArtifacts(
        model=model, calibrator=iso, feature_names=names,
        vocabulary={**vocab_api, **prep_model.vocabulary}, defaults=defaults,
        loan_size_edges=edges, code_tables={**tables_api, **prep_model.code_tables}, matrix=MatrixStage(prep_model),
        metadata={"model": model_name, "split": {"train_frac": train_frac, "val_frac": val_frac},
                  "training_date": dt.datetime.now(dt.UTC).isoformat(),
                  "test_auc": summary["roc_auc"], "test_ks": summary["ks"],
                  "test_gini": summary["gini"], "brier": float(brier["cal"]),
                  "decision_thresholds": {"approve_below": APPROVE_BELOW,
                                          "reject_above": REJECT_ABOVE}})
    if out_dir:
        artifacts.save(spark, out_dir)
    return TrainingRun(metrics=metrics, decile_lift=lift, vintage_auc=vint,
                       feature_psi=feature_psi, importance=explained,
                       bounds=split_bounds(split), artifacts=artifacts,
                       scored_test=cal_test)


def compare_models(spark: SparkSession, loans: DataFrame, models: dict[str, dict],
                   **options) -> DataFrame:
    """K9: one metrics table over several models (union of K10 rows), all of
    them fitted on one split and matrix that are prepared once."""
    shared = ("train_frac", "val_frac", "fit_on", "prep_options")
    data = prepare_training(spark, loans, **{k: v for k, v in options.items() if k in shared})
    out = None
    for name, params in models.items():
        m = run_training(spark, loans, name, importance=False, prepared=data, **options, **params).metrics
        out = m if out is None else out.unionByName(m)
    return out


def evaluation_tables(spark: SparkSession, loans: DataFrame, artifacts: ScoringArtifacts,
                      train_frac: float | None = None, val_frac: float | None = None
                      ) -> dict[str, DataFrame]:
    """Rebuild the split of a saved model (its stored fractions unless
    others are given), score train and test, and return ``metrics`` (AUC, KS,
    Gini, score PSI), ``classification``, ``decile_lift``, ``vintage_auc`` and
    ``feature_psi`` of the model's top features. The saved matrix stage encodes
    and imputes as in training."""
    stored = artifacts.metadata.get("split", {})
    feats = build_features(prepare_loans(loans), loan_size_edges=artifacts.loan_size_edges)
    split = time_based_split(feats, "issue_d", train_frac or stored.get("train_frac", 0.7),
                             val_frac or stored.get("val_frac", 0.15))
    names = artifacts.feature_names
    if artifacts.matrix is None:
        raise ValueError("the saved model lacks its fitted matrix: train and save it again")
    m = artifacts.matrix.transform(split.withColumn("_issue", F.col("issue_d")))
    scored = tr.score(artifacts.model, m.filter("split <> 'val'"))
    # every metric rescans the scores: written once
    scored = materialize(scored.select("loan_id", TARGET, "split", F.col("_issue").alias("issue_d"),
                                       "p_raw", *[c for c in names]), "evaluation")
    train, test = scored.filter("split = 'train'"), scored.filter("split = 'test'")
    top = tr.top_feature_names(artifacts.model, names, TOP_N_FEATURES_FOR_PSI)
    metrics = me.binary_metrics(test, TARGET, "p_raw").withColumns({
        "score_psi": F.lit(round(me.psi(train, test, "p_raw"), 6)),
        "model": F.lit(artifacts.metadata.get("model"))})
    return {"metrics": metrics,
            "classification": me.classification_metrics(test, TARGET, "p_raw"),
            "decile_lift": me.decile_lift_table(test, TARGET, "p_raw"),
            "vintage_auc": me.per_vintage_auc(test, "issue_d", TARGET, "p_raw"),
            "feature_psi": me.psi_by_column(train, test, top)}


def evaluate_saved(spark: SparkSession, loans: DataFrame, artifacts: ScoringArtifacts,
                   **split) -> DataFrame:
    """K11's metrics row."""
    return evaluation_tables(spark, loans, artifacts, **split)["metrics"]


def dashboard_tables(scored: DataFrame, prob: str = "probability_default",
                     target: str = TARGET) -> dict[str, DataFrame]:
    """The seven dashboard tables from one scored loan table."""
    from loanlens.operators import decisions as dec
    from loanlens.operators import reports as rp
    flat = [f.name for f in scored.schema.fields
            if not isinstance(f.dataType, T.UserDefinedType)]
    scored = scored.select(*flat)  # report sinks (CSV) hold flat columns only
    banded = scored.withColumn("risk_band", dec.risk_band(prob)).withColumn(
        "decision", dec.decision(prob))
    return {
        "dashboard_dataset": banded,
        "risk_scores": banded.select("loan_id", prob, "risk_band", "decision"),
        "thresholds": me.sweep_thresholds(scored, target, prob),
        "portfolio_summary": rp.portfolio_summary(banded, "decision", prob, target),
        "decision_default_rate": rp.default_rate(banded, "decision", target),
        "scorecard": dec.build_scorecard(scored, prob, target, keep=("loan_id",)),
        "risk_band_analysis": rp.default_rate(banded, "risk_band", target),
    }


def run_monitor(spark: SparkSession, reference_path: str, current_path: str,
                out_path: str | None = None, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """O3: read the two snapshots, build the drift table, write it."""
    from loanlens.operators.monitoring import dataset_drift, drift_table
    from loanlens.sources.readers import read_snapshots
    from loanlens.sources.sinks import write_report
    ref, cur = read_snapshots(spark, reference_path, current_path)
    table = drift_table(ref, cur, target)
    if out_path:
        write_report(table, out_path)
    return table, dataset_drift(table)
