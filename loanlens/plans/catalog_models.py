"""Registered queries of the matrix, validation, model, explain, scoring,
monitoring and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import explain as ex
from loanlens.operators import monitoring as mo
from loanlens.operators import training as tr
from loanlens.operators.matrix import MatrixPrep, median_table, vocabulary_table
from loanlens.operators.scoring import (FIELD_ORDER, GRADES, OPTIONAL, RANGE_RULES,
                                        SUB_GRADE_PATTERN, rule_message, validate_applications)
from loanlens.operators.splits import seeded_sample
from loanlens.plans import frames as fr
from loanlens.plans.catalog import register
from loanlens.plans.jobs import API_CATEGORICAL_FIELDS, compare_models, run_training
from loanlens.plans.oracle import q
from loanlens.session import compiled_in_parts, materialize, scratch
from loanlens.sources.fixture import LOANS_SQL, loan_view
from loanlens.sources.readers import applications_from_loans

# Feature columns of the fixture model matrix (checked against MatrixPrep by a test).
MATRIX_NUMERIC = ("loan_amnt", "int_rate", "installment", "annual_inc", "dti", "revol_util",
                  "revol_bal", "inq_last_6mths", "delinq_2yrs", "open_acc", "pub_rec",
                  "total_acc", "mths_since_last_delinq", "income_to_loan_ratio",
                  "emp_length_clean", "credit_history_years", "revol_bal_to_income",
                  "installment_to_income", "credit_exposure_score")
MATRIX_CATEGORICAL = ("term", "grade", "sub_grade", "emp_length", "home_ownership",
                      "verification_status", "purpose", "initial_list_status",
                      "application_type", "revol_util_bucket", "dti_bucket",
                      "employment_stability", "inquiry_risk_bucket", "delinquency_risk",
                      "loan_size_bucket")

# The models of the registered queries, all at the library's full sizes.
MODELS = ("logistic", "random_forest", "xgboost")


# --- 2.D matrix ----------------------------------------------------------------

def _vocab_sql() -> str:
    parts = [f"SELECT DISTINCT '{c}' AS \"column\", coalesce({c}, 'nan') AS value FROM feat"
             for c in API_CATEGORICAL_FIELDS]
    return q(f"SELECT \"column\", value, CAST(row_number() OVER (PARTITION BY \"column\" "
             f"ORDER BY value) - 1 AS BIGINT) AS code FROM ({' UNION ALL '.join(parts)})")


@register("category_vocabulary", _vocab_sql())
def _vocab(spark, sf):
    v = vocabulary_table(fr.features(spark, sf), API_CATEGORICAL_FIELDS)
    return v.select("column", "value", F.col("code").cast("long").alias("code"))


@register("label_encoding", q(
    "SELECT loan_id, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}"
        for c in MATRIX_CATEGORICAL) + " FROM feat"))
def _label_encoding(spark, sf):
    feats = materialize(fr.features(spark, sf), "features")  # read by every pass of the fit
    m = MatrixPrep().fit(feats).transform(feats, assemble=False)
    return m.select("loan_id", *[F.col(c).cast("int").alias(c) for c in MATRIX_CATEGORICAL])


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


@register("median_impute", q(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({_finite(c)}, 0.5), 6) AS median "
    f"FROM feat" for c in MATRIX_NUMERIC)))
def _median_impute(spark, sf):
    t = median_table(materialize(fr.features(spark, sf), "features"), MATRIX_NUMERIC)
    return t.select("column", F.round("median", 6).alias("median"))


def _defaults_sql() -> str:
    med = ", ".join(f"quantile_cont({_finite(c)}, 0.5) AS m_{c}" for c in MATRIX_NUMERIC)
    enc = ", ".join(
        [f"coalesce({_finite(c)}, m_{c}) AS {c}" for c in MATRIX_NUMERIC]
        + [f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS DOUBLE) AS {c}"
           for c in MATRIX_CATEGORICAL])
    parts = [f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median "
             f"FROM enc WHERE split = 'train'" for c in (*MATRIX_NUMERIC, *MATRIX_CATEGORICAL)]
    return q(f", med AS (SELECT {med} FROM splitted), enc AS (SELECT split, {enc} "
             f"FROM splitted, med) " + " UNION ALL ".join(parts))


@register("feature_defaults", _defaults_sql())
def _feature_defaults(spark, sf):
    split = materialize(fr.split_features(spark, sf), "split")  # read by every pass of the fit
    prep = MatrixPrep().fit(split)
    train = prep.transform(split, assemble=False, keep=["split"]).filter("split = 'train'")
    t = median_table(materialize(train, "train-matrix"), prep.feature_names)
    return t.select("column", F.round("median", 6).alias("median"))


# --- 2.B validation ------------------------------------------------------------

def _validation_sql() -> str:
    checks = []
    for f in FIELD_ORDER:
        if f not in OPTIONAL:
            checks.append(f"CASE WHEN {f} IS NULL THEN '{f}: field required' END")
        for field, lo, inclusive, hi in RANGE_RULES:
            if field == f:
                ok = f"{f} {'>=' if inclusive else '>'} {lo}"
                if hi is not None:
                    ok += f" AND {f} <= {hi}"
                checks.append(f"CASE WHEN {f} IS NOT NULL AND NOT ({ok}) THEN "
                              f"'{f}: {rule_message(lo, inclusive, hi)}' END")
        if f == "grade":
            checks.append("CASE WHEN grade IS NOT NULL AND grade NOT IN ("
                          + ", ".join(f"'{g}'" for g in GRADES)
                          + ") THEN 'grade: must be one of A-G' END")
        if f == "sub_grade":
            checks.append(f"CASE WHEN sub_grade IS NOT NULL AND NOT regexp_matches(sub_grade, "
                          f"'{SUB_GRADE_PATTERN}') THEN 'sub_grade: must match "
                          f"{SUB_GRADE_PATTERN}' END")
    apps = ("SELECT loan_id AS app_id, loan_amnt, term, int_rate, installment, grade, sub_grade,"
            " emp_length, home_ownership, annual_inc, verification_status, purpose, dti,"
            " CAST(delinq_2yrs AS BIGINT) AS delinq_2yrs, earliest_cr_line,"
            " CAST(inq_last_6mths AS BIGINT) AS inq_last_6mths, mths_since_last_delinq,"
            " CAST(NULL AS DOUBLE) AS mths_since_last_record,"
            " CAST(open_acc AS BIGINT) AS open_acc, CAST(pub_rec AS BIGINT) AS pub_rec,"
            " revol_bal, revol_util, CAST(total_acc AS BIGINT) AS total_acc,"
            " initial_list_status, application_type FROM loans")
    errs = f"concat_ws('; ', {', '.join(checks)})"
    return (f"WITH {LOANS_SQL}, apps AS ({apps}) SELECT app_id, {errs} = '' AS is_valid, "
            f"{errs} AS errors FROM apps")


@register("validate_applications", _validation_sql())
def _validate(spark, sf):
    v = validate_applications(applications_from_loans(loan_view(spark, sf)))
    return v.select("app_id", "is_valid", F.concat_ws("; ", "errors").alias("errors"))


# --- 2.O monitoring --------------------------------------------------------------

DRIFT_NUMERIC = ("value", "user_id")
DRIFT_CATEGORICAL = ("event_type",)
_HALVES = ("WITH ref AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'), "
           "cur AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')")


def _drift_numeric_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{s}' AS side, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {t}"
        for c in DRIFT_NUMERIC for s, t in (("reference", "ref"), ("current", "cur")))
    return f"""{_HALVES},
long AS (SELECT * FROM ({long}) WHERE v IS NOT NULL AND NOT isnan(v)),
cnt AS (SELECT "column", v, sum(CASE WHEN side = 'reference' THEN 1 ELSE 0 END) AS cr,
               sum(CASE WHEN side = 'current' THEN 1 ELSE 0 END) AS cc
        FROM long GROUP BY "column", v),
tot AS (SELECT "column", sum(CASE WHEN side = 'reference' THEN 1 ELSE 0 END) AS n_ref,
               sum(CASE WHEN side = 'current' THEN 1 ELSE 0 END) AS n_cur,
               stddev_samp(CASE WHEN side = 'reference' THEN v END) AS sd
        FROM long GROUP BY "column"),
cum AS (SELECT *, sum(cr) OVER (PARTITION BY "column" ORDER BY v ROWS UNBOUNDED PRECEDING)
                    AS cum_cr,
               sum(cc) OVER (PARTITION BY "column" ORDER BY v ROWS UNBOUNDED PRECEDING)
                    AS cum_cc,
               lead(v) OVER (PARTITION BY "column" ORDER BY v) AS nxt FROM cnt)
SELECT "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
       round(max(abs(cum_cr / n_ref - cum_cc / n_cur)), 6) AS ks_distance,
       round(sum(CASE WHEN nxt IS NOT NULL THEN
             abs(cum_cr / n_ref - cum_cc / n_cur) * (nxt - v) ELSE 0 END)
             / greatest(coalesce(sd, 0), 0.001), 6) AS wasserstein_normed
FROM cum JOIN tot USING ("column") GROUP BY "column", n_ref, n_cur, sd"""


@register("drift_numeric", _drift_numeric_sql())
def _drift_numeric(spark, sf):
    ref, cur = fr.events_halves(spark, sf)
    return mo.numeric_drift_stats(ref, cur, DRIFT_NUMERIC)


def _drift_categorical_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{s}' AS side, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {t}"
        for c in DRIFT_CATEGORICAL for s, t in (("reference", "ref"), ("current", "cur")))
    return f"""{_HALVES},
long AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
cnt AS (SELECT "column", v, sum(CASE WHEN side = 'reference' THEN 1 ELSE 0 END) AS cr,
               sum(CASE WHEN side = 'current' THEN 1 ELSE 0 END) AS cc
        FROM long GROUP BY "column", v),
j AS (SELECT c.*, sum(cr) OVER (PARTITION BY "column") AS n_ref,
             sum(cc) OVER (PARTITION BY "column") AS n_cur FROM cnt c),
s AS (SELECT *, cr / n_ref AS p, cc / n_cur AS q_ FROM j)
SELECT "column", CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
       count(*) AS n_categories,
       round(sum(pow(cc - greatest(cr, 0.5) / n_ref * n_cur, 2)
                 / (greatest(cr, 0.5) / n_ref * n_cur)), 6) AS chi2_statistic,
       round(sqrt(greatest(sum(
           0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q_) / 2)) ELSE 0 END
         + 0.5 * CASE WHEN q_ > 0 THEN q_ * ln(q_ / ((p + q_) / 2)) ELSE 0 END), 0)), 6)
         AS js_distance,
       round(sum((CASE WHEN q_ = 0 THEN 1e-6 ELSE q_ END - CASE WHEN p = 0 THEN 1e-6 ELSE p END)
         * ln(CASE WHEN q_ = 0 THEN 1e-6 ELSE q_ END / CASE WHEN p = 0 THEN 1e-6 ELSE p END)), 6)
         AS psi
FROM s GROUP BY "column\""""


@register("drift_categorical", _drift_categorical_sql())
def _drift_categorical(spark, sf):
    ref, cur = fr.events_halves(spark, sf)
    return mo.categorical_drift_stats(ref, cur, DRIFT_CATEGORICAL)


@register("drift_report")
def _drift_report(spark, sf):
    """O1-O3: drift table of every column of the event halves."""
    return mo.drift_table(*fr.events_halves(spark, sf))


# --- 2.K / 2.N models (rows-only) -----------------------------------------------

def _training(spark, sf, name):
    return run_training(spark, loan_view(spark, sf), name, shap_sample=None)


@register("train_logistic")
def _train_logistic(spark, sf):
    return _training(spark, sf, "logistic").metrics


@register("train_forest")
def _train_forest(spark, sf):
    return _training(spark, sf, "random_forest").metrics


@register("train_boosted")
def _train_boosted(spark, sf):
    return _training(spark, sf, "xgboost").metrics


@register("model_comparison")
def _model_comparison(spark, sf):
    return compare_models(spark, loan_view(spark, sf), {name: {} for name in MODELS})


def _boosted_setup(spark, sf):
    split = fr.split_features(spark, sf)
    with compiled_in_parts(split.sparkSession):
        split = materialize(split, "split")
        prep = MatrixPrep().fit(split)
        m = prep.assemble(materialize(prep.transform(split, assemble=False, keep=["split", "issue_d"]), "matrix"))
    model = tr.train(m.filter("split = 'train'"), "xgboost")
    return prep, m, model


@register("calibrate_isotonic")
def _calibrate(spark, sf):
    """K7 + L9 + L11: reliability of raw vs calibrated test probabilities."""
    from loanlens.operators import metrics as me
    _, m, model = _boosted_setup(spark, sf)
    iso = tr.fit_isotonic(tr.score(model, m.filter("split = 'val'")))
    test = tr.apply_isotonic(iso, tr.score(model, m.filter("split = 'test'")), "p_raw", "p_cal")
    raw = me.reliability_curve(test, "target_default", "p_raw").withColumn("curve", F.lit("raw"))
    cal = me.reliability_curve(test, "target_default", "p_cal").withColumn(
        "curve", F.lit("isotonic"))
    return raw.unionByName(cal)


@register("global_importance")
def _global_importance(spark, sf):
    """N1 over the whole train split (TreeSHAP of the boosted model)."""
    prep, m, model = _boosted_setup(spark, sf)
    shap = ex.tree_shap(m.filter("split = 'train'"), model, prep.feature_names)
    return ex.global_importance(shap, prep.feature_names)


@register("local_reasons")
def _local_reasons(spark, sf):
    """N3 for every test loan: top-5 reasons."""
    prep, m, model = _boosted_setup(spark, sf)
    names = prep.feature_names
    shap = ex.tree_shap(m.filter("split = 'test'"), model, names, keep=["loan_id", *names])
    return ex.local_explanation(shap, names)


@register("shap_sample_importance")
def _shap_sample(spark, sf):
    """N1 on the seeded 1000-row sample the original explains."""
    prep, m, model = _boosted_setup(spark, sf)
    sample = seeded_sample(m.filter("split = 'train'"), 1000)
    return ex.global_importance(ex.tree_shap(sample, model, prep.feature_names),
                                prep.feature_names)


@register("score_batch")
def _score_batch(spark, sf):
    """Score every application of the fixture with a freshly trained champion."""
    from loanlens.operators.scoring import score_applications
    loans = loan_view(spark, sf)
    run = run_training(spark, loans, "xgboost", shap_sample=None, evaluate=False)
    return score_applications(applications_from_loans(loans), run.artifacts,
                              issue_month="Jan-2002")


@register("score_stream")
def _score_stream(spark, sf):
    """The application feed as a file stream, scored micro-batch by micro-batch."""
    from loanlens.streaming.scoring_stream import run_scoring_stream_once
    loans = loan_view(spark, sf)
    run = run_training(spark, loans, "xgboost", shap_sample=None, evaluate=False)
    return run_scoring_stream_once(spark, applications_from_loans(loans), run.artifacts,
                                   issue_month="Jan-2002")


def _drift_stream_sql() -> str:
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    present = "value IS NOT NULL AND NOT isnan(value)"
    b = "len(list_filter(i, lambda e: e <= value))"
    floor = "CASE WHEN coalesce(c, 0) = 0 THEN 1e-6 ELSE c / {n} END"
    return f"""{_HALVES},
edges AS (SELECT list_sort(list_distinct(quantile_cont(value, {probs}))) AS l
          FROM ref WHERE {present}),
inn AS (SELECT l[2:len(l) - 1] AS i FROM edges),
sh AS (SELECT b, {floor.format(n="(SELECT count(*) FROM ref)")} AS s
       FROM (SELECT unnest(range(len(i) + 1)) AS b FROM inn)
       LEFT JOIN (SELECT {b} AS b, count(*) AS c FROM ref, inn WHERE {present} GROUP BY 1)
       USING (b)),
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1),
wb AS (SELECT date_trunc('day', ts) AS d, {b} AS b, count(*) AS c
       FROM events, inn WHERE {present} GROUP BY 1, 2)
SELECT strftime(d, '%Y-%m-%d') AS window_start, n, round(sum((a - s) * ln(a / s)), 6) AS psi
FROM (SELECT w.d, w.n, s, {floor.format(n="n")} AS a
      FROM w CROSS JOIN sh LEFT JOIN wb ON w.d = wb.d AND sh.b = wb.b) GROUP BY d, n"""


@register("drift_stream", _drift_stream_sql())
def _drift_stream(spark, sf):
    """Windowed PSI of event values against the reference half, every day of
    the table."""
    from loanlens.streaming.drift_stream import run_drift_stream_once
    return run_drift_stream_once(spark, sf).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", "psi")


# --- 2.A sources and sinks: written, read back, compared with the tables themselves ---

_RAW_COLUMNS = ("loan_amnt", "term", "int_rate", "grade", "emp_length", "annual_inc", "dti",
                "issue_d", "mths_since_last_delinq")


@register("raw_csv_round_trip", (
    f"WITH {LOANS_SQL} SELECT loan_id, " + ", ".join(
        "nullif(emp_length, 'n/a') AS emp_length" if c == "emp_length" else c
        for c in _RAW_COLUMNS[:-1])
    + ", CASE WHEN loan_id % 3 = 0 THEN mths_since_last_delinq END AS open_act_il, "
      "'a \"quoted\"' || chr(10) || 'line, ' || loan_id AS \"desc\" FROM loans"))
def _raw_csv(spark, sf):
    """A1: the loans as a raw CSV export - an empty id column, gaps in a numeric
    column, quotes and line breaks in a text - read back and typed by what its
    columns hold. The rows' generated keys must be unique; the loan's own number
    travels as a plain column."""
    from loanlens.sources.readers import load_raw_data
    loans = loan_view(spark, sf).select(
        F.lit(None).cast("string").alias("id"), F.col("loan_id").alias("number"),
        *_RAW_COLUMNS[:-1],
        F.when(F.col("loan_id") % 3 == 0, F.col("mths_since_last_delinq")).alias("open_act_il"),
        F.concat(F.lit('a "quoted"\nline, '), F.col("loan_id").cast("string")).alias("desc"))
    path = scratch(spark, "raw-csv")
    loans.write.option("header", "true").option("escape", '"').option("nullValue", "").csv(path)
    raw = load_raw_data(spark, path)
    keys = raw.agg(F.countDistinct("loan_id").alias("d"), F.count(F.lit(1)).alias("n")).first()
    if keys["d"] != keys["n"]:
        raise AssertionError("generated keys are not unique")
    return raw.select(F.col("number").cast("long").alias("loan_id"), *_RAW_COLUMNS[:-1],
                      "open_act_il", "desc")


@register("snapshots_read_back", _HALVES + " SELECT 'reference' AS side, event_id, value FROM ref "
          "UNION ALL SELECT 'current', event_id, value FROM cur")
def _snapshots(spark, sf):
    """A2: the two event halves written as snapshots and read back."""
    from loanlens.sources.readers import read_snapshots
    paths = []
    for name, df in zip(("reference", "current"), fr.events_halves(spark, sf), strict=True):
        paths.append(scratch(spark, name))
        df.write.parquet(paths[-1])
    ref, cur = read_snapshots(spark, *paths)
    return ref.select(F.lit("reference").alias("side"), "event_id", "value").unionByName(
        cur.select(F.lit("current").alias("side"), "event_id", "value"))


def _report_round_trip(fmt):
    def run(spark, sf):
        from loanlens.sources.readers import read_processed
        from loanlens.sources.sinks import write_report
        report = fr.cleaned(spark, sf).groupBy("grade", "term").agg(
            F.count(F.lit(1)).alias("n"), F.sum("target_default").alias("n_default"))
        path = write_report(report, scratch(spark, f"report-{fmt}"), fmt)
        return read_processed(spark, path, fmt).select(
            "grade", "term", *[F.col(c).cast("long").alias(c) for c in ("n", "n_default")])
    return run


for _fmt in ("csv", "parquet"):  # A3/A4 + A5
    register(f"report_{_fmt}_round_trip", q(
        "SELECT grade, term, count(*) AS n, CAST(sum(target_default) AS BIGINT) AS n_default "
        "FROM clean GROUP BY grade, term"))(_report_round_trip(_fmt))

_WAREHOUSE_PROBE = ("loan_id", "loan_amnt", "grade", "annual_inc", "dti", "purpose")


@register("warehouse_table", q("SELECT " + ", ".join(_WAREHOUSE_PROBE) + " FROM clean"))
def _warehouse(spark, sf):
    """The cleaned loans as a managed table in the warehouse, read back."""
    import uuid

    from loanlens.sources.sinks import load_warehouse
    table = f"fact_loans_{uuid.uuid4().hex}"
    load_warehouse(fr.cleaned(spark, sf), table)
    return spark.table(table).select(*_WAREHOUSE_PROBE)


@register("warehouse_months", q(
    "SELECT coalesce(strftime(strptime(issue_d, '%b-%Y'), '%Y-%m'), 'unknown') AS issue_month, "
    "count(*) AS n, count(DISTINCT loan_id) AS n_keys, round(sum(loan_amnt), 2) AS loan_amnt, "
    "CAST(sum(target_default) AS BIGINT) AS n_default FROM clean GROUP BY 1"))
def _warehouse_months(spark, sf):
    """The warehouse loaded by issue month, its last month loaded again."""
    from loanlens.sources.sinks import load_warehouse_months, read_warehouse
    path = scratch(spark, "warehouse")
    loans = fr.cleaned(spark, sf)
    last = load_warehouse_months(loans, path)[-1:]
    again = F.date_format(F.try_to_date("issue_d", "MMM-yyyy"), "yyyy-MM").isin(*last)
    load_warehouse_months(loans.where(again), path)
    return read_warehouse(spark, path).groupBy("issue_month").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("loan_id").alias("n_keys"),
        F.round(F.sum("loan_amnt"), 2).alias("loan_amnt"), F.sum("target_default").cast("long").alias("n_default"))


@register("application_feed", (
    f"WITH {LOANS_SQL} SELECT loan_id AS app_id, loan_amnt, grade, annual_inc, "
    "delinq_2yrs, earliest_cr_line FROM loans"))
def _application_feed(spark, sf):
    """Applications landed as JSON lines and read with the feed's schema."""
    from loanlens.sources.readers import read_applications
    path = scratch(spark, "feed")
    applications_from_loans(loan_view(spark, sf)).write.json(path)
    return read_applications(spark, path).select(
        "app_id", "loan_amnt", "grade", "annual_inc",
        F.col("delinq_2yrs").cast("double").alias("delinq_2yrs"), "earliest_cr_line")


@register("artifact_round_trip", q(
    "SELECT DISTINCT grade AS value FROM clean WHERE grade IS NOT NULL"))
def _artifact(spark, sf):
    """A vocabulary as a JSON artifact, written and read back."""
    from loanlens.sources.sinks import read_json_artifact, write_json_artifact
    grades = [r["grade"] for r in fr.cleaned(spark, sf).select("grade").where(
        "grade IS NOT NULL").distinct().collect()]  # grades are a fixed, small set
    path = scratch(spark, "artifact")
    write_json_artifact(spark, {"grade": grades}, path)
    return spark.createDataFrame([(v,) for v in read_json_artifact(spark, path)["grade"]],
                                 "value string")


@register("dashboard_bundle", q(
    "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN probability_default < 0.2 THEN 'Approve' "
    "WHEN probability_default >= 0.5 THEN 'Reject' ELSE 'Manual Review' END AS decision FROM scored "
    "WHERE probability_default IS NOT NULL) GROUP BY decision"))
def _dashboard_bundle(spark, sf):
    """The dashboard tables exported and one of them read back."""
    from loanlens.plans.jobs import dashboard_tables
    from loanlens.sources.readers import read_processed
    from loanlens.sources.sinks import export_dashboard_bundle
    paths = export_dashboard_bundle(dashboard_tables(fr.scored_table(spark, sf)), scratch(spark, "bundle"))
    risk = next(p for p in paths if p.endswith("risk_scores"))
    return (read_processed(spark, risk, "csv").where("probability_default IS NOT NULL")
            .groupBy("decision").agg(F.count(F.lit(1)).alias("n")))


# --- serving: written-out vocabulary and defaults ---------------------------------

_SERVED = ("loan_amnt", "term", "grade", "purpose", "dti", "mths_since_last_delinq",
           "loan_size_bucket", "emp_length_clean", "absent_number", "absent_category")


@register("serving_encoding", f"""
WITH {LOANS_SQL}, a AS (SELECT *, list_sort([loan_amnt, 1000.0, 8000.0, 15000.0, 25000.0, 40000.0]) AS s
                        FROM loans),
e AS (SELECT *, s[2] + (s[3] - s[2]) * 0.25 AS q1, s[4] - (s[4] - s[3]) * 0.5 AS q2,
             s[5] - (s[5] - s[4]) * 0.25 AS q3 FROM a)
SELECT loan_id AS app_id, loan_amnt,
       CASE term WHEN '36 months' THEN 0.0 WHEN '60 months' THEN 1.0 ELSE -1.0 END AS term,
       CASE grade WHEN 'A' THEN 0.0 WHEN 'B' THEN 1.0 WHEN 'C' THEN 2.0 ELSE -1.0 END AS grade,
       CASE purpose WHEN 'FRANCE' THEN 0.0 WHEN 'JAPAN' THEN 1.0 ELSE -1.0 END AS purpose,
       coalesce(dti, 9.5) AS dti, coalesce(mths_since_last_delinq, 24.0) AS mths_since_last_delinq,
       CASE WHEN loan_amnt <= q1 THEN 2.0 WHEN loan_amnt <= q2 THEN 1.0 WHEN loan_amnt <= q3 THEN 0.0
            ELSE 3.0 END AS loan_size_bucket,
       coalesce(TRY_CAST(nullif(regexp_extract(emp_length, '([0-9]+)', 1), '') AS DOUBLE), 0.0)
         AS emp_length_clean,
       3.25 AS absent_number, 0.0 AS absent_category
FROM e""")
def _serving_encoding(spark, sf):
    """Every application through the serving features
    and the encoder with a fixed vocabulary and fixed defaults: unknown categories
    become -1, missing numbers their default, else 0."""
    from loanlens.operators.scoring import application_features, encode_for_model
    apps = applications_from_loans(loan_view(spark, sf))
    return encode_for_model(
        application_features(apps, issue_month="Jan-2002"), _SERVED,
        vocabulary={"term": ["36 months", "60 months"], "grade": ["A", "B", "C"],
                    "purpose": ["FRANCE", "JAPAN"], "absent_category": ["nan", "x"]},
        defaults={"dti": 9.5, "mths_since_last_delinq": 24.0, "absent_number": 3.25},
        keep=["app_id"])


@register("decision_thresholds", q(
    "SELECT loan_id, CASE WHEN probability_default < 0.1 THEN 'Approve' "
    "WHEN probability_default >= 0.3 THEN 'Reject' ELSE 'Manual Review' END AS decision FROM scored"))
def _decision_thresholds(spark, sf):
    """M4: decisions at thresholds other than the default ones."""
    from loanlens.operators.decisions import decision
    return fr.scored(spark, sf).select("loan_id", decision(fr.PROB, 0.1, 0.3).alias("decision"))


@register("valid_applications", f"WITH v AS ({_validation_sql()}) SELECT app_id FROM v WHERE is_valid")
def _valid_applications(spark, sf):
    """The applications that go on to scoring."""
    from loanlens.operators.scoring import split_valid
    return split_valid(applications_from_loans(loan_view(spark, sf)))[0].select("app_id")


@register("prune_empty_columns", _HALVES + """
SELECT "column" FROM (SELECT 'event_id' AS "column", count(event_id) AS a FROM ref
  UNION ALL SELECT 'value', count(value) FROM ref UNION ALL SELECT 'event_type', count(event_type) FROM ref)
WHERE a > 0""")
def _prune_empty(spark, sf):
    """A column empty in the reference, and one empty in the current half,
    are dropped from both."""
    from loanlens.operators.cleaning import prune_empty_columns
    ref, cur = (h.select("event_id", "value", "event_type") for h in fr.events_halves(spark, sf))
    ref = ref.withColumns({"gone": F.lit(None).cast("double"), "late": F.lit(1.0)})
    cur = cur.withColumns({"gone": F.lit(1.0), "late": F.lit(None).cast("double")})
    ref, cur, _ = prune_empty_columns(ref, cur)
    kept = [c for c in ref.columns if c in cur.columns]
    return ref.limit(1).select(F.explode(F.array(*[F.lit(c) for c in kept])).alias("column"))
