"""Registered queries: name -> (Spark job, DuckDB oracle SQL or None).

Every query reads the provided tables (through the fixture loan view or
directly), so its work grows with them. Double results are rounded on
both sides where engines may differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators import decisions as dec
from loanlens.operators import features as fe
from loanlens.operators import metrics as me
from loanlens.operators import reports as rp
from loanlens.operators.cleaning import drop_leaky_columns, inf_to_null
from loanlens.operators.splits import split_bounds
from loanlens.plans import frames as fr
from loanlens.plans import oracle as oq
from loanlens.plans.oracle import (DECISION_SQL, RISK_BAND_SQL, SERVING_BAND_SQL, dbl, psi_sql,
                                   q)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PROB = fr.PROB


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- 2.B cleaning ------------------------------------------------------------

@register("clean_and_label", q("SELECT * FROM clean"))
def _clean_and_label(spark, sf):
    return fr.cleaned(spark, sf)


@register("drop_leaky", q("SELECT * FROM nonleaky"))
def _drop_leaky(spark, sf):
    return fr.cleaned(spark, sf).transform(drop_leaky_columns)


# --- 2.C features ------------------------------------------------------------

@register("feature_ratios", q(
    "SELECT loan_id, income_to_loan_ratio, revol_bal_to_income, installment_to_income "
    "FROM feat"))
def _feature_ratios(spark, sf):
    return fr.row_features(spark, sf).select("loan_id", "income_to_loan_ratio",
                                         "revol_bal_to_income", "installment_to_income")


@register("feature_buckets", q(
    "SELECT loan_id, revol_util_bucket, dti_bucket, inquiry_risk_bucket, delinquency_risk "
    "FROM feat"))
def _feature_buckets(spark, sf):
    return fr.row_features(spark, sf).select("loan_id", "revol_util_bucket", "dti_bucket",
                                         "inquiry_risk_bucket", "delinquency_risk")


@register("employment_stability", q(
    "SELECT loan_id, emp_length, emp_length_clean, employment_stability FROM feat"))
def _employment(spark, sf):
    return fr.row_features(spark, sf).select("loan_id", "emp_length", "emp_length_clean",
                                         "employment_stability")


# Dates leave as ISO text: engines hand DATE to pandas as different types.
@register("credit_history", q(
    "SELECT loan_id, strftime(issue_d, '%Y-%m-%d') AS issue_d, "
    "strftime(earliest_cr_line, '%Y-%m-%d') AS earliest_cr_line, "
    "round(credit_history_years, 6) AS credit_history_years FROM feat"))
def _credit_history(spark, sf):
    return fr.row_features(spark, sf).select(
        "loan_id", F.date_format("issue_d", "yyyy-MM-dd").alias("issue_d"),
        F.date_format("earliest_cr_line", "yyyy-MM-dd").alias("earliest_cr_line"),
        F.round("credit_history_years", 6).alias("credit_history_years"))


@register("loan_size_bucket", q("SELECT loan_id, loan_amnt, loan_size_bucket FROM feat"))
def _loan_size(spark, sf):
    return fr.features(spark, sf).select("loan_id", "loan_amnt", "loan_size_bucket")


@register("exposure_score", q(
    "SELECT loan_id, round(credit_exposure_score, 6) AS credit_exposure_score FROM feat"))
def _exposure(spark, sf):
    return fr.features(spark, sf).select(
        "loan_id", F.round("credit_exposure_score", 6).alias("credit_exposure_score"))


# --- 2.F reports -------------------------------------------------------------

# Column list and Spark type names of the feature table (checked by a test).
FEATURE_TABLE = (
    ("loan_id", "bigint"), ("loan_status", "string"), ("loan_amnt", "double"),
    ("term", "string"), ("int_rate", "double"), ("installment", "double"),
    ("grade", "string"), ("sub_grade", "string"), ("emp_length", "string"),
    ("home_ownership", "string"), ("annual_inc", "double"),
    ("verification_status", "string"), ("purpose", "string"), ("dti", "double"),
    ("issue_d", "date"), ("earliest_cr_line", "date"), ("revol_util", "double"),
    ("revol_bal", "double"), ("inq_last_6mths", "double"), ("delinq_2yrs", "double"),
    ("open_acc", "double"), ("pub_rec", "double"), ("total_acc", "double"),
    ("mths_since_last_delinq", "double"), ("initial_list_status", "string"),
    ("application_type", "string"), ("target_default", "int"),
    ("income_to_loan_ratio", "double"), ("revol_util_bucket", "string"),
    ("dti_bucket", "string"), ("emp_length_clean", "double"),
    ("employment_stability", "string"), ("credit_history_years", "double"),
    ("inquiry_risk_bucket", "string"), ("delinquency_risk", "string"),
    ("loan_size_bucket", "string"), ("revol_bal_to_income", "double"),
    ("installment_to_income", "double"), ("credit_exposure_score", "double"),
)


def _audit_sql() -> str:
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
        f"count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c})) / count(*) * 100, 6) AS missing_percent, "
        f"count(DISTINCT {c}) AS unique_values FROM feat"
        for i, (c, t) in enumerate(FEATURE_TABLE)]
    return q(" UNION ALL ".join(parts))


@register("audit_table", _audit_sql())
def _audit(spark, sf):
    return rp.audit_table(fr.features(spark, sf))


@register("dtype_counts", q(
    "SELECT dtype, count(*) AS n_columns FROM (VALUES "
    + ", ".join(f"('{c}', '{t}')" for c, t in FEATURE_TABLE)
    + ") v(c, dtype) GROUP BY dtype"))
def _dtype_counts(spark, sf):
    return rp.dtype_counts(rp.audit_table(fr.features(spark, sf)))


@register("most_missing", None)
def _most_missing(spark, sf):
    return rp.most_missing(rp.audit_table(fr.features(spark, sf)), 50)


ORACLE["most_missing"] = q(
    "SELECT * FROM (" + _audit_sql()[len(oq.BASE):] + ") ORDER BY missing_percent DESC, "
    "position LIMIT 50")


@register("value_counts", q(
    "SELECT emp_length, count(*) AS count, round(count(*) / (SELECT count(*) FROM clean) * 100,"
    " 6) AS percent FROM clean GROUP BY emp_length"))
def _value_counts(spark, sf):
    return rp.value_counts(fr.cleaned(spark, sf), "emp_length")


@register("overall_default_rate", q(
    "SELECT round(avg(target_default) * 100, 6) AS default_rate, count(*) AS n FROM clean"))
def _overall(spark, sf):
    return rp.overall_default_rate(fr.cleaned(spark, sf))


_RATE_KEYS = {
    "grade": "grade", "sub_grade": "sub_grade", "home_ownership": "home_ownership",
    "purpose": "purpose", "delinq": "delinq_2yrs", "dti_bucket": "dti_bucket",
    "employment": "employment_stability", "inquiry": "inquiry_risk_bucket",
}


# Report order per key (notebook semantics): by rate, by key, or bucket order.
_RATE_ORDER = {
    "delinq_2yrs": ("key", None),
    "dti_bucket": ("labels", fe.DTI_LABELS),
    "employment_stability": ("labels", fe.EMPLOYMENT_LABELS),
    "inquiry_risk_bucket": ("labels", fe.INQUIRY_LABELS),
}


def _rate_query(key: str) -> Query:
    order, labels = _RATE_ORDER.get(key, ("rate", None))
    return lambda spark, sf: rp.default_rate(fr.row_features(spark, sf), key, order=order,
                                             labels=labels)


for _name, _key in _RATE_KEYS.items():
    register(f"default_rate_by_{_name}", q(
        f"SELECT {_key}, round(avg(target_default) * 100, 6) AS default_rate, count(*) AS n "
        f"FROM feat WHERE {_key} IS NOT NULL GROUP BY {_key}"))(_rate_query(_key))


@register("default_rate_by_band", q(
    f"SELECT risk_band, round(avg(target_default) * 100, 6) AS default_rate, count(*) AS n "
    f"FROM (SELECT *, {RISK_BAND_SQL} AS risk_band FROM scored) WHERE risk_band IS NOT NULL "
    f"GROUP BY risk_band"))
def _rate_band(spark, sf):
    s = fr.scored(spark, sf).withColumn("risk_band", dec.risk_band(PROB))
    return rp.default_rate(s, "risk_band")


@register("default_rate_by_decision", q(
    f"SELECT decision, round(avg(target_default) * 100, 6) AS default_rate, count(*) AS n "
    f"FROM (SELECT *, {DECISION_SQL} AS decision FROM scored) GROUP BY decision"))
def _rate_decision(spark, sf):
    s = fr.scored(spark, sf).withColumn("decision", dec.decision(PROB))
    return rp.default_rate(s, "decision")


@register("portfolio_summary", q(
    f"SELECT decision, round(avg(probability_default), 6) AS avg_pd, count(*) AS n_loans, "
    f"round(avg(target_default), 6) AS actual_default_rate "
    f"FROM (SELECT *, {DECISION_SQL} AS decision FROM scored) GROUP BY decision"))
def _portfolio_summary(spark, sf):
    s = fr.scored(spark, sf).withColumn("decision", dec.decision(PROB))
    return rp.portfolio_summary(s)


@register("portfolio_exposure", q(
    f"SELECT risk_band, count(*) AS total_loans, round(sum(loan_amnt), 2) AS total_exposure, "
    f"round(avg(int_rate), 2) AS avg_interest_rate "
    f"FROM (SELECT *, {RISK_BAND_SQL} AS risk_band FROM scored) GROUP BY risk_band "
    f"ORDER BY total_exposure DESC"))
def _portfolio_exposure(spark, sf):
    s = fr.scored(spark, sf).withColumn("risk_band", dec.risk_band(PROB))
    return rp.portfolio_exposure(s)


DTI_SEGMENTATION_SQL = q("""
SELECT CASE WHEN dti < 10 THEN 'Low DTI' WHEN dti < 20 THEN 'Moderate DTI'
            WHEN dti < 30 THEN 'High DTI' ELSE 'Very High DTI' END AS dti_segment,
       count(*) AS borrower_count,
       round(avg(target_default) * 100, 2) AS default_rate
FROM feat GROUP BY dti_segment ORDER BY default_rate DESC""")


@register("dti_segmentation", DTI_SEGMENTATION_SQL)
def dti_segmentation_query(spark, sf):
    return rp.dti_segmentation(fr.row_features(spark, sf))


@register("class_balance", q(
    "SELECT CAST(sum(CASE WHEN target_default = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, "
    "CAST(sum(CASE WHEN target_default = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, "
    "CASE WHEN coalesce(sum(target_default), 0) = 0 THEN 1.0 ELSE "
    "sum(1 - target_default) / sum(target_default) END AS scale_pos_weight FROM clean"))
def _class_balance(spark, sf):
    return rp.class_balance(fr.cleaned(spark, sf))


CORR_COLUMNS = ("loan_amnt", "int_rate", "installment", "annual_inc", "dti", "revol_util",
                "revol_bal", "inq_last_6mths", "delinq_2yrs", "open_acc", "pub_rec",
                "total_acc", "mths_since_last_delinq", "income_to_loan_ratio", "emp_length_clean",
                "credit_history_years", "revol_bal_to_income", "installment_to_income",
                "credit_exposure_score")


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


def _corr_rows(pairs: list[tuple[str, str]], row: str) -> str:
    """One scan with a correlation per pair, then one row each; ``row`` has the
    label columns of pair ``{a}``, ``{b}``."""
    return (", wide AS MATERIALIZED (SELECT "
            + ", ".join(f"round(corr({_finite(a)}, {_finite(b)}), 6) AS c{i}"
                        for i, (a, b) in enumerate(pairs)) + " FROM feat), corrs AS ("
            + " UNION ALL ".join(f"SELECT {row.format(a=a, b=b)}, c{i} AS corr FROM wide"
                                 for i, (a, b) in enumerate(pairs)) + ")")


_TARGET_CORR = _corr_rows([(c, "target_default") for c in CORR_COLUMNS], "'{a}' AS feature")


def _corr_frame(spark, sf):
    return fr.row_features(spark, sf).transform(inf_to_null)


@register("target_correlation", q(_TARGET_CORR + " SELECT * FROM corrs"))
def _target_corr(spark, sf):
    return rp.target_correlation(_corr_frame(spark, sf), columns=CORR_COLUMNS)


@register("correlation_matrix", q(_corr_rows(
    [(a, b) for a in CORR_COLUMNS for b in CORR_COLUMNS], "'{a}' AS col_a, '{b}' AS col_b")
    + " SELECT * FROM corrs"))
def _corr_matrix(spark, sf):
    return rp.correlation_matrix(_corr_frame(spark, sf), columns=CORR_COLUMNS)


@register("histogram", q("""
, mm AS (SELECT min(annual_inc) AS lo, max(annual_inc) AS hi FROM clean),
h AS (SELECT CAST(least(floor((annual_inc - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin,
             count(*) AS c FROM clean, mm WHERE annual_inc IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS bin_lo,
       round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS bin_hi,
       CAST(coalesce(h.c, 0) AS BIGINT) AS count
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b CROSS JOIN mm
LEFT JOIN h ON b.bin = h.bin"""))
def _histogram(spark, sf):
    return rp.histogram(fr.cleaned(spark, sf), "annual_inc", 50)


@register("boxplot_stats", q("""
, qq AS (SELECT target_default, quantile_cont(dti, 0.25) AS q1, quantile_cont(dti, 0.5) AS med,
                quantile_cont(dti, 0.75) AS q3 FROM clean WHERE dti IS NOT NULL
         GROUP BY target_default)
SELECT c.target_default, 'dti' AS feature, round(q1, 6) AS q1, round(med, 6) AS median,
       round(q3, 6) AS q3,
       round(min(CASE WHEN dti >= q1 - 1.5 * (q3 - q1) THEN dti END), 6) AS whisker_low,
       round(max(CASE WHEN dti <= q3 + 1.5 * (q3 - q1) THEN dti END), 6) AS whisker_high,
       count(*) AS n
FROM clean c JOIN qq ON c.target_default = qq.target_default
WHERE dti IS NOT NULL GROUP BY c.target_default, q1, med, q3"""))
def _boxplot(spark, sf):
    return rp.boxplot_stats(fr.cleaned(spark, sf), "dti")


# --- 2.J splits --------------------------------------------------------------

@register("time_split_bounds", q(
    "SELECT split, strftime(min(issue_d), '%Y-%m-%d') AS start, "
    "strftime(max(issue_d), '%Y-%m-%d') AS \"end\", count(*) AS n "
    "FROM splitted GROUP BY split"))
def _split_bounds(spark, sf):
    b = split_bounds(fr.split_scored(spark, sf))
    return b.select("split", F.date_format("start", "yyyy-MM-dd").alias("start"),
                    F.date_format("end", "yyyy-MM-dd").alias("end"), "n")


@register("split_assignment", q("SELECT loan_id, split FROM splitted"))
def _split_assignment(spark, sf):
    return fr.split_scored(spark, sf).select("loan_id", "split")


# --- 2.L metrics -------------------------------------------------------------

_SCORE_TABLE = """
, g AS (SELECT probability_default AS score, sum(target_default) AS pos,
               count(*) - sum(target_default) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
"""


@register("roc_auc_gini", q(_SCORE_TABLE + """
SELECT round(sum(neg * (cum_pos - pos * 0.5)) / (max(P) * max(N)), 6) AS roc_auc,
       round(2 * (sum(neg * (cum_pos - pos * 0.5)) / (max(P) * max(N))) - 1, 6) AS gini
FROM c, t"""))
def _roc_auc(spark, sf):
    return me.binary_metrics(fr.scored_table(spark, sf), "target_default", PROB).select(
        "roc_auc", "gini")


@register("ks", q(_SCORE_TABLE + """
SELECT round(greatest(max(cum_pos / P - cum_neg / N), 0.0), 6) AS ks FROM c, t"""))
def _ks(spark, sf):
    return me.binary_metrics(fr.scored_table(spark, sf), "target_default", PROB).select("ks")


@register("roc_points", q(_SCORE_TABLE + """
SELECT 'Infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, round(cum_neg / N, 6), round(cum_pos / P, 6) FROM c, t"""))
def _roc_points(spark, sf):
    return me.roc_points(fr.scored_table(spark, sf), "target_default", PROB)


@register("decile_lift", q("""
, r AS (SELECT target_default AS y, row_number() OVER (ORDER BY probability_default DESC,
               loan_id) - 1 AS i, count(*) OVER () AS n FROM scored),
d AS (SELECT y, CAST(greatest(1, ceil(i * 10 / (n - 1))) AS INTEGER) AS decile FROM r),
o AS (SELECT avg(y) AS rate, sum(y) AS ev FROM d),
tab AS (SELECT decile, count(*) AS n, sum(y) AS n_events FROM d GROUP BY decile),
cum AS (SELECT *, sum(n_events) OVER (ORDER BY decile) AS cumulative_events,
               sum(n) OVER (ORDER BY decile) AS cumulative_n FROM tab)
SELECT decile, n, CAST(n_events AS BIGINT) AS n_events,
       round(n_events / n, 6) AS event_rate, round(n_events / n / rate, 6) AS lift,
       CAST(cumulative_events AS BIGINT) AS cumulative_events,
       round(cumulative_events / ev, 6) AS cumulative_pct_events,
       CAST(cumulative_n AS BIGINT) AS cumulative_n,
       round(cumulative_events / cumulative_n / rate, 6) AS cumulative_lift
FROM cum, o"""))
def _decile_lift(spark, sf):
    return me.decile_lift_table(fr.scored_table(spark, sf), "target_default", PROB)


@register("psi_score", q(
    ", tr AS (SELECT * FROM splitted WHERE split = 'train'), "
    "te AS (SELECT * FROM splitted WHERE split = 'test') SELECT psi FROM "
    + psi_sql("tr", "te", "probability_default")))
def _psi_score(spark, sf):
    s = fr.split_scored(spark, sf)
    val = me.psi(s.filter("split = 'train'"), s.filter("split = 'test'"), PROB)
    return spark.createDataFrame([(round(val, 6),)], "psi double").select(
        F.col("psi").cast("double"))


PSI_FEATURES = ("loan_amnt", "int_rate", "dti", "revol_util", "annual_inc")


@register("psi_features", q(
    ", tr AS (SELECT * FROM splitted WHERE split = 'train'), "
    "te AS (SELECT * FROM splitted WHERE split = 'test') "
    + " UNION ALL ".join(f"SELECT * FROM {psi_sql('tr', 'te', c)}" for c in PSI_FEATURES)))
def _psi_features(spark, sf):
    s = fr.split_scored(spark, sf)
    return me.psi_by_column(s.filter("split = 'train'"), s.filter("split = 'test'"),
                            PSI_FEATURES)


@register("confusion", q(
    "SELECT " + ", ".join(
        f"CAST(sum(CASE WHEN target_default = {a} AND (probability_default > 0.5) = {b} "
        f"THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for n, a, b in (("tn", 0, "false"), ("fp", 0, "true"), ("fn", 1, "false"),
                        ("tp", 1, "true"))) + " FROM scored"))
def _confusion(spark, sf):
    return me.confusion_counts(fr.scored(spark, sf), "target_default", PROB)


def _safe(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE ({n}) / ({d}) END)"


@register("classification_report", q(f"""
, cc AS (SELECT CAST(sum(CASE WHEN target_default = 0 AND probability_default < 0.4 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
                CAST(sum(CASE WHEN target_default = 0 AND probability_default >= 0.4 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
                CAST(sum(CASE WHEN target_default = 1 AND probability_default < 0.4 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
                CAST(sum(CASE WHEN target_default = 1 AND probability_default >= 0.4 THEN 1 ELSE 0 END) AS DOUBLE) AS tp
         FROM scored),
m AS (SELECT {_safe('tn', 'tn + fn')} AS p0, {_safe('tn', 'tn + fp')} AS r0,
             {_safe('2 * tn', '2 * tn + fn + fp')} AS f0,
             {_safe('tp', 'tp + fp')} AS p1, {_safe('tp', 'tp + fn')} AS r1,
             {_safe('2 * tp', '2 * tp + fp + fn')} AS f1, tn + fp AS s0, tp + fn AS s1 FROM cc)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall,
       round(f0, 6) AS f1_score, CAST(s0 AS BIGINT) AS support FROM m
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6),
                 round((f0 + f1) / 2, 6), CAST(s0 + s1 AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round({_safe('p0 * s0 + p1 * s1', 's0 + s1')}, 6),
                 round({_safe('r0 * s0 + r1 * s1', 's0 + s1')}, 6),
                 round({_safe('f0 * s0 + f1 * s1', 's0 + s1')}, 6),
                 CAST(s0 + s1 AS BIGINT) FROM m"""))
def _classification_report(spark, sf):
    return me.classification_report(fr.scored(spark, sf), "target_default", PROB, 0.40)


def _sweep_sql() -> str:
    parts = []
    for t in me.default_thresholds():
        lit = dbl(t)
        tp = f"sum(CASE WHEN probability_default >= {lit} AND target_default = 1 THEN 1 ELSE 0 END)"
        fp = f"sum(CASE WHEN probability_default >= {lit} AND target_default = 0 THEN 1 ELSE 0 END)"
        fn = f"sum(CASE WHEN probability_default < {lit} AND target_default = 1 THEN 1 ELSE 0 END)"
        parts.append(
            f"SELECT {lit} AS threshold, round({_safe(tp, f'{tp} + {fp}')}, 6) AS precision, "
            f"round({_safe(tp, f'{tp} + {fn}')}, 6) AS recall, "
            f"round({_safe(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1_score "
            f"FROM scored")
    return q(" UNION ALL ".join(parts))


@register("threshold_sweep", _sweep_sql())
def _sweep(spark, sf):
    return me.sweep_thresholds(fr.scored_table(spark, sf), "target_default", PROB)


@register("brier", q(
    "SELECT round(avg(pow(probability_default - target_default, 2)), 6) AS brier FROM scored"))
def _brier(spark, sf):
    return fr.scored(spark, sf).agg(
        F.round(me.brier_score(None, "target_default", PROB), 6).alias("brier"))


@register("reliability_curve", q(
    "SELECT len(list_filter([" + ", ".join(
        dbl(float(e)) for e in __import__("numpy").linspace(0, 1, 11)[1:-1])
    + "], lambda e: e < probability_default)) AS bin, round(avg(target_default), 6) AS prob_true,"
    " round(avg(probability_default), 6) AS prob_pred, count(*) AS n FROM scored GROUP BY 1"))
def _reliability(spark, sf):
    return me.reliability_curve(fr.scored_table(spark, sf), "target_default", PROB)


@register("vintage_auc", q("""
, g AS (SELECT strftime(issue_d, '%Y-%m') AS vintage, probability_default AS score,
               sum(target_default) AS pos, count(*) - sum(target_default) AS neg
        FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY vintage ORDER BY score DESC
                               ROWS UNBOUNDED PRECEDING) AS cum_pos FROM g)
SELECT vintage,
       round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
             sum(neg * (cum_pos - pos * 0.5)) / (sum(pos) * sum(neg)) END, 6) AS auc,
       CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos
FROM c GROUP BY vintage"""))
def _vintage_auc(spark, sf):
    return me.per_vintage_auc(fr.scored_table(spark, sf), "issue_d", "target_default", PROB)


# --- 2.M decisions -----------------------------------------------------------

@register("risk_band_batch", q(
    f"SELECT loan_id, probability_default, {RISK_BAND_SQL} AS risk_band FROM scored"))
def _band_batch(spark, sf):
    return fr.scored(spark, sf).select("loan_id", PROB, dec.risk_band(PROB).alias("risk_band"))


@register("risk_band_serving", q(
    f"SELECT loan_id, probability_default, {SERVING_BAND_SQL} AS risk_band FROM scored"))
def _band_serving(spark, sf):
    return fr.scored(spark, sf).select("loan_id", PROB,
                                       dec.serving_risk_band(PROB).alias("risk_band"))


@register("decisions", q(f"SELECT loan_id, {DECISION_SQL} AS decision FROM scored"))
def _decisions(spark, sf):
    return fr.scored(spark, sf).select("loan_id", dec.decision(PROB).alias("decision"))


@register("scorecard", q(
    f"SELECT loan_id, CAST(trunc((1 - probability_default) * 1000) AS INTEGER) AS risk_score, "
    f"probability_default, {RISK_BAND_SQL} AS risk_band, {DECISION_SQL} AS decision, "
    f"target_default AS actual FROM scored"))
def _scorecard(spark, sf):
    return dec.build_scorecard(fr.scored(spark, sf), keep=("loan_id",))


@register("scorecard_top20", q(
    f"SELECT loan_id, CAST(trunc((1 - probability_default) * 1000) AS INTEGER) AS risk_score, "
    f"probability_default, {RISK_BAND_SQL} AS risk_band, {DECISION_SQL} AS decision, "
    f"target_default AS actual FROM scored ORDER BY probability_default DESC, loan_id LIMIT 20"))
def _scorecard_top(spark, sf):
    """H7: the riskiest 20 loans of the scorecard (a top-k report)."""
    return (dec.build_scorecard(fr.scored(spark, sf), keep=("loan_id",))
            .orderBy(F.desc("probability_default"), "loan_id").limit(20))



# --- 2.E / 2.H / 2.K additions ----------------------------------------------------

# Second fixed score for the model-alignment query: exact in both engines.
ALT_SCORE_SQL = "floor(int_rate * 10) / 1000.0"


@register("vintage_auc_by_model", q("""
, g AS (SELECT m.model, strftime(issue_d, '%Y-%m') AS vintage, m.score,
               sum(target_default) AS pos, count(*) - sum(target_default) AS neg
        FROM scored,
             (SELECT 'exposure' AS model UNION ALL SELECT 'rate') mm,
             LATERAL (SELECT mm.model,
                        CASE WHEN mm.model = 'exposure' THEN probability_default
                             ELSE """ + ALT_SCORE_SQL + """ END AS score) m
        WHERE m.score IS NOT NULL
        GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model, vintage ORDER BY score DESC
                               ROWS UNBOUNDED PRECEDING) AS cum_pos FROM g),
a AS (SELECT model, vintage,
             round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
                   sum(neg * (cum_pos - pos * 0.5)) / (sum(pos) * sum(neg)) END, 6) AS auc
      FROM c GROUP BY model, vintage)
SELECT coalesce(e.vintage, r.vintage) AS vintage, e.auc AS exposure, r.auc AS rate
FROM (SELECT * FROM a WHERE model = 'exposure') e
FULL OUTER JOIN (SELECT * FROM a WHERE model = 'rate') r ON e.vintage = r.vintage"""))
def _vintage_by_model(spark, sf):
    s = fr.scored_table(spark, sf).withColumn(
        "alt_score", F.floor(F.col("int_rate") * 10) / F.lit(1000.0))
    return me.vintage_auc_by_model(s, {"exposure": PROB, "rate": "alt_score"})


@register("top_correlations", q(
    _TARGET_CORR + " SELECT * FROM (SELECT 'top' AS side, feature, corr FROM corrs "
    "WHERE corr IS NOT NULL ORDER BY corr DESC, feature LIMIT 15) "
    "UNION ALL SELECT * FROM (SELECT 'bottom' AS side, feature, corr FROM corrs "
    "WHERE corr IS NOT NULL ORDER BY corr ASC, feature LIMIT 15)"))
def _top_correlations(spark, sf):
    """H2: the 15 strongest positive / negative correlates of the target (top-k report)."""
    corr = rp.target_correlation(_corr_frame(spark, sf), columns=CORR_COLUMNS)
    top, bottom = rp.top_bottom(corr, 15)
    return (top.select(F.lit("top").alias("side"), "feature", "corr")
            .unionByName(bottom.select(F.lit("bottom").alias("side"), "feature", "corr")))


@register("baseline_accuracy", q(
    "SELECT round(1 - avg(target_default), 6) AS baseline_accuracy FROM clean"))
def _baseline_accuracy(spark, sf):
    """K8: accuracy of always predicting 'no default'."""
    return fr.cleaned(spark, sf).agg(
        F.round(1 - F.avg("target_default"), 6).alias("baseline_accuracy"))


@register("classification_metrics", q("""
, cc AS (SELECT CAST(sum(CASE WHEN target_default = 0 AND NOT probability_default > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
                CAST(sum(CASE WHEN target_default = 0 AND probability_default > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                CAST(sum(CASE WHEN target_default = 1 AND NOT probability_default > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
                CAST(sum(CASE WHEN target_default = 1 AND probability_default > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
         FROM scored)
SELECT tn, fp, fn, tp,
       round(""" + _safe("tp + tn", "tp + tn + fp + fn") + """, 6) AS accuracy,
       round(""" + _safe("tp", "tp + fp") + """, 6) AS precision,
       round(""" + _safe("tp", "tp + fn") + """, 6) AS recall,
       round(""" + _safe("2 * tp", "2 * tp + fp + fn") + """, 6) AS f1
FROM cc"""))
def _classification_metrics(spark, sf):
    """Accuracy, precision, recall, F1 at p > 0.5 (0 on zero division)."""
    return me.classification_metrics(fr.scored(spark, sf), "target_default", PROB)


def _histogram_sql(column: str, relation: str, bins: int = 50) -> str:
    return q(f"""
, mm AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {relation}),
h AS (SELECT CAST(least(floor(({column} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER)
             AS bin, count(*) AS c FROM {relation}, mm WHERE {column} IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (b.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi,
       CAST(coalesce(h.c, 0) AS BIGINT) AS count
FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b CROSS JOIN mm
LEFT JOIN h ON b.bin = h.bin""")


@register("histogram_score", _histogram_sql("probability_default", "scored"))
def _histogram_score(spark, sf):
    """F14 on the score: 50 equal-width bins of the probability column."""
    return rp.histogram(fr.scored_table(spark, sf), PROB, 50)


def _boxplot_sql(column: str) -> str:
    return q(f"""
, qq AS (SELECT target_default, quantile_cont({column}, 0.25) AS q1,
                quantile_cont({column}, 0.5) AS med, quantile_cont({column}, 0.75) AS q3
         FROM clean WHERE {column} IS NOT NULL GROUP BY target_default)
SELECT c.target_default, '{column}' AS feature, round(q1, 6) AS q1, round(med, 6) AS median,
       round(q3, 6) AS q3,
       round(min(CASE WHEN {column} >= q1 - 1.5 * (q3 - q1) THEN {column} END), 6) AS whisker_low,
       round(max(CASE WHEN {column} <= q3 + 1.5 * (q3 - q1) THEN {column} END), 6) AS whisker_high,
       count(*) AS n
FROM clean c JOIN qq ON c.target_default = qq.target_default
WHERE {column} IS NOT NULL GROUP BY c.target_default, q1, med, q3""")


def _boxplot_query(column: str) -> Query:
    return lambda spark, sf: rp.boxplot_stats(fr.cleaned(spark, sf), column)


for _col in ("annual_inc", "revol_util"):
    register(f"boxplot_stats_{_col}", _boxplot_sql(_col))(_boxplot_query(_col))
