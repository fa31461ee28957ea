"""DuckDB SQL for the oracle check: the fixture pipeline written as plain
SQL CTEs, independent from the Spark code paths it checks."""

from __future__ import annotations

import numpy as np

from loanlens.sources.fixture import LOANS_SQL

# Fixed values, written out here on purpose: the SQL must not share them with the code it checks.
REVOL_UTIL_EDGES = (0, 30, 60, 90, 150)
REVOL_UTIL_LABELS = ("low", "moderate", "high", "very_high")
DTI_EDGES = (0, 10, 20, 30, 100)
DTI_LABELS = ("low_dti", "moderate_dti", "high_dti", "very_high_dti")
INQUIRY_EDGES = (-1, 1, 3, 6, 100)
INQUIRY_LABELS = ("low_inquiry", "moderate_inquiry", "high_inquiry", "very_high_inquiry")
DELINQUENCY_EDGES = (-1, 0, 2, 5, 100)
DELINQUENCY_LABELS = ("no_delinquency", "low_delinquency", "moderate_delinquency", "high_delinquency")
EMPLOYMENT_EDGES = (-1, 1, 5, 10, 50)
EMPLOYMENT_LABELS = ("new", "short_term", "medium_term", "long_term")
LOAN_SIZE_LABELS = ("small", "medium", "large", "very_large")
RISK_BAND_EDGES = (0, 0.2, 0.4, 0.6, 0.8, 1)
RISK_BAND_LABELS = ("Very Low Risk", "Low Risk", "Medium Risk", "High Risk", "Very High Risk")

STRING_COLS = ("loan_status", "term", "grade", "sub_grade", "emp_length", "home_ownership",
               "verification_status", "purpose", "issue_d", "earliest_cr_line",
               "initial_list_status", "application_type")


def dbl(v: float) -> str:
    if v == float("inf"):
        return "'Infinity'::DOUBLE"
    if v == float("-inf"):
        return "'-Infinity'::DOUBLE"
    return f"CAST({v!r} AS DOUBLE)"


def div_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
            f"WHEN ({b}) <> 0 THEN ({a}) / ({b}) "
            f"WHEN ({a}) > 0 THEN 'Infinity'::DOUBLE WHEN ({a}) < 0 THEN '-Infinity'::DOUBLE "
            f"ELSE 'NaN'::DOUBLE END)")


def bucket_sql(x: str, edges, labels, closed: str = "right", include_lowest: bool = False
               ) -> str:
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if closed == "right":
            lower = f"{x} >= {lo}" if (include_lowest and i == 0) else f"{x} > {lo}"
            parts.append(f"WHEN {lower} AND {x} <= {hi} THEN '{lab}'")
        else:
            parts.append(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{lab}'")
    return "(CASE " + " ".join(parts) + " END)"


def month(c: str) -> str:
    return f"CAST(try_strptime({c}, '%b-%Y') AS DATE)"


_strip = ", ".join(fr"regexp_replace({c}, '^\s+|\s+$', '', 'g') AS {c}" for c in STRING_COLS)
_emp = r"coalesce(TRY_CAST(nullif(regexp_extract(emp_length, '(\d+)', 1), '') AS DOUBLE), 0.0)"
_q = ["qs.q[2]", "qs.q[3]", "qs.q[4]"]

BASE = f"""WITH {LOANS_SQL},
stripped AS (SELECT * REPLACE ({_strip}) FROM loans),
clean AS (SELECT *, CAST(loan_status = 'Charged Off' AS INTEGER) AS target_default
          FROM stripped WHERE loan_status IN ('Fully Paid', 'Charged Off')),
nonleaky AS (SELECT * EXCLUDE (funded_amnt, total_pymnt, recoveries) FROM clean),
qs AS (SELECT quantile_cont(loan_amnt, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM nonleaky),
feat0 AS (
  SELECT n.* REPLACE ({month('n.issue_d')} AS issue_d,
                      {month('n.earliest_cr_line')} AS earliest_cr_line),
    {div_sql('n.annual_inc', 'n.loan_amnt')} AS income_to_loan_ratio,
    {bucket_sql('n.revol_util', REVOL_UTIL_EDGES, REVOL_UTIL_LABELS)} AS revol_util_bucket,
    {bucket_sql('n.dti', DTI_EDGES, DTI_LABELS)} AS dti_bucket,
    {_emp} AS emp_length_clean,
    date_diff('day', {month('n.earliest_cr_line')}, {month('n.issue_d')}) / 365.0
      AS credit_history_years,
    {bucket_sql('n.inq_last_6mths', INQUIRY_EDGES, INQUIRY_LABELS)} AS inquiry_risk_bucket,
    {bucket_sql('n.delinq_2yrs', DELINQUENCY_EDGES, DELINQUENCY_LABELS)}
      AS delinquency_risk,
    {bucket_sql('n.loan_amnt', ['qs.q[1]', *_q, 'qs.q[5]'], LOAN_SIZE_LABELS,
                include_lowest=True)} AS loan_size_bucket,
    {div_sql('n.revol_bal', 'n.annual_inc')} AS revol_bal_to_income,
    {div_sql('n.installment * 12', 'n.annual_inc')} AS installment_to_income,
    coalesce(n.revol_util, 0.0) + coalesce(n.dti, 0.0) + coalesce(n.inq_last_6mths, 0.0)
      AS credit_exposure_score
  FROM nonleaky n, qs),
feat AS (SELECT *, {bucket_sql('emp_length_clean', EMPLOYMENT_EDGES, EMPLOYMENT_LABELS)}
           AS employment_stability FROM feat0),
scored AS (SELECT *, floor(credit_exposure_score * 10) / 3000.0 AS probability_default
           FROM feat),
ordered AS (SELECT *, row_number() OVER (ORDER BY issue_d, loan_id) - 1 AS _pos,
                   count(*) OVER () AS _n FROM scored),
splitted AS (
  SELECT * EXCLUDE (_pos, _n),
    CASE WHEN _pos < CAST(floor(_n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
         WHEN _pos < CAST(floor(_n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT)
           THEN 'val'
         ELSE 'test' END AS split
  FROM ordered)
"""

RISK_BAND_SQL = bucket_sql("probability_default", RISK_BAND_EDGES, RISK_BAND_LABELS)
SERVING_BAND_SQL = ("(CASE WHEN probability_default IS NULL THEN NULL "
                    "WHEN probability_default < 0.2 THEN 'Very Low' "
                    "WHEN probability_default < 0.4 THEN 'Low' "
                    "WHEN probability_default < 0.6 THEN 'Medium' "
                    "WHEN probability_default < 0.8 THEN 'High' ELSE 'Very High' END)")
DECISION_SQL = ("(CASE WHEN probability_default < 0.2 THEN 'Approve' "
                "WHEN probability_default >= 0.5 THEN 'Reject' ELSE 'Manual Review' END)")


def q(body: str) -> str:
    return BASE + body


def linspace_list(bins: int) -> str:
    return "[" + ", ".join(dbl(float(v)) for v in np.linspace(0, 1, bins + 1)) + "]"


def psi_sql(expected: str, actual: str, col: str, bins: int = 10, label: str = "") -> str:
    """PSI of ``actual`` vs ``expected`` (relations exposing ``col``) as one
    SELECT returning (feature, psi)."""
    return f"""(
  WITH e AS (SELECT CAST({col} AS DOUBLE) AS x FROM {expected}),
  a AS (SELECT CAST({col} AS DOUBLE) AS x FROM {actual}),
  edges AS (SELECT list_sort(list_distinct(quantile_cont(x, {linspace_list(bins)}))) AS ed
            FROM e WHERE x IS NOT NULL AND NOT isnan(x)),
  inner_e AS (SELECT ed[2:len(ed) - 1] AS inner_edges, len(ed) - 1 AS nb FROM edges),
  ne AS (SELECT count(*) AS n FROM e), na AS (SELECT count(*) AS n FROM a),
  ce AS (SELECT len(list_filter(inner_edges, lambda t: t <= x)) AS bin, count(*) AS c
         FROM e, inner_e WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1),
  ca AS (SELECT len(list_filter(inner_edges, lambda t: t <= x)) AS bin, count(*) AS c
         FROM a, inner_e WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1),
  b AS (SELECT unnest(range(nb)) AS bin FROM inner_e),
  pc AS (SELECT b.bin,
           CASE WHEN coalesce(ce.c, 0) = 0 THEN 1e-6 ELSE ce.c / (SELECT n FROM ne) END AS ep,
           CASE WHEN coalesce(ca.c, 0) = 0 THEN 1e-6 ELSE ca.c / (SELECT n FROM na) END AS ap
         FROM b LEFT JOIN ce ON b.bin = ce.bin LEFT JOIN ca ON b.bin = ca.bin)
  SELECT '{label or col}' AS feature, round(coalesce(sum((ap - ep) * ln(ap / ep)), 0.0), 6) AS psi
  FROM pc)"""
