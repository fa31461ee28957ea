from loanlens.operators.decisions import (build_scorecard, decision, risk_band, risk_score,
                                          serving_risk_band)


def test_band_closures_and_decisions(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.35,), (0.5,), (0.8,), (1.0,), (None,),
                                (float("nan"),)], "p double")
    rows = df.select(risk_band("p").alias("b"), serving_risk_band("p").alias("s"),
                     decision("p").alias("d"), risk_score("p").alias("r")).collect()
    assert [r.b for r in rows[:6]] == [None, "Very Low Risk", "Low Risk", "Medium Risk",
                                       "High Risk", "Very High Risk"]
    assert [r.s for r in rows[:6]] == ["Very Low", "Low", "Low", "Medium", "Very High",
                                       "Very High"]
    assert [r.d for r in rows] == ["Approve", "Manual Review", "Manual Review", "Reject",
                                   "Reject", "Reject", "Manual Review", "Manual Review"]
    assert rows[2].r == 650


def test_scorecard_columns(spark):
    df = spark.createDataFrame([(0.145, 0)], "probability_default double, target_default int")
    sc = build_scorecard(df)
    assert sc.columns == ["risk_score", "probability_default", "risk_band", "decision", "actual"]
    r = sc.first()
    assert (r.risk_score, r.risk_band, r.decision) == (855, "Very Low Risk", "Approve")
