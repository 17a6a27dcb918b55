"""Golden chains: the reference's own output tables are mutually recomputable
(SURVEY 5). Inputs are read from its processed CSVs; expected values likewise."""

import math

import pandas as pd
from pyspark.sql import functions as F

from civicflow.operators import evaluation as EV
from civicflow.operators import forecast as FC
from civicflow.operators import staffing
from tests.conftest import golden


def test_staffing_index_matches_golden(spark):
    weekly = pd.read_csv(golden("forecast_cluster_weekly.csv"))
    perf = pd.read_csv(golden("kmeans_cluster_performance.csv"))
    expected = pd.read_csv(golden("forecast_cluster_staffing.csv"))
    fc = spark.createDataFrame(weekly.rename(columns={"week": "week_start"})[
        ["cluster", "week_start", "forecast", "model", "is_proportional"]])
    pf = spark.createDataFrame(perf[["cluster", "mean_days", "pct_over_30d", "n_total"]].astype({"cluster": int}))
    got = staffing.workload_index(fc, pf).toPandas()
    m = got.merge(expected.rename(columns={"week": "week_start"}), on=["cluster", "week_start"], suffixes=("", "_g"))
    assert len(m) == len(expected) == 52
    for c in ("complexity_weight", "backlog_rate", "raw_workload", "workload_share"):
        assert (m[c] - m[f"{c}_g"]).abs().max() < 1e-9, c
    # property: shares sum to ~1 each week
    sums = got.groupby("week_start")["workload_share"].sum()
    assert ((sums - 1).abs() < 0.002).all()


def test_staffing_summary_matches_golden(spark):
    weekly = pd.read_csv(golden("forecast_cluster_weekly.csv"))
    perf = pd.read_csv(golden("kmeans_cluster_performance.csv"))
    expected = pd.read_csv(golden("forecast_cluster_summary.csv"))
    fc = spark.createDataFrame(weekly.rename(columns={"week": "week_start"})[
        ["cluster", "week_start", "forecast", "model", "is_proportional"]])
    pf = spark.createDataFrame(perf[["cluster", "mean_days", "pct_over_30d", "n_total"]].astype({"cluster": int}))
    got = staffing.staffing_summary(staffing.workload_index(fc, pf)).toPandas().sort_values("cluster")
    exp = expected.sort_values("cluster")
    for c in ("fc_13wk_total", "mean_weekly_fc", "mean_workload_share", "recommended_fte_share"):
        assert list(got[c].round(3)) == list(exp[c].round(3)), c


def test_damped_holt_aic_matches_golden(spark):
    hist = pd.read_csv(golden("forecast_historical.csv"))
    train = hist[hist["type"] == "train"]["actual"].astype(float).tolist()
    assert len(train) == 148
    row = spark.createDataFrame(
        [("city", len(train), train, FC.DAMPED, 0.1333, 0.0, 0.8, 0.0)],
        "series_id string, n int, ys array<double>, model string, alpha double, beta double, phi double, gamma double",
    )
    r = FC.score_params(row).collect()[0]
    assert round(r["aic"], 2) == 861.47
    assert abs(r["level"] - 67.2) < 0.1


def test_series_stats_match_golden(spark):
    hist = pd.read_csv(golden("forecast_historical.csv"))
    ys = hist["actual"].astype(float)
    df = spark.createDataFrame(
        [("city", pd.Timestamp(w).date(), float(y)) for w, y in zip(hist["week_start"], ys)],
        "series_id string, week_start date, y double",
    )
    from civicflow.operators import series as S

    st = S.series_stats(df).collect()[0]
    ac = S.lag_autocorr(df).collect()[0]
    assert round(st["mean"], 2) == 66.12
    assert round(st["cv"], 4) == 0.3012
    assert round(ac["autocorr_lag52"], 4) == -0.1858


def test_classification_report_matches_golden(spark):
    cm = pd.read_csv(golden("nlp_confusion_matrix.csv"), index_col=0)
    rep = pd.read_csv(golden("nlp_classification_report.csv")).set_index("class")
    rows = [(t, p, int(cm.loc[t, p])) for t in cm.index for p in cm.columns]
    conf = spark.createDataFrame(rows, "true_label string, pred_label string, n long")
    got = EV.classification_report(conf).toPandas().set_index("class")
    for cls in ("accuracy", "macro avg", "weighted avg", "Illegal Dumping"):
        for c in ("precision", "recall", "f1_score"):
            assert math.isclose(got.loc[cls, c], rep.loc[cls, c], abs_tol=1e-9), (cls, c)


def test_gap_flags_match_golden(spark):
    """Gap days and flags from the golden category-performance medians
    (half-even rounding in the reference -> allow one unit in the last digit)."""
    cat = pd.read_csv(golden("kmeans_category_performance.csv"))
    df = spark.createDataFrame(cat[["median_days", "city_median_days"]])
    from civicflow.functions import labels as L

    got = df.select(
        F.round(F.col("median_days") - F.col("city_median_days"), 2).alias("gap"),
        L.gap_flag(F.col("median_days"), F.col("city_median_days")).alias("flag"),
    ).toPandas()
    assert ((got["gap"] - cat["days_vs_city_median"]).abs() <= 0.0100001).all()
    exp_flag = cat["gap_flag"].fillna("").map(lambda s: "SLOW" if "SLOW" in s else ("FAST" if "FAST" in s else ""))
    assert list(got["flag"]) == list(exp_flag)
