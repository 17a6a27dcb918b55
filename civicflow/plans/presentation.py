"""Registered page queries: parameterised filters and display projections
(B9-B11, B13, S18, S25, L1, W6, F13, J14, L5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicflow.functions import text as T
from civicflow.operators import forecast as FC
from civicflow.operators import series as S
from civicflow.plans import forecast as PF
from civicflow.plans import geo as PG
from civicflow.plans.requests import _CLEAN, cleaned
from civicflow.plans import forecast_sql as FS
from civicflow.plans.series import DENSE_SQL, SPLIT_SQL, dense
from civicflow.plans.staffing import _ZONE_METRICS, q_zone_forecast_metrics

# Page parameters (the selections a user makes).
ZONES = [1, 2, 4]
CATEGORY = "1-URGENT"


def q_zone_category_filter(spark, sf_dir):
    """Zone multi-select plus one category."""
    r = cleaned(spark, sf_dir)
    return r.filter(F.col("cluster").isin(*ZONES) & (F.col("category_short") == CATEGORY)).select(
        "object_id", "cluster", "category_short", "lat", "long")


def q_zone_enriched_display(spark, sf_dir):
    """The zone census/terrain table as display strings."""
    t = PG.q_tract_weighted_means(spark, sf_dir)
    e = PG.q_zone_terrain_summary(spark, sf_dir).select("cluster", "elevation_mean_m")
    j = t.join(e, "cluster", "left")
    return j.select(
        F.concat(F.lit("Z"), F.col("cluster").cast("string")).alias("zone"),
        F.format_number(F.col("total_population").cast("double"), 0).alias("population"),
        F.format_string("%.1f", F.round("incidents_per_1k_res", 1)).alias("inc_per_1k"),
        F.format_number(F.round("mean_pop_density_sqkm", 0), 0).alias("density"),
        F.when(F.col("wtd_median_income").isNull(), F.lit("-"))
        .otherwise(F.concat(F.lit("$"), F.format_number(F.col("wtd_median_income"), 0))).alias("med_income"),
        F.when(F.col("elevation_mean_m").isNull(), F.lit("-"))
        .otherwise(F.concat(F.format_string("%.0f", F.round("elevation_mean_m", 0)), F.lit("m"))).alias("elev"),
    )


def q_model_display(spark, sf_dir):
    """S25 + S18: forecast rows with model labels stripped of their parenthesised
    suffix and values floored at zero, in week order (L1)."""
    full = PF.refit_full(spark, sf_dir, PF.winners_on_train(spark, sf_dir))
    prop = PF.proportional(spark, sf_dir, FC.forecast_path(full))
    return prop.select(
        "series_id", "week_start", T.strip_parenthesised_suffix(F.col("model")).alias("model"),
        F.greatest(F.col("forecast"), F.lit(0.0)).alias("forecast"),
    ).orderBy("series_id", "week_start")


def q_zone_forecast_display(spark, sf_dir):
    """B13 + S25: the zone forecast-metrics table as displayed (Z-labels, model names
    without their parenthesised suffix, rounded errors)."""
    m = q_zone_forecast_metrics(spark, sf_dir)
    return m.select(
        F.concat(F.lit("Z"), F.col("cluster").cast("string")).alias("zone"),
        T.strip_parenthesised_suffix(F.col("model")).alias("model"),
        F.round("mean_weekly", 1).alias("mean_wk"),
        F.round("mae", 2).alias("mae"),
        F.round("rmse", 2).alias("rmse"),
        F.round("mape", 1).alias("mape_pct"),
    )


def q_recent_weeks(spark, sf_dir):
    """W6 + L1: the last 13 weeks of each series, flagged if inside the last 52."""
    d = dense(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy(F.desc("week_start"))
    r = d.withColumn("_rn", F.row_number().over(w))
    return r.filter(F.col("_rn") <= 13).select(
        "series_id", "week_start", "y", (F.col("_rn") <= 52).alias("in_last_52")
    ).orderBy("series_id", "week_start")


def q_forecast_history(spark, sf_dir):
    """F13 + J14 + L5: each series' weeks tagged train / test with the fitted value of
    the training winner (one-step fit on train, hold-out forecast on test)."""
    win = PF.winners_on_train(spark, sf_dir)
    res = FC.fitted_residuals(win).select("series_id", F.posexplode("residuals").alias("pos", "resid"))
    split = S.split_train_test(dense(spark, sf_dir))
    train = split.filter(F.col("split") == "train").withColumn(
        "pos", F.row_number().over(Window.partitionBy("series_id").orderBy("week_start")) - 1)
    fitted_train = train.join(res, ["series_id", "pos"], "left").select(
        "series_id", "week_start", F.col("y").alias("actual"), F.lit("train").alias("type"),
        F.round(F.col("y") - F.col("resid"), 1).alias("fitted"))
    test = split.filter(F.col("split") == "test").join(
        FC.forecast_path(win).select("series_id", "week_start", "forecast"), ["series_id", "week_start"], "left")
    fitted_test = test.select("series_id", "week_start", F.col("y").alias("actual"), F.lit("test").alias("type"),
                              F.round("forecast", 1).alias("fitted"))
    return fitted_train.unionByName(fitted_test)


QUERIES = {
    "zone_category_filter": q_zone_category_filter,
    "zone_enriched_display": q_zone_enriched_display,
    "model_display": q_model_display,
    "zone_forecast_display": q_zone_forecast_display,
    "recent_weeks": q_recent_weeks,
    "forecast_history": q_forecast_history,
}

_PROP = PF.ORACLE["proportional_forecast"]
_TWM = PG.ORACLE["tract_weighted_means"]
_ZTS = PG.ORACLE["zone_terrain_summary"]

_HISTORY = f"""
WITH res AS ({FS.residuals_sql(PF._WIN_TRAIN)}),
r AS (SELECT series_id, unnest(generate_series(0, len(residuals) - 1)) AS pos, unnest(residuals) AS resid FROM res),
sp AS (SELECT *, row_number() OVER (PARTITION BY series_id, split ORDER BY week_start) - 1 AS pos FROM ({SPLIT_SQL}) s),
hold AS (SELECT series_id, week_start, forecast FROM ({FS.forecast_sql(PF._WIN_TRAIN)}) h)
SELECT sp.series_id, sp.week_start, sp.y AS actual, 'train' AS type, round(sp.y - r.resid, 1) AS fitted
FROM sp LEFT JOIN r ON r.series_id = sp.series_id AND r.pos = sp.pos WHERE sp.split = 'train'
UNION ALL
SELECT sp.series_id, sp.week_start, sp.y, 'test', round(h.forecast, 1)
FROM sp LEFT JOIN hold h ON h.series_id = sp.series_id AND h.week_start = sp.week_start WHERE sp.split = 'test'
"""

ORACLE = {
    "forecast_history": _HISTORY,
    "zone_forecast_display": f"""
SELECT 'Z' || CAST(cluster AS VARCHAR) AS zone, trim(regexp_replace(model, '\\s*\\([^)]*\\)\\s*$', '')) AS model,
       round(mean_weekly, 1) AS mean_wk, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 1) AS mape_pct
FROM ({_ZONE_METRICS}) m""",
    "zone_enriched_display": f"""
SELECT 'Z' || CAST(t.cluster AS VARCHAR) AS zone, format('{{:,.0f}}', CAST(total_population AS DOUBLE)) AS population,
       printf('%.1f', round(incidents_per_1k_res, 1)) AS inc_per_1k,
       format('{{:,.0f}}', round(mean_pop_density_sqkm, 0)) AS density,
       CASE WHEN wtd_median_income IS NULL THEN '-' ELSE '$' || format('{{:,.0f}}', wtd_median_income) END AS med_income,
       CASE WHEN elevation_mean_m IS NULL THEN '-' ELSE printf('%.0f', round(elevation_mean_m, 0)) || 'm' END AS elev
FROM ({_TWM}) t LEFT JOIN ({_ZTS}) e USING (cluster)""",
    "model_display": f"""
SELECT series_id, week_start, trim(regexp_replace(model, '\\s*\\([^)]*\\)\\s*$', '')) AS model,
       greatest(forecast, 0.0) AS forecast FROM ({_PROP}) p""",
    "zone_category_filter": f"""
SELECT object_id, cluster, category_short, lat, long FROM {_CLEAN} c
WHERE cluster IN ({", ".join(map(str, ZONES))}) AND category_short = '{CATEGORY}'""",
    "recent_weeks": f"""
SELECT series_id, week_start, y, rn <= 52 AS in_last_52 FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn FROM ({DENSE_SQL}) d) t
WHERE rn <= 13""",
}
