"""Registered forecasting queries: grid fit, AIC selection, hold-out evaluation,
refit + horizon forecast, bootstrap intervals, proportional zones, zone metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.operators import forecast as FC
from civicflow.operators import series as S
from civicflow.plans import forecast_sql as FS
from civicflow.plans.series import DENSE_SQL, NATION_DENSE_SQL, SPLIT_SQL, dense

_PARAMS = ("alpha", "beta", "phi", "gamma")
_STATS = ("sse", "aic", "l0", "b0", "level", "trend")


def _arrays(series: DataFrame, train_only: bool) -> DataFrame:
    if train_only:
        series = S.split_train_test(series).filter(F.col("split") == "train").drop("split")
    return FC.series_arrays(series)


def fits_on_train(spark, sf_dir) -> DataFrame:
    """F1 on all but the last 13 weeks; checkpointed (shared checkpoint dir) because the
    selection, evaluation and refit all read it."""
    return FC.fit_models(_arrays(dense(spark, sf_dir), True)).checkpoint()


def winners_on_train(spark, sf_dir) -> DataFrame:
    return FC.select_model(fits_on_train(spark, sf_dir))


def refit_full(spark, sf_dir, winners: DataFrame) -> DataFrame:
    """the winning configuration refit on the full series (decision Q3)."""
    only = winners.select("series_id", "model")
    return FC.fit_models(_arrays(dense(spark, sf_dir), False), only=only).checkpoint()


def _rounded(df: DataFrame, cols) -> list:
    return [F.round(c, 4).alias(c) for c in cols]


def q_holt_grid_fit(spark, sf_dir):
    fits = fits_on_train(spark, sf_dir)
    return fits.select("series_id", "model", F.col("n").cast("int").alias("n"), *_rounded(fits, _PARAMS + _STATS))


def q_aic_select(spark, sf_dir):
    best = winners_on_train(spark, sf_dir)
    return best.select("series_id", "model", *_rounded(best, _PARAMS + ("aic",)))


def holdout(spark, sf_dir, winners: DataFrame | None = None) -> DataFrame:
    """winner's 13-week forecast from the end of the training part vs the test weeks."""
    pred = FC.forecast_path(winners if winners is not None else winners_on_train(spark, sf_dir))
    test = S.split_train_test(dense(spark, sf_dir)).filter(F.col("split") == "test")
    return pred.join(test.select("series_id", "week_start", "y"), ["series_id", "week_start"])


def q_holdout_evaluation(spark, sf_dir):
    return S.error_metrics(holdout(spark, sf_dir), "series_id", "y", "forecast")


def q_horizon_forecast(spark, sf_dir):
    full = refit_full(spark, sf_dir, winners_on_train(spark, sf_dir))
    fc = FC.forecast_path(full)
    return fc.select("series_id", "model", "h", "week_start", F.round("forecast", 4).alias("forecast"))


def q_bootstrap_ci(spark, sf_dir):
    full = refit_full(spark, sf_dir, winners_on_train(spark, sf_dir))
    return FC.bootstrap_intervals(FC.forecast_path(full), FC.fitted_residuals(full))


def q_bootstrap_ci_independent(spark, sf_dir):
    full = refit_full(spark, sf_dir, winners_on_train(spark, sf_dir))
    return FC.bootstrap_intervals(FC.forecast_path(full), FC.fitted_residuals(full), cumulative=False)


def proportional(spark, sf_dir, full_forecast: DataFrame) -> DataFrame:
    """F8: sparse zones take their share of the city forecast."""
    cls = S.classify_sparse(dense(spark, sf_dir, "nation_zone")).filter("is_sparse")
    city = full_forecast.filter(F.col("series_id") == S.CITY).select(
        "h", "week_start", F.col("model").alias("city_model"), F.col("forecast").alias("city_forecast")
    )
    # cls: one row per sparse zone; city: one row per horizon step.
    return cls.crossJoin(F.broadcast(city)).select(
        "series_id",
        "h",
        "week_start",
        F.concat(F.lit("Proportional ("), F.col("city_model"), F.lit(")")).alias("model"),
        "prop_share",
        F.round(F.col("city_forecast") * F.col("prop_share"), 4).alias("forecast"),
    )


def q_proportional_forecast(spark, sf_dir):
    full = refit_full(spark, sf_dir, winners_on_train(spark, sf_dir))
    return proportional(spark, sf_dir, FC.forecast_path(full))


QUERIES = {
    "holt_grid_fit": q_holt_grid_fit,
    "aic_select": q_aic_select,
    "holdout_evaluation": q_holdout_evaluation,
    "horizon_forecast": q_horizon_forecast,
    "bootstrap_ci": q_bootstrap_ci,
    "bootstrap_ci_independent": q_bootstrap_ci_independent,
    "proportional_forecast": q_proportional_forecast,
}

# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

_ARR_TRAIN = f"""(SELECT series_id, min(week_start) AS first_week, max(week_start) AS last_week,
       CAST(count(*) AS INTEGER) AS n, list(y ORDER BY week_start) AS ys
FROM ({SPLIT_SQL}) sp WHERE split = 'train' GROUP BY series_id)"""
_ARR_FULL = f"""(SELECT series_id, min(week_start) AS first_week, max(week_start) AS last_week,
       CAST(count(*) AS INTEGER) AS n, list(y ORDER BY week_start) AS ys
FROM ({DENSE_SQL}) dd GROUP BY series_id)"""
_FITS_TRAIN = FS.fit_sql(_ARR_TRAIN)
_WIN_TRAIN = FS.select_sql(_FITS_TRAIN)
_REFIT = FS.fit_sql(_ARR_FULL, only=_WIN_TRAIN)
_FULL_FC = FS.forecast_sql(_REFIT)


def _r(cols):
    # "+ 0.0" turns DuckDB's -0.0 (a tiny negative rounded) into 0.0, as Spark's round does.
    return ", ".join(f"round({c}, 4) + CAST(0.0 AS DOUBLE) AS {c}" for c in cols)


ORACLE = {
    "holt_grid_fit": f"SELECT series_id, model, n, {_r(_PARAMS + _STATS)} FROM ({_FITS_TRAIN}) f",
    "aic_select": f"SELECT series_id, model, {_r(_PARAMS + ('aic',))} FROM ({_WIN_TRAIN}) w",
    "holdout_evaluation": f"""
SELECT series_id, CAST(count(*) AS BIGINT) AS n_test,
       round(avg(abs(y - forecast)), 4) AS mae, round(sqrt(avg((y - forecast) * (y - forecast))), 4) AS rmse,
       round(avg(abs(y - forecast) / greatest(y, 1.0)) * 100.0, 4) AS mape_clip,
       round(avg(CASE WHEN y > 0 THEN abs(y - forecast) / y END) * 100.0, 4) AS mape_positive
FROM ({FS.forecast_sql(_WIN_TRAIN)}) p JOIN ({SPLIT_SQL}) t USING (series_id, week_start)
WHERE t.split = 'test' GROUP BY series_id""",
    "horizon_forecast": f"SELECT series_id, model, h, week_start, {_r(['forecast'])} FROM ({_FULL_FC}) f",
    "proportional_forecast": f"""
WITH d AS ({NATION_DENSE_SQL}),
ct AS (SELECT sum(y) AS city_total FROM d WHERE series_id = 'city'),
z AS (SELECT series_id, avg(y) AS m, avg(CAST(y = 0 AS DOUBLE)) AS zp, sum(y) AS s FROM d
      WHERE series_id <> 'city' GROUP BY series_id),
cls AS (SELECT series_id, round(CASE WHEN city_total > 0 THEN s / city_total ELSE 0.0 END, 4) AS prop_share
        FROM z CROSS JOIN ct WHERE m < 8 OR zp > 0.2),
city AS (SELECT h, week_start, model AS city_model, forecast AS city_forecast FROM ({_FULL_FC}) f
         WHERE series_id = 'city')
SELECT series_id, h, week_start, 'Proportional (' || city_model || ')' AS model, prop_share,
       round(city_forecast * prop_share, 4) AS forecast
FROM cls CROSS JOIN city""",
    "bootstrap_ci": FS.bootstrap_sql(_FULL_FC, FS.residuals_sql(_REFIT)),
    "bootstrap_ci_independent": FS.bootstrap_sql(_FULL_FC, FS.residuals_sql(_REFIT), cumulative=False),
}
