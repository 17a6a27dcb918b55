"""Registered staffing / KPI queries.

One variant takes a transparent zone forecast (seasonal naive: the same week one
year earlier), the ``*_holt`` variant runs the same operators on the
exponential-smoothing forecasts with bootstrap intervals. Both have SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.operators import forecast as FC
from civicflow.operators import profile, staffing
from civicflow.operators import series as S
from civicflow.plans import forecast as PF
from civicflow.plans.requests import _ZONE_PERF, cleaned
from civicflow.plans import forecast_sql as FS
from civicflow.plans.series import DENSE_SQL, SPLIT_SQL, dense

HEADCOUNT = 20  # default total field staff on the allocation page


def naive_zone_forecast(spark, sf_dir) -> DataFrame:
    """13 weeks after each zone's last week, valued at the same week a year earlier."""
    ser = dense(spark, sf_dir).filter(F.col("series_id") != S.CITY)
    last = ser.groupBy("series_id").agg(F.max("week_start").alias("last_week"))
    steps = last.select(
        "series_id", F.explode(F.sequence(F.lit(1), F.lit(FC.HORIZON))).alias("h"), "last_week"
    ).select("series_id", "h", F.date_add("last_week", F.col("h") * 7).alias("week_start"))
    past = ser.select("series_id", F.date_add("week_start", 364).alias("week_start"), F.col("y").alias("forecast"))
    return steps.join(past, ["series_id", "week_start"], "left").select(
        F.col("series_id").try_cast("int").alias("cluster"),
        "week_start",
        F.coalesce("forecast", F.lit(0.0)).alias("forecast"),
        F.lit("Seasonal naive").alias("model"),
        F.lit(False).alias("is_proportional"),
    )


def perf(spark, sf_dir) -> DataFrame:
    return profile.zone_performance(cleaned(spark, sf_dir))


def index_naive(spark, sf_dir, p: DataFrame | None = None) -> DataFrame:
    return staffing.workload_index(naive_zone_forecast(spark, sf_dir), p if p is not None else perf(spark, sf_dir))


def q_workload_index(spark, sf_dir):
    return index_naive(spark, sf_dir).select(
        "cluster", "week_start", "forecast", "complexity_weight", "backlog_rate", "raw_workload",
        F.round("city_total", 3).alias("city_total"), "workload_share",
    )


def q_staffing_summary(spark, sf_dir):
    return staffing.staffing_summary(index_naive(spark, sf_dir))


def q_fte_allocation(spark, sf_dir):
    return staffing.fte_allocation(staffing.staffing_summary(index_naive(spark, sf_dir)), HEADCOUNT)


def q_workload_premium(spark, sf_dir):
    return staffing.workload_premium(staffing.staffing_summary(index_naive(spark, sf_dir)))


def q_kpi_context(spark, sf_dir):
    """G16 + G17 + G23: one row of headline numbers."""
    p = perf(spark, sf_dir)
    summ = staffing.staffing_summary(index_naive(spark, sf_dir, p))
    prem = staffing.workload_premium(summ)
    base = p.agg(F.sum("n_total").cast("long").alias("n_clustered"), F.count_distinct("cluster").alias("n_clusters"))
    top = staffing.arg_max(p, "n_total").select(F.col("cluster").alias("top_cluster"))
    backlog = staffing.arg_max(p, "pct_over_30d").select(
        F.col("cluster").alias("high_backlog_cluster"), F.col("pct_over_30d").alias("high_backlog_pct")
    )
    wmean = staffing.volume_weighted_mean(p)
    top_wl = staffing.arg_max(summ, "recommended_fte_share").select(
        F.col("cluster").alias("top_workload_cluster"), F.col("recommended_fte_share").alias("top_workload_fte_share")
    )
    over = staffing.arg_max(prem, "workload_premium").select(F.col("cluster").alias("over_indexed_cluster"))
    out = base
    for part in (top, backlog, wmean, top_wl, over):  # every part is a one-row frame
        out = out.crossJoin(part)
    return out


def q_horizon_kpis(spark, sf_dir):
    fc = naive_zone_forecast(spark, sf_dir).select(F.col("cluster").cast("string").alias("series_id"), "week_start", "forecast")
    return staffing.horizon_kpis(fc, dense(spark, sf_dir))


# --- exponential-smoothing chain ----------------------------------------------

def _own_and_shared(spark, sf_dir, winners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified zones, refit models, point forecasts): a regular zone has its own model, a sparse
    one its share of the city forecast (F3, F5, F8)."""
    full = PF.refit_full(spark, sf_dir, winners)
    fc = FC.forecast_path(full)
    cls = S.classify_sparse(dense(spark, sf_dir))
    own = fc.join(cls.filter(~F.col("is_sparse")).select("series_id"), "series_id")
    city = fc.filter(F.col("series_id") == S.CITY).select("h", "week_start", F.col("model").alias("city_model"), F.col("forecast").alias("cf"))
    shared = cls.filter("is_sparse").select("series_id", "prop_share").crossJoin(F.broadcast(city)).select(  # city: a row a step
        "series_id", F.concat(F.lit("Proportional ("), F.col("city_model"), F.lit(")")).alias("model"),
        "h", "week_start", (F.col("cf") * F.col("prop_share")).alias("forecast"),
    )
    points = own.unionByName(shared).filter(F.col("series_id") != S.CITY)
    return cls, full, points


def zone_forecasts_holt(spark, sf_dir) -> DataFrame:
    """Zone forecasts with bootstrap intervals."""
    cls, full, points = _own_and_shared(spark, sf_dir, PF.winners_on_train(spark, sf_dir))
    res = FC.fitted_residuals(full)
    city_res = res.filter(F.col("series_id") == S.CITY).select("residuals")
    scaled = cls.filter("is_sparse").select("series_id", "prop_share").crossJoin(F.broadcast(city_res)).select(  # city_res: one row
        "series_id", F.transform("residuals", lambda r: r * F.col("prop_share")).alias("residuals"))
    regular = res.join(cls.filter(~F.col("is_sparse")).select("series_id"), "series_id").select("series_id", "residuals")
    residuals = regular.unionByName(scaled).join(points.select("series_id", "model").distinct(), "series_id")
    both = FC.bootstrap_intervals(points, residuals)
    return both.join(cls.select("series_id", "is_sparse"), "series_id").select(
        F.col("series_id").try_cast("int").alias("cluster"),
        "week_start",
        F.greatest(F.col("forecast"), F.lit(0.0)).alias("forecast"),
        "lo_80", "hi_80", "lo_95", "hi_95", "model",
        F.col("is_sparse").alias("is_proportional"),
    )


def q_zone_forecast_weekly(spark, sf_dir):
    return zone_forecasts_holt(spark, sf_dir)


def q_staffing_holt(spark, sf_dir):
    idx = staffing.workload_index(zone_forecasts_holt(spark, sf_dir), perf(spark, sf_dir))
    return staffing.staffing_summary(idx)


def q_zone_forecast_metrics(spark, sf_dir):
    """per zone model, shares, train length, mean, zero-week %, hold-out errors
    (positive-week MAPE), 13-week total."""
    ser = dense(spark, sf_dir)
    winners = PF.winners_on_train(spark, sf_dir)
    cls, _, points = _own_and_shared(spark, sf_dir, winners)
    hold = PF.holdout(spark, sf_dir, winners)
    city_pred = hold.filter(F.col("series_id") == S.CITY).select("week_start", F.col("forecast").alias("cf"))
    zones_test = S.split_train_test(ser).filter((F.col("split") == "test") & (F.col("series_id") != S.CITY))
    zones_test = zones_test.join(cls.select("series_id", "is_sparse", "prop_share"), "series_id")
    own = hold.select("series_id", "week_start", F.col("forecast").alias("own"))
    pred = zones_test.join(own, ["series_id", "week_start"], "left").join(F.broadcast(city_pred), "week_start", "left")
    pred = pred.withColumn("pred", F.when(F.col("is_sparse"), F.col("cf") * F.col("prop_share")).otherwise(F.col("own")))
    err = S.error_metrics(pred, "series_id", "y", "pred")
    train_n = S.split_train_test(ser).filter(F.col("split") == "train").groupBy("series_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_train_weeks"), 
    )
    rounded = F.greatest(F.round("forecast", 1), F.lit(0.0))
    fc = points.groupBy(F.col("series_id").try_cast("int").alias("cluster")).agg(
        F.round(F.sum(rounded), 1).alias("fc_13wk_total"), F.first("model").alias("model")
    )
    out = cls.join(err, "series_id").join(train_n, "series_id").withColumn("cluster", F.col("series_id").try_cast("int"))
    return out.join(fc, "cluster").select(
        "cluster", "model", F.col("is_sparse").alias("is_proportional"),
        F.when(F.col("is_sparse"), F.col("prop_share")).alias("prop_share"),
        "n_train_weeks", F.col("mean_vol").alias("mean_weekly"), F.round(F.col("zero_pct") * 100.0, 1).alias("zero_week_pct"),
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape_positive", 1).alias("mape"),
        "fc_13wk_total",
    )


def q_sparse_note(spark, sf_dir):
    return staffing.sparse_note(q_zone_forecast_metrics(spark, sf_dir))


QUERIES = {
    "workload_index": q_workload_index,
    "staffing_summary": q_staffing_summary,
    "fte_allocation": q_fte_allocation,
    "workload_premium": q_workload_premium,
    "kpi_context": q_kpi_context,
    "horizon_kpis": q_horizon_kpis,
    "zone_forecast_weekly": q_zone_forecast_weekly,
    "staffing_holt": q_staffing_holt,
    "zone_forecast_metrics": q_zone_forecast_metrics,
    "sparse_note": q_sparse_note,
}

_ZONE_METRICS = f"""
WITH d AS ({DENSE_SQL}),
ct AS (SELECT sum(y) AS city_total FROM d WHERE series_id = 'city'),
z AS (SELECT series_id, avg(y) AS m, avg(CAST(y = 0 AS DOUBLE)) AS zp, sum(y) AS s FROM d
      WHERE series_id <> 'city' GROUP BY series_id),
cls AS (SELECT series_id, round(m, 2) AS mean_vol, round(zp, 4) AS zero_pct, (m < 8 OR zp > 0.2) AS is_sparse,
               round(CASE WHEN city_total > 0 THEN s / city_total ELSE 0.0 END, 4) AS prop_share FROM z CROSS JOIN ct),
hold AS (SELECT series_id, week_start, forecast FROM ({FS.forecast_sql(PF._WIN_TRAIN)}) h),
cp AS (SELECT week_start, forecast AS cf FROM hold WHERE series_id = 'city'),
tst AS (SELECT series_id, week_start, y FROM ({SPLIT_SQL}) sp WHERE split = 'test' AND series_id <> 'city'),
pred AS (SELECT t.series_id, t.y, CASE WHEN c.is_sparse THEN cp.cf * c.prop_share ELSE h.forecast END AS p
         FROM tst t JOIN cls c USING (series_id) LEFT JOIN hold h USING (series_id, week_start)
         LEFT JOIN cp USING (week_start)),
err AS (SELECT series_id, round(round(avg(abs(y - p)), 4), 2) AS mae,
               round(round(sqrt(avg((y - p) * (y - p))), 4), 2) AS rmse,
               round(round(avg(CASE WHEN y > 0 THEN abs(y - p) / y END) * 100.0, 4), 1) AS mape
        FROM pred GROUP BY series_id),
trn AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n_train_weeks FROM ({SPLIT_SQL}) sp
        WHERE split = 'train' GROUP BY series_id),
fullfc AS (SELECT * FROM ({PF._FULL_FC}) f),
own AS (SELECT f.series_id, f.model, greatest(round(f.forecast, 1), 0.0) AS fc FROM fullfc f
        JOIN cls c USING (series_id) WHERE NOT c.is_sparse),
prop AS (SELECT c.series_id, 'Proportional (' || f.model || ')' AS model,
                greatest(round(f.forecast * c.prop_share, 1), 0.0) AS fc
         FROM cls c CROSS JOIN fullfc f WHERE c.is_sparse AND f.series_id = 'city'),
fct AS (SELECT series_id, any_value(model) AS model, round(sum(fc), 1) AS fc_13wk_total
        FROM (SELECT * FROM own UNION ALL SELECT * FROM prop) u GROUP BY series_id)
SELECT CAST(c.series_id AS INTEGER) AS cluster, fct.model, c.is_sparse AS is_proportional,
       CASE WHEN c.is_sparse THEN c.prop_share END AS prop_share, trn.n_train_weeks,
       c.mean_vol AS mean_weekly, round(c.zero_pct * 100.0, 1) AS zero_week_pct, err.mae, err.rmse, err.mape,
       fct.fc_13wk_total
FROM cls c JOIN err USING (series_id) JOIN trn USING (series_id) JOIN fct USING (series_id)
"""

_NAIVE = f"""
WITH d AS ({DENSE_SQL}),
z AS (SELECT * FROM d WHERE series_id <> 'city'),
last AS (SELECT series_id, max(week_start) AS last_week FROM z GROUP BY series_id),
steps AS (SELECT series_id, h, CAST(last_week + INTERVAL (h * 7) DAY AS DATE) AS week_start
          FROM last, range(1, 14) t(h)),
past AS (SELECT series_id, CAST(week_start + INTERVAL 364 DAY AS DATE) AS week_start, y FROM z)
SELECT CAST(s.series_id AS INTEGER) AS cluster, s.week_start, coalesce(p.y, 0.0) AS forecast,
       'Seasonal naive' AS model, false AS is_proportional
FROM steps s LEFT JOIN past p ON p.series_id = s.series_id AND p.week_start = s.week_start
"""

_WEIGHTS = f"""
SELECT cluster, round(mean_days / cm, 4) AS complexity_weight, round(pct_over_30d / 100.0, 4) AS backlog_rate,
       n_total, pct_over_30d, mean_days
FROM ({_ZONE_PERF}) p CROSS JOIN (SELECT avg(mean_days) AS cm FROM ({_ZONE_PERF}) q) c
"""



def _index_sql(forecast: str) -> str:
    return f"""
SELECT *, round(raw_workload / city_total, 4) AS workload_share FROM (
  SELECT *, sum(raw_workload) OVER (PARTITION BY week_start) AS city_total FROM (
    SELECT f.*, coalesce(w.complexity_weight, 1.0) AS complexity_weight, coalesce(w.backlog_rate, 0.0) AS backlog_rate,
           round(f.forecast * coalesce(w.complexity_weight, 1.0) * (1.0 + coalesce(w.backlog_rate, 0.0)), 3) AS raw_workload
    FROM ({forecast}) f LEFT JOIN ({_WEIGHTS}) w USING (cluster)) a) b
"""


def _summary_sql(index: str) -> str:
    share = "round(sum(round(workload_share * 10000.0)) / count(workload_share) / 10000.0, 3)"
    return f"""
SELECT cluster, round(sum(forecast), 1) AS fc_13wk_total, round(avg(forecast), 1) AS mean_weekly_fc,
       {share} AS mean_workload_share, max(complexity_weight) AS complexity_weight,
       max(backlog_rate) AS backlog_rate, bool_or(is_proportional) AS is_proportional,
       round({share} * 100.0, 1) AS recommended_fte_share
FROM ({index}) i GROUP BY cluster
"""


_INDEX = _index_sql(_NAIVE)
_SUMMARY = _summary_sql(_INDEX)

_CLASSES = f"""
WITH d AS ({DENSE_SQL}),
ct AS (SELECT sum(y) AS city_total FROM d WHERE series_id = 'city'),
z AS (SELECT series_id, avg(y) AS m, avg(CAST(y = 0 AS DOUBLE)) AS zp, sum(y) AS s FROM d
      WHERE series_id <> 'city' GROUP BY series_id)
SELECT series_id, (m < 8 OR zp > 0.2) AS is_sparse,
       round(CASE WHEN city_total > 0 THEN s / city_total ELSE 0.0 END, 4) AS prop_share FROM z CROSS JOIN ct"""
_RESIDUALS = FS.residuals_sql(PF._REFIT)
_ZONE_POINTS = f"""
SELECT f.series_id, f.model, f.h, f.week_start, f.forecast FROM ({PF._FULL_FC}) f JOIN ({_CLASSES}) c USING (series_id) WHERE NOT is_sparse
UNION ALL
SELECT c.series_id, 'Proportional (' || f.model || ')', f.h, f.week_start, f.forecast * c.prop_share
FROM ({_CLASSES}) c CROSS JOIN ({PF._FULL_FC}) f WHERE c.is_sparse AND f.series_id = 'city'"""
_ZONE_RESIDUALS = f"""
SELECT r.series_id, r.model, r.residuals FROM ({_RESIDUALS}) r JOIN ({_CLASSES}) c USING (series_id) WHERE NOT is_sparse
UNION ALL
SELECT c.series_id, 'Proportional (' || r.model || ')', list_transform(r.residuals, lambda x: x * c.prop_share)
FROM ({_CLASSES}) c CROSS JOIN ({_RESIDUALS}) r WHERE c.is_sparse AND r.series_id = 'city'"""
_ZONE_WEEKLY = f"""
SELECT CAST(series_id AS INTEGER) AS cluster, week_start, greatest(forecast, 0.0) AS forecast, lo_80, hi_80, lo_95, hi_95, model,
       is_sparse AS is_proportional
FROM ({FS.bootstrap_sql(_ZONE_POINTS, _ZONE_RESIDUALS)}) b JOIN ({_CLASSES}) c USING (series_id)"""

_PREMIUM = f"""
SELECT cluster, round(v, 2) AS volume_share, round(recommended_fte_share - v, 2) AS workload_premium,
       recommended_fte_share, complexity_weight, backlog_rate
FROM (SELECT *, fc_13wk_total / sum(fc_13wk_total) OVER () * 100.0 AS v FROM ({_SUMMARY}) s) t
"""


def _argmax(src: str, value: str, alias_key: str, alias_val: str | None = None) -> str:
    val = f", {value} AS {alias_val}" if alias_val else ""
    return f"(SELECT cluster AS {alias_key}{val} FROM ({src}) x ORDER BY {value} DESC, cluster ASC LIMIT 1)"


ORACLE = {
    "zone_forecast_metrics": _ZONE_METRICS,
    "sparse_note": f"""
SELECT CASE WHEN count(*) > 0 THEN 'Proportional model used for zone(s) '
         || string_agg(printf('%s (%.1f%% of city)', CAST(cluster AS VARCHAR), round(prop_share * 100.0, 1)), ', ' ORDER BY cluster)
         || ': too sparse for a stable Holt-Winters fit.' ELSE '' END AS note
FROM ({_ZONE_METRICS}) m WHERE is_proportional""",
    "workload_index": f"""
SELECT cluster, week_start, forecast, complexity_weight, backlog_rate, raw_workload, round(city_total, 3) AS city_total,
       workload_share FROM ({_INDEX}) i""",
    "staffing_summary": _SUMMARY,
    "zone_forecast_weekly": _ZONE_WEEKLY,
    "staffing_holt": _summary_sql(_index_sql(_ZONE_WEEKLY)),
    "fte_allocation": f"""
SELECT cluster, recommended_fte_share, round(recommended_fte_share / 100.0 * {float(HEADCOUNT)}, 1) AS fte
FROM ({_SUMMARY}) s""",
    "workload_premium": _PREMIUM,
    "kpi_context": f"""
SELECT b.*, t.*, h.*, w.*, tw.*, o.* FROM
 (SELECT CAST(sum(n_total) AS BIGINT) AS n_clustered, CAST(count(DISTINCT cluster) AS BIGINT) AS n_clusters
  FROM ({_ZONE_PERF}) p) b,
 {_argmax(_ZONE_PERF, 'n_total', 'top_cluster')} t,
 {_argmax(_ZONE_PERF, 'pct_over_30d', 'high_backlog_cluster', 'high_backlog_pct')} h,
 (SELECT round(sum(mean_days * n_total) / sum(n_total), 1) AS weighted_mean_days FROM ({_ZONE_PERF}) p) w,
 {_argmax(_SUMMARY, 'recommended_fte_share', 'top_workload_cluster', 'top_workload_fte_share')} tw,
 {_argmax(_PREMIUM, 'workload_premium', 'over_indexed_cluster')} o""",
    "horizon_kpis": f"""
WITH fc AS (SELECT CAST(cluster AS VARCHAR) AS series_id, week_start, forecast FROM ({_NAIVE}) n),
hist AS (SELECT series_id, avg(y) AS hm FROM (
           SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week_start DESC) AS rn FROM ({DENSE_SQL}) d) t
         WHERE rn <= 13 GROUP BY series_id)
SELECT series_id, round(sum(forecast), 4) AS fc_total, round(avg(forecast), 4) AS fc_mean,
       round((avg(forecast) - any_value(hm)) / any_value(hm) * 100.0, 4) AS pct_vs_prior
FROM fc JOIN hist USING (series_id) GROUP BY series_id""",
}
