"""Staffing workload index and dashboard KPIs.

Inputs are small by construction (zones x horizon weeks; one row per zone), so
the windows here partition by week or run over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZONE = "cluster"


def zone_weights(perf: DataFrame) -> DataFrame:
    """F10 weights: complexity = zone mean days / unweighted mean of zone means (decision Q4);
    backlog = share of closed requests over 30 days."""
    city = perf.agg(F.avg("mean_days").alias("_city_mean_days"))
    return perf.crossJoin(F.broadcast(city)).select(  # one-row benchmark
        ZONE,
        F.round(F.col("mean_days") / F.col("_city_mean_days"), 4).alias("complexity_weight"),
        F.round(F.col("pct_over_30d") / 100.0, 4).alias("backlog_rate"),
    )


def workload_index(forecasts: DataFrame, perf: DataFrame) -> DataFrame:
    """F10 + W5 + J4 + J15: forecast x complexity x (1 + backlog); zones without weights
    get 1.0 / 0.0; weekly share of the city total via a window over the week."""
    fc = forecasts.join(zone_weights(perf), ZONE, "left").na.fill({"complexity_weight": 1.0, "backlog_rate": 0.0})
    raw = F.round(F.col("forecast") * F.col("complexity_weight") * (1.0 + F.col("backlog_rate")), 3)
    fc = fc.withColumn("raw_workload", raw)
    fc = fc.withColumn("city_total", F.sum("raw_workload").over(Window.partitionBy("week_start")))
    return fc.withColumn("workload_share", F.round(F.col("raw_workload") / F.col("city_total"), 4))


def staffing_summary(index: DataFrame) -> DataFrame:
    """13-week total, weekly mean, mean workload share and recommended share (%). Shares have four
    decimals: they are summed as whole ten-thousandths, so the mean does not depend on the order."""
    share = F.sum(F.round(F.col("workload_share") * 10000.0)) / F.count("workload_share") / 10000.0
    s = index.groupBy(ZONE).agg(
        F.round(F.sum("forecast"), 1).alias("fc_13wk_total"),
        F.round(F.avg("forecast"), 1).alias("mean_weekly_fc"),
        F.round(share, 3).alias("mean_workload_share"),
        F.max("complexity_weight").alias("complexity_weight"),
        F.max("backlog_rate").alias("backlog_rate"),
        F.max("is_proportional").alias("is_proportional"),
    )
    return s.withColumn("recommended_fte_share", F.round(F.col("mean_workload_share") * 100.0, 1))


def fte_allocation(summary: DataFrame, total_fte: float) -> DataFrame:
    """staff per zone for a given head-count."""
    return summary.select(
        ZONE,
        "recommended_fte_share",
        F.round(F.col("recommended_fte_share") / 100.0 * F.lit(float(total_fte)), 1).alias("fte"),
    )


def workload_premium(summary: DataFrame) -> DataFrame:
    """Volume share of the forecast vs recommended workload share, and the premium."""
    vol = F.col("fc_13wk_total") / F.sum("fc_13wk_total").over(Window.partitionBy()) * 100.0
    out = summary.select(ZONE, "recommended_fte_share", "complexity_weight", "backlog_rate", vol.alias("_vol"))
    return out.select(
        ZONE,
        F.round("_vol", 2).alias("volume_share"),
        F.round(F.col("recommended_fte_share") - F.col("_vol"), 2).alias("workload_premium"),
        "recommended_fte_share",
        "complexity_weight",
        "backlog_rate",
    )


def arg_max(df: DataFrame, value: str, key: str = ZONE) -> DataFrame:
    """The key with the largest value (ties -> smallest key), as a one-row frame."""
    return df.agg(F.max_by(F.struct(F.col(key), F.col(value)), F.struct(F.col(value), -F.col(key))).alias("_m")).select(
        F.col("_m")[key].alias(f"{key}"), F.col("_m")[value].alias(value)
    )


def volume_weighted_mean(perf: DataFrame, value: str = "mean_days", weight: str = "n_total") -> DataFrame:
    """sum(value * weight) / sum(weight)."""
    return perf.agg(
        F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 1).alias(f"weighted_{value}")
    )


def horizon_kpis(forecast: DataFrame, history: DataFrame, horizon: int = 13) -> DataFrame:
    """Per series the horizon total and mean, and the change vs the mean of the last
    ``horizon`` actual weeks (percent)."""
    w = Window.partitionBy("series_id").orderBy(F.desc("week_start"))
    recent = (
        history.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= horizon)
        .groupBy("series_id")
        .agg(F.avg("y").alias("_hist_mean"))
    )
    fc = forecast.groupBy("series_id").agg(F.sum("forecast").alias("_tot"), F.avg("forecast").alias("_mean"))
    return fc.join(recent, "series_id").select(
        "series_id",
        F.round("_tot", 4).alias("fc_total"),
        F.round("_mean", 4).alias("fc_mean"),
        F.round((F.col("_mean") - F.col("_hist_mean")) / F.col("_hist_mean") * 100.0, 4).alias("pct_vs_prior"),
    )


def sparse_note(metrics: DataFrame) -> DataFrame:
    """one sentence naming the proportional zones and their shares."""
    prop = metrics.filter(F.col("is_proportional"))
    parts = F.sort_array(F.collect_list(F.struct(F.col(ZONE), F.col("prop_share"))))
    return prop.agg(parts.alias("_p")).select(
        F.when(
            F.size("_p") > 0,
            F.concat(
                F.lit("Proportional model used for zone(s) "),
                F.array_join(
                    F.transform("_p", lambda p: F.format_string(
                        "%s (%.1f%% of city)", p[ZONE].cast("string"), F.round(p["prop_share"] * 100.0, 1))),
                    ", ",
                ),
                F.lit(": too sparse for a stable Holt-Winters fit."),
            ),
        ).otherwise(F.lit("")).alias("note")
    )
