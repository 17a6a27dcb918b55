"""Exponential-smoothing forecasts, one job over all series.

Model (additive trend, optional damping phi, optional additive season m):
    forecast  f_t = l + phi*b (+ s_{t-m}),   error e = y - f_t
    level     l'  = alpha*(y - s_{t-m}) + (1 - alpha)*(l + phi*b)   = l + phi*b + alpha*e
    trend     b'  = beta*(l' - l) + (1 - beta)*phi*b                = phi*b + alpha*beta*e
    season    s_t = gamma*(y - l - phi*b) + (1 - gamma)*s_{t-m}     = s_{t-m} + gamma*e
(the error-correction form on the right is what is computed: fewer operations per step).

For fixed smoothing parameters every state is affine in the initial states, so their
least-squares values come out in closed form (``operators.smoothing``): no optimiser. A series is
one row (an array bounded by its number of weeks) and crosses one shuffle, which deals the
series over the tasks; all grid points of a series are then evaluated together, as vectors, in
the Arrow batch that holds it. The seasonal candidate's 54 initial states are all fitted, as the
other candidates' two are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from civicflow.functions.draws import draw
from civicflow.operators import smoothing
from civicflow.operators.smoothing import ADD, DAMPED, SEASON, SEASONAL  # noqa: F401

cloudpickle.register_pickle_by_value(smoothing)  # executors need not have this package

# Horizon, bootstrap size.
HORIZON = 13
N_BOOT = 500
BOOT_SEED = 42
PARAMS = ("alpha", "beta", "phi", "gamma")
FITTED = "model string, alpha double, beta double, phi double, gamma double, l0 double, b0 double, sse double, aic double, level double, trend double, season array<double>, season0 array<double>"


# ---------------------------------------------------------------------------
# Series -> one array row per series
# ---------------------------------------------------------------------------

def series_arrays(series: DataFrame, value: str = "y") -> DataFrame:
    """(series_id, week_start, y) -> (series_id, first_week, last_week, n, ys array ordered by week)."""
    agg = series.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("week_start", value))).alias("_pts")
    )
    return agg.select(
        "series_id",
        F.col("_pts")[0]["week_start"].alias("first_week"),
        F.element_at("_pts", -1)["week_start"].alias("last_week"),
        F.size("_pts").alias("n"),
        F.transform("_pts", lambda p: p[value]).alias("ys"),
    )


# ---------------------------------------------------------------------------
# Fits
# ---------------------------------------------------------------------------

def _fitted(rows: DataFrame, fits) -> DataFrame:
    """``rows`` with the columns of FITTED, a row for each fit that ``fits(row)`` gives."""
    schema = rows.select(*(c for c in rows.columns if c not in PARAMS + ("model", "wanted"))).schema
    kept = schema.names
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + FITTED
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = [{c: row[c] for c in kept} | {"season": None, "season0": None} | fit for fit in fits(row)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def fit_models(arrays: DataFrame, seasonal: bool = True, only: DataFrame | None = None) -> DataFrame:
    """per (series, candidate model) the minimum-SSE parameters on a coarse, then a finer
    grid; returns alpha, beta, phi, gamma, l0, b0, sse, aic, the end state and the initial seasons.
    ``only`` (series_id, model) restricts the search to given models (refit of a winner).

    Series are dealt over at least as many tasks as there are cores: their rows are small, so
    AQE would otherwise put them into one."""
    models = [ADD, DAMPED] + ([SEASONAL] if seasonal else [])
    if only is not None:
        wanted = only.groupBy("series_id").agg(F.collect_set("model").alias("wanted"))  # three at most
        arrays = arrays.join(wanted, "series_id")
    spark = arrays.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def fits(row):
        return smoothing.fit_series(np.array(row["ys"], dtype=np.float64), [m for m in models if m in row.get("wanted", models)])

    return _fitted(arrays.repartition(tasks, "series_id"), fits)


def _best(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """min_by over AIC (ties -> smaller alpha, beta, phi, gamma), one row per ``keys``."""
    order = F.struct("aic", *PARAMS)
    cols = [c for c in evaluated.columns if c not in keys]
    picked = evaluated.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_b"))
    return picked.select(*keys, "_b.*")


def select_model(fits: DataFrame) -> DataFrame:
    """the AIC winner per series."""
    return _best(fits, ["series_id"])


def forecast_path(model_rows: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """h = 1..horizon point forecasts l + (phi + ... + phi^h) b (+ season), week dates after the last."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    rows = model_rows.select("*", h)
    phi = F.col("phi")
    damp_sum = F.when(phi == 1.0, F.col("h").cast("double")).otherwise(
        phi * (1.0 - F.pow(phi, F.col("h"))) / (1.0 - phi)
    )
    seas = F.when(
        F.col("season").isNotNull(),
        F.element_at(F.col("season"), ((F.col("h") - 1) % F.size("season") + 1).cast("int")),
    ).otherwise(F.lit(0.0))
    return rows.select(
        "series_id",
        "model",
        "h",
        F.date_add(F.col("last_week"), F.col("h") * 7).alias("week_start"),
        (F.col("level") + damp_sum * F.col("trend") + seas).alias("forecast"),
    )


def fitted_residuals(model_rows: DataFrame) -> DataFrame:
    """Second pass for the chosen model only: one-step errors y - f along the series
    (used by the bootstrap), as an array per series (same recursion as the fit)."""
    phi, alpha, gamma = F.col("phi"), F.col("alpha"), F.col("gamma")
    ab = F.col("alpha") * F.col("beta")
    m = SEASON
    use_season = F.col("model") == SEASONAL
    init_season = F.when(use_season, F.col("season0")).otherwise(F.array_repeat(F.lit(0.0), m))
    init = F.struct(
        F.col("l0").alias("l"),
        F.col("b0").alias("b"),
        init_season.alias("s"),
        F.array().cast("array<double>").alias("res"),
    )

    def step(acc, y):
        s = F.when(use_season, acc["s"][0]).otherwise(F.lit(0.0))
        t = acc["l"] + phi * acc["b"]
        e = y - (t + s)
        return F.struct(
            (t + alpha * e).alias("l"),
            (phi * acc["b"] + ab * e).alias("b"),
            F.when(use_season, F.concat(F.slice(acc["s"], 2, m - 1), F.array(s + gamma * e))).otherwise(acc["s"]).alias("s"),
            F.concat(acc["res"], F.array(e)).alias("res"),
        )

    return model_rows.select(
        "series_id", "model", F.aggregate(F.col("ys"), init, step)["res"].alias("residuals")
    )


def bootstrap_intervals(
    forecasts: DataFrame, residuals: DataFrame, n_boot: int = N_BOOT, seed: int = BOOT_SEED, cumulative: bool = True
) -> DataFrame:
    """F6 + W8: residual bootstrap. Each (path, step) draws a residual by its own seeded draw;
    cumulative=True sums draws along each path (zone scheme), False sums step+1
    independent draws per step (city scheme). Percentiles 2.5/10/90/97.5, lower bounds floored at 0.
    Work is (series x paths x steps) rows, distributed by series and path."""
    base = forecasts.join(residuals, ["series_id", "model"])
    base = base.withColumn("_nres", F.size("residuals")).filter(F.col("_nres") > 0)
    paths = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("path"))

    def drawn(k: Column) -> Column:
        idx = draw(seed, F.col("series_id"), F.col("path"), k) % F.col("_nres") + 1
        return F.element_at(F.col("residuals"), idx.cast("int"))

    if cumulative:
        d = paths.withColumn("_draw", drawn(F.col("h")))
        w = Window.partitionBy("series_id", "path").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_noise", F.sum("_draw").over(w))
    else:
        sums = F.aggregate(
            F.sequence(F.lit(1), F.col("h")), F.lit(0.0), lambda acc, j: acc + drawn(F.col("h") * 1000 + j)
        )
        d = paths.withColumn("_noise", sums)
    d = d.withColumn("_sim", F.col("forecast") + F.col("_noise"))
    q = d.groupBy("series_id", "model", "h", "week_start", "forecast").agg(
        F.percentile("_sim", F.array(*[F.lit(x) for x in (0.025, 0.10, 0.90, 0.975)])).alias("_q")
    )
    return q.select(
        "series_id", "model", "h", "week_start",
        F.round("forecast", 1).alias("forecast"),
        F.greatest(F.round(F.col("_q")[1], 1), F.lit(0.0)).alias("lo_80"),
        F.round(F.col("_q")[2], 1).alias("hi_80"),
        F.greatest(F.round(F.col("_q")[0], 1), F.lit(0.0)).alias("lo_95"),
        F.round(F.col("_q")[3], 1).alias("hi_95"),
    )


def score_params(rows: DataFrame) -> DataFrame:
    """Evaluate given (series_id, n, ys, model, alpha, beta, phi, gamma) rows: least-squares initial
    states, SSE, AIC and end state (the same fits the grid search makes)."""
    def fits(row):
        return [smoothing.best_fit(np.array(row["ys"], dtype=np.float64), row["model"], [tuple(row[p] for p in PARAMS)])]

    return _fitted(rows, fits)
