"""Seasonal smoothing against a fit written step by step, and against its SQL twin."""

import datetime

import duckdb
import numpy as np
import pytest

from civicflow.operators import forecast as FC
from civicflow.operators import smoothing
from civicflow.plans import forecast_sql as FS

M = smoothing.SEASON
FIRST = datetime.date(2020, 1, 6)


def errors(y, alpha, beta, gamma, x):
    """One-step errors from initial states (level, trend, seasons), by the component form of the model."""
    level, trend, season, out = x[0], x[1], list(x[2:]), []
    for t, v in enumerate(y):
        s = season[t % M]
        out.append(v - (level + trend + s))
        before, level = level, alpha * (v - s) + (1 - alpha) * (level + trend)
        season[t % M] = gamma * (v - before - trend) + (1 - gamma) * s
        trend = beta * (level - before) + (1 - beta) * trend
    return np.array(out)


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    noise = rng.normal(0, 2, n)
    if kind == "seasonal":
        return 60 + 0.02 * t + rng.normal(0, 12, M)[t % M] + noise
    if kind == "trend":
        return 30 + 0.3 * t + noise
    return 40 + np.cumsum(rng.normal(0, 1.5, n)) + noise


def arrays(spark, rows):
    data = [(name, FIRST, FIRST + datetime.timedelta(weeks=len(y) - 1), len(y), [float(v) for v in y]) for name, y in rows]
    return spark.createDataFrame(data, "series_id string, first_week date, last_week date, n int, ys array<double>")


@pytest.mark.parametrize("params", [(0.3, 0.05, 0.2), (0.7, 0.0, 0.0), (0.05, 0.05, 0.9)])
def test_initial_states_are_least_squares(params):
    y = series("seasonal", 130, 1)
    fit = {k: v[0] for k, v in smoothing.seasonal_fits(y, *(np.array([p]) for p in params), M).items()}
    zero = errors(y, *params, np.zeros(M + 2))
    design = np.column_stack([zero - errors(y, *params, unit) for unit in np.eye(M + 2)])
    best = np.linalg.lstsq(design, zero, rcond=1e-10)[0]  # a level can move into all seasons
    assert fit["sse"] == pytest.approx((errors(y, *params, best) ** 2).sum(), rel=1e-7)
    own = np.concatenate([[fit["l0"], fit["b0"]], fit["season0"]])
    assert (errors(y, *params, own) ** 2).sum() == pytest.approx(fit["sse"], rel=1e-9)
    assert fit["season0"].sum() == pytest.approx(0, abs=1e-9)


def test_seasonal_series_is_won_by_the_seasonal_model(spark):
    rows = [("seasonal", series("seasonal", 208, 2)), ("trend", series("trend", 208, 3)), ("walk", series("walk", 208, 4)), ("short", series("seasonal", 80, 5))]
    fits = FC.fit_models(arrays(spark, rows)).checkpoint()
    winner = {r["series_id"]: r["model"] for r in FC.select_model(fits).collect()}
    assert winner["seasonal"] == FC.SEASONAL
    assert FC.SEASONAL not in (winner["trend"], winner["walk"], winner["short"])
    assert {r["series_id"]: r["count"] for r in fits.groupBy("series_id").count().collect()} == {"seasonal": 3, "trend": 3, "walk": 3, "short": 2}

    # the seasonal branch of the forecast: the next weeks of the pattern, within the noise
    truth = series("seasonal", 208 + 13, 2)
    rng = np.random.default_rng(2)
    rng.normal(0, 2, 208)
    pattern = rng.normal(0, 12, M)
    t = np.arange(208, 221)
    expected = 60 + 0.02 * t + pattern[t % M]
    path = {r["h"]: r["forecast"] for r in FC.forecast_path(FC.select_model(fits).where("series_id = 'seasonal'")).collect()}
    assert np.abs(np.array([path[h] for h in range(1, 14)]) - expected).mean() < 2.5 and len(truth) == 221

    # residuals start from the fitted seasons
    best = FC.select_model(fits).where("series_id = 'seasonal'")
    row, residuals = best.collect()[0], FC.fitted_residuals(best).collect()[0]["residuals"]
    assert (np.array(residuals) ** 2).sum() == pytest.approx(row["sse"], rel=1e-9)


def test_only_the_named_models_are_fitted(spark):
    rows = arrays(spark, [("a", series("seasonal", 120, 6)), ("b", series("trend", 120, 7)), ("c", series("walk", 120, 8))])
    only = spark.createDataFrame([("a", FC.SEASONAL), ("b", FC.DAMPED), ("b", FC.ADD)], "series_id string, model string")
    fits = FC.fit_models(rows, only=only)
    assert sorted((r["series_id"], r["model"]) for r in fits.collect()) == [("a", FC.SEASONAL), ("b", FC.ADD), ("b", FC.DAMPED)]


def test_an_array_is_shuffled_once(spark):
    rows = arrays(spark, [("a", series("walk", 120, 8))])
    plan = FC.fit_models(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1


def test_equals_sql(spark):
    rows = [("seasonal", series("seasonal", 150, 9)), ("walk", series("walk", 130, 10)), ("short", series("trend", 60, 11))]
    frame = arrays(spark, rows)
    names = ["series_id", "model", "n", "alpha", "beta", "phi", "gamma", "sse", "aic", "l0", "b0", "level", "trend", "season", "season0"]
    found = sorted(map(tuple, FC.fit_models(frame).select(*names).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE arrays (series_id VARCHAR, first_week DATE, last_week DATE, n INTEGER, ys DOUBLE[])")
    con.executemany("INSERT INTO arrays VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in frame.collect()])
    twin = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({FS.fit_sql('arrays')}) f").fetchall())
    assert [r[:3] for r in found] == [r[:3] for r in twin]
    for a, b in zip(found, twin):
        for x, y in zip(a[3:], b[3:]):
            assert (x is None) == (y is None)
            if x is not None:
                np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-6)
