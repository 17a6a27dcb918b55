"""Driver contract: entry() smoke, registry consistency, and the oracle on small data."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from civicflow.sources.tables import TABLES
from tests.conftest import SF_SMALL

# Quick oracle-checked queries (the full set runs in tools/check_oracle.py).
QUICK = ["zone_performance", "category_gap", "daily_station_agg", "weekly_series_dense", "sparse_classification",
         "workload_index", "tfidf_terms", "classification_report", "point_in_polygon", "raster_sample",
         "nearest_station", "feature_pages", "split_counts", "stream_weekly_counts"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "response_tier" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", QUICK)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rel.fetchall())
    assert got == exp
