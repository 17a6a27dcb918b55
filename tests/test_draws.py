"""Draws: the same in both engines, evenly spread, independent of partitions."""

import duckdb
from pyspark.sql import functions as F

from civicflow.functions.draws import SPAN, draw, draw_sql
from civicflow.operators import evaluation as EV


def test_engines_agree(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"))
    found = sorted((r["id"], r["d"]) for r in rows.select("id", draw(9, F.col("id"), F.col("s")).alias("d")).collect())
    twin = duckdb.sql(f"SELECT id, {draw_sql(9, 'id', 's')} FROM (SELECT range AS id, CAST(range % 7 AS VARCHAR) AS s FROM range(500)) t").fetchall()
    assert found == sorted(twin)
    assert len({d for _, d in found}) == 500 and all(0 <= d < SPAN for _, d in found)
    share = sum(d < SPAN // 4 for _, d in found) / 500
    assert 0.18 < share < 0.32
    again = sorted((r["id"], r["d"]) for r in rows.repartition(5).select("id", draw(9, F.col("id"), F.col("s")).alias("d")).collect())
    assert again == found


def test_split_follows_the_draw(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"))
    split = EV.stratified_split(df, "label", "k").collect()
    draws = {r["k"]: r["d"] for r in df.select("k", draw(42, F.col("k")).alias("d")).collect()}
    for label in range(3):
        order = sorted((r for r in split if r["label"] == label), key=lambda r: draws[r["k"]])
        assert [r["split"] for r in order] == ["test"] * 20 + ["train"] * 80
    sample = [r["k"] for r in EV.seeded_sample(df, "k", 10).collect()]
    assert sorted(sample) == sorted(sorted(draws, key=draws.get)[:10])
