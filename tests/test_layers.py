"""Layers with one feature per line, collections, and CSV that several tasks read."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicflow.sources import files as S

PROPS = T.StructType([T.StructField("GEOID", T.StringType())])
RINGS = "array<array<struct<x:double,y:double>>>"


def square(x, side=1.0):
    return [[(x, 0.0), (x + side, 0.0), (x + side, side), (x, side), (x, 0.0)]]


def points(rings):
    return [[(p["x"], p["y"]) for p in ring] for ring in rings]


def test_polygons_and_multipolygons_by_line(spark, tmp_path):
    hole = square(0.0, 4.0) + square(1.0)
    polys = spark.createDataFrame([("a", square(0.0)), ("b", hole), (None, square(9.0))], f"GEOID string, rings {RINGS}")
    S.write_feature_lines(polys, ["GEOID"], str(tmp_path / "p"))
    got = {r["GEOID"]: (r["part"], points(r["rings"])) for r in S.read_feature_lines(spark, str(tmp_path / "p"), PROPS).collect()}
    assert got == {"a": (0, square(0.0)), "b": (0, hole), None: (0, square(9.0))}

    multi = spark.createDataFrame([("m", [square(0.0), hole])], f"GEOID string, parts array<{RINGS}>")
    S.write_feature_lines(multi, ["GEOID"], str(tmp_path / "m"), "parts")
    got = {r["part"]: points(r["rings"]) for r in S.read_feature_lines(spark, str(tmp_path / "m"), PROPS).collect()}
    assert got == {0: square(0.0), 1: hole}


def test_a_collection_reads_as_its_lines(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"GEOID": "m"},
               "geometry": {"type": "MultiPolygon", "coordinates": [square(0.0), square(5.0)]}}
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    (tmp_path / "l.json").write_text(json.dumps(feature))
    whole = S.read_geojson(spark, str(tmp_path / "c.json"), PROPS).collect()
    assert len(whole) == 2 and whole == S.read_feature_lines(spark, str(tmp_path / "l.json"), PROPS).collect()


def test_roads_by_line(spark, tmp_path):
    road = [(0.0, 0.0), (1.0, 2.0)]
    roads = spark.createDataFrame([("r", road)], "GEOID string, path array<struct<x:double,y:double>>")
    S.write_feature_lines(roads, ["GEOID"], str(tmp_path / "r"), "path")
    got = S.read_feature_lines_of_roads(spark, str(tmp_path / "r"), PROPS).collect()
    assert [(r["GEOID"], r["part"], [tuple(p) for p in r["path"]]) for r in got] == [("r", 0, road)]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    polys = spark.range(3000).select(
        F.col("id").cast("string").alias("GEOID"),
        F.array(F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y")))).alias("rings"),
    ).coalesce(1)
    S.write_feature_lines(polys, ["GEOID"], str(tmp_path / "p"))
    polys.select("GEOID").write.option("header", True).csv(str(tmp_path / "c"))
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for df in (S.read_feature_lines(spark, str(tmp_path / "p"), PROPS), S.read_csv(spark, str(tmp_path / "c"), PROPS)):
            assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
            assert df.select("GEOID").distinct().count() == df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_csv_with_line_breaks_is_opt_in(spark, tmp_path):
    df = spark.createDataFrame([("one\ntwo \"quoted\"",)], "GEOID string")
    S.write_csv_and_parquet(df, str(tmp_path / "c"), str(tmp_path / "p"))
    assert S.read_csv(spark, str(tmp_path / "c"), PROPS, multi_line=True).collect() == df.collect()


def test_partitioned_write_gathers_a_partition_in_a_task(spark, tmp_path):
    """the task that made the rows does not sort and write rows of every partition."""
    rows = spark.range(0, 4000, 1, 8).withColumn("m", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    S.write_csv_and_parquet(rows, f"{tmp_path}/csv", f"{tmp_path}/parquet", ["m"])
    folders = [p for p in (tmp_path / "parquet").iterdir() if p.is_dir()]
    assert len(folders) == 4 and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)  # eight files a folder before
    back = spark.read.parquet(f"{tmp_path}/parquet")
    assert sorted(map(tuple, back.select("id", "m").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
