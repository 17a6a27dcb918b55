"""Ingest runs: figures from the writing pass, sidecars, failures in the report."""

import json
from datetime import date

from pyspark.sql import functions as F

from civicflow.sources.ingest import Dataset, ingest


def rows(spark):
    data = [(1, 1.0, "2024-01-05"), (2, None, "2024-01-01"), (3, 3.0, None), (4, 4.0, "2024-02-01")]
    return spark.createDataFrame(data, "id long, lat double, day string").withColumn("day", F.col("day").cast("date"))


def test_report_sidecar_and_failures(spark, tmp_path):
    placed = Dataset(lambda: rows(spark), "portal", lambda d: d.filter("lat IS NOT NULL"), F.col("lat").isNull(), "day")
    broken = Dataset(lambda: rows(spark).select(F.raise_error(F.lit("bad cell")).alias("x")), "broken")
    absent = Dataset(lambda: spark.read.parquet(str(tmp_path / "nowhere")), "absent")
    empty = Dataset(lambda: rows(spark).filter("id < 0"), "empty", date="day")
    got = ingest(spark, {"placed": placed, "broken": broken, "absent": absent, "empty": empty}, str(tmp_path / "run"))
    report = {r["dataset"]: r for r in got.collect()}

    ok = report["placed"]
    assert (ok["status"], ok["n_rows"], ok["n_dropped"], ok["n_columns"]) == ("success", 3, 1, 3)
    assert (ok["min_date"], ok["max_date"]) == (date(2024, 1, 5), date(2024, 2, 1))
    assert spark.read.parquet(ok["path"]).count() == 3
    side = json.loads(spark.read.text(ok["path"] + "_metadata").first()["value"])
    assert side["records"] == 3 and side["columns"] == ["id", "lat", "day"] and side["source"] == "portal"
    assert side["date_range"] == {"start": "2024-01-05", "end": "2024-02-01"} and side["ingestion_timestamp"]

    assert report["broken"]["status"] == "error" and report["broken"]["n_rows"] is None
    assert report["broken"]["message"]
    assert (report["absent"]["status"], report["absent"]["error"]) == ("error", "PATH_NOT_FOUND")
    assert (report["empty"]["status"], report["empty"]["n_rows"]) == ("failed", 0)
    assert report["empty"]["message"] == "returned no data" and report["empty"]["min_date"] is None


def test_one_scan_a_dataset(spark, tmp_path):
    """Every landed row is read once: an accumulator in the scan counts them."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = Dataset(lambda: rows(spark).mapInArrow(note, "id long, lat double, day date"), "portal",
                     lambda d: d.filter("lat IS NOT NULL"), F.col("lat").isNull(), "day")
    ingest(spark, {"placed": source}, str(tmp_path / "run"))
    assert seen.value == 4
