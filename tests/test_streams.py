"""Streams with event time: resumed calls, late rows, state, compaction."""

import datetime
import os

import pytest

from civicflow.streaming import jobs

SCHEMA = "at timestamp, kind string, id long"
DAY = datetime.timedelta(days=1)
T0 = datetime.datetime(2024, 1, 1, 12)


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    """A folder to land files in, read one file a batch."""
    monkeypatch.setattr(jobs, "file_stream", lambda spark, path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    folder, landed, files = tmp_path / "source", [], []
    folder.mkdir()

    def land(rows):
        at = len(files)
        files.append(at)
        rows = [(None if day is None else T0 + day * DAY, kind, k) for day, kind, k in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{at}"))
        target = folder / f"{at:03}.parquet"
        target.write_bytes(next((tmp_path / f"part{at}").glob("*.parquet")).read_bytes())
        os.utime(target, (1_700_000_000 + 100 * at,) * 2)
        landed.extend(rows)

    return str(folder), land, landed


def weekly(spark, path, lateness="5 days", job=None):
    found = jobs.weekly_counts_stream(spark, path, SCHEMA, "at", "kind", lateness, job)
    return sorted(map(tuple, found.collect()), key=repr)


def expected(spark, landed):
    return sorted(map(tuple, jobs.batch_weekly_counts(spark.createDataFrame(landed, SCHEMA), "at", "kind").collect()), key=repr)


def test_second_call_reads_new_files_alone_and_equals_batch(spark, source):
    path, land, landed = source
    land([(0, "a", 1), (1, "b", 2)])
    land([(9, "a", 3), (10, None, 4)])
    assert weekly(spark, path) == expected(spark, landed)
    job = jobs.open_job(spark, "weekly", path, SCHEMA, "at", "kind", "5 days")
    before = job.written("watermark").count()
    land([(11, "a", 5), (12, "a", 6)])
    assert weekly(spark, path) == expected(spark, landed)
    assert job.written("watermark").count() == before + 1  # one file, one batch more
    assert job.late() is None
    assert weekly(spark, path) == expected(spark, landed)  # nothing new
    assert job.written("watermark").count() == before + 1


def test_late_rows_are_in_the_side_table_and_in_the_result(spark, source):
    path, land, landed = source
    job = jobs.open_job(spark, "late", path, "test")
    land([(0, "a", 1), (20, "a", 2)])
    land([(16, "b", 3), (14, "b", 4), (None, "b", 5)])  # on time (within five days of day 20), late, without time
    assert weekly(spark, path, job=job) == expected(spark, landed)
    assert sorted((r["event_time"], r["key"], r["batch_id"]) for r in job.late().where("event_time is not null").collect()) == [(T0 + 14 * DAY, "b", 1)]
    assert job.late().where("event_time is null").count() == 1
    land([(30, "c", 6), (24, "c", 7)])
    land([(24, "c", 8)])
    assert weekly(spark, path, job=job) == expected(spark, landed)
    assert job.late().count() == 3


def test_rewritten_source_starts_anew(spark, source):
    path, land, landed = source
    land([(0, "a", 1)])
    assert weekly(spark, path) == expected(spark, landed)
    landed.clear()
    os.unlink(f"{path}/000.parquet")
    land([(3, "z", 9), (4, "z", 9)])
    assert weekly(spark, path) == expected(spark, landed)


def test_batches_are_compacted(spark, source, monkeypatch):
    path, land, landed = source
    monkeypatch.setattr(jobs.compact, "__defaults__", (2,))
    job = jobs.open_job(spark, "compacted", path, "test")
    for k in range(4):
        land([(2 * k, "a", k), (2 * k + 1, "b", k)])
        assert weekly(spark, path, job=job) == expected(spark, landed)
    assert len(os.listdir(job.path("out"))) <= 2
    assert weekly(spark, path, job=job) == expected(spark, landed)


def test_dedupe_is_held_in_state(spark, source):
    path, land, landed = source
    job = jobs.open_job(spark, "dedupe-state", path, "test")

    def keys():
        return sorted(r[0] for r in jobs.dedupe_stream(spark, path, SCHEMA, "id", "at", "5 days", job).collect())

    land([(0, "a", 1), (1, "a", 1), (1, "a", 2)])
    assert keys() == [1, 2]
    land([(2, "a", 2), (3, "a", 3)])  # 2 was seen in the call before: state, not a distinct over the output
    assert keys() == [1, 2, 3]
    assert job.written("out").where("id = 2").count() == 1
    land([(40, "a", 4)])
    land([(8, "a", 5), (9, "a", 1)])  # behind the watermark
    assert keys() == [1, 2, 3, 4, 5]
    assert sorted(r["id"] for r in job.late().collect()) == [1, 5]


def test_missing_rows_give_empty_results(spark, tmp_path):
    (tmp_path / "none").mkdir()
    path = str(tmp_path / "none")
    assert weekly(spark, path) == []
    assert jobs.dedupe_stream(spark, path, SCHEMA, "id", "at").count() == 0
