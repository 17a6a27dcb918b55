"""Property checks on the scalable re-formulations."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from civicflow.operators import common, evaluation as EV, forecast as FC
from civicflow.streaming import jobs
from tests.conftest import SF_SMALL


def test_hash_rank_equals_window_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = common.hash_rank(df, ["g"], "k", 7)
    w = Window.partitionBy("g").orderBy(F.xxhash64(F.col("k"), F.lit(7)), "k")
    ref = df.withColumn("_ref", F.row_number().over(w))
    j = got.join(ref, ["g", "k"])
    assert j.filter(F.col("_rank") != F.col("_ref")).count() == 0
    sizes = {r["g"]: r["_n"] for r in got.select("g", "_n").distinct().collect()}
    assert sizes == {0: 1667, 1: 1667, 2: 1666}


def test_stratified_split_is_exact(spark):
    df = spark.range(1003).select((F.col("id") % 4).alias("label"), F.col("id").alias("key"))
    s = EV.stratified_split(df, "label", "key")
    sizes = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for lab in range(4):
        n = sizes[(lab, "test")] + sizes[(lab, "train")]
        assert sizes[(lab, "test")] == round(n * 0.2)
    folds = EV.assign_folds(s.filter("split = 'train'"), "label", "key")
    per = folds.groupBy("label", "fold").count().collect()
    by = {}
    for r in per:
        by.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by.values())


def test_top_k_per_group_exact(spark):
    df = spark.range(2000).select((F.col("id") % 5).alias("g"), F.col("id").cast("string").alias("term"),
                                  ((F.col("id") * 7919) % 1000).alias("score"))
    got = common.top_k_per_group(df, ["g"], [F.desc("score"), F.asc("term")], 7, ["term"], salt=4)
    w = Window.partitionBy("g").orderBy(F.desc("score"), F.asc("term"))
    ref = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 7")
    assert sorted(map(tuple, got.select("g", "term", "rank").collect())) == sorted(map(tuple, ref.select("g", "term", "rank").collect()))


def test_bootstrap_intervals_nest(spark):
    fc = spark.createDataFrame([("s", "m", h, None, 10.0) for h in range(1, 6)],
                               "series_id string, model string, h int, week_start date, forecast double")
    res = spark.createDataFrame([("s", "m", [float(x) for x in range(-5, 6)])], "series_id string, model string, residuals array<double>")
    for cumulative in (True, False):
        out = FC.bootstrap_intervals(fc, res, n_boot=200, cumulative=cumulative).collect()
        for r in out:
            assert r["lo_95"] <= r["lo_80"] <= r["forecast"] <= r["hi_80"] <= r["hi_95"]
            assert r["lo_95"] >= 0


def test_stream_equals_batch(spark):
    path = f"{SF_SMALL}/orders.parquet"
    schema = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")
    stream = jobs.weekly_counts_stream(spark, path, schema, "o_orderdate", "o_orderpriority")
    batch = jobs.batch_weekly_counts(spark.read.parquet(path), "o_orderdate", "o_orderpriority")
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_streams_count_every_row_of_shuffled_files(spark, tmp_path, monkeypatch):
    from civicflow.operators import weather
    from civicflow.plans import streaming as PS

    def one_file_per_batch(spark, path, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    monkeypatch.setattr(jobs, "file_stream", one_file_per_batch)

    def landed(table, by):
        """Four files by time, landed as third, first, fourth, second."""
        df = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
        part = F.ntile(4).over(Window.orderBy(by))
        df.withColumn("p", part).write.partitionBy("p").parquet(str(tmp_path / f"{table}-parts"))
        path = tmp_path / table
        path.mkdir()
        for at, p in enumerate((3, 1, 4, 2)):
            source = next((tmp_path / f"{table}-parts" / f"p={p}").glob("*.parquet"))
            target = path / f"{at}.parquet"
            target.write_bytes(source.read_bytes())
            os.utime(target, (1_000_000 + 100 * at,) * 2)
        return str(path), df

    path, orders = landed("orders", "o_orderdate")
    got = jobs.weekly_counts_stream(spark, path, PS.ORDERS_SCHEMA, "o_orderdate", "o_orderpriority")
    want = jobs.batch_weekly_counts(orders, "o_orderdate", "o_orderpriority")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    path, items = landed("lineitem", "l_shipdate")
    got = jobs.daily_station_stream(spark, path, PS.LINEITEM_SCHEMA, PS._station_day)
    want = weather.daily_weather(PS._station_day(items))
    assert got.columns == want.columns

    def rounded(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())

    assert rounded(got) == rounded(want)
    got = jobs.dedupe_stream(spark, path, PS.LINEITEM_SCHEMA, "l_orderkey", "l_shipdate")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, items.select("l_orderkey").distinct().collect()))


def test_stream_output_missing_is_empty_corrupt_is_an_error(spark, tmp_path):
    assert jobs.read_latest(spark, str(tmp_path / "none"), ["k"], "k long, n long").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not a parquet file")
    with pytest.raises(Exception):
        jobs.read_latest(spark, str(tmp_path / "bad"), ["k"], "k long, n long")


def test_scoring_covers_every_turn(spark):
    from civicflow.plans import classify as PC, streaming as PS
    from civicflow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").selectExpr("conv_id * 1000 + turn msg_id")
    for query in (PC.q_live_scoring, PS.q_stream_scoring):
        got = query(spark, SF_SMALL).select("msg_id").distinct()
        assert turns.exceptAll(got).count() == 0 and got.exceptAll(turns).count() == 0


@pytest.mark.parametrize("hot", [0, 1, 40])
def test_pieces_of_ranks_leave_the_texts_where_they_are(spark, hot):
    """Same pieces as by ranking whole rows, keys that repeat or are null included; no wide row crosses an exchange."""
    rows = [(f"g{k % 3}", k, f"text {k}") for k in range(200)] + [("g1", 7, f"again {k}") for k in range(hot)] + [("g2", None, f"null {k}") for k in range(hot)]
    df = spark.createDataFrame(rows, "g string, k long, text string")
    h = F.xxhash64(F.coalesce("k", F.lit(-1)))
    got = common.rank_pieces(df, ["g"], "k", h, lambda rank, n: common.ntile_of_rank(rank, n, 5))
    w = Window.partitionBy("g").orderBy(h, "k")
    ref = df.withColumn("_piece", F.ntile(5).over(w))
    count = lambda d: sorted((tuple(r) for r in d.groupBy("g", "k", "_piece").count().collect()), key=repr)
    assert count(got) == count(ref)
    assert sorted(r["text"] for r in got.collect()) == sorted(text for *_, text in rows)
    if hot < 40:
        assert " Exchange" not in got._jdf.queryExecution().executedPlan().toString()
