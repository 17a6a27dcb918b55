"""Nothing is dropped that a parameter does not name: sixth zones, unlisted labels, other years."""

from pyspark.sql import functions as F

from civicflow.operators import evaluation as EV
from civicflow.operators import profile
from civicflow.plans import requests as PR
from civicflow.plans import sources as PS
from civicflow.session import ensure_checkpoint_dir
from tests.conftest import SF_SMALL


def test_gap_pivot_has_every_zone(spark):
    gaps = spark.createDataFrame([(z, c, float(z)) for z in (1, 2, 6, 11) for c in ("a", "b")], "cluster int, category_short string, days_vs_city_median double")
    out = profile.gap_pivot(gaps)
    assert out.columns == ["category_short", "z1", "z2", "z6", "z11"]
    assert [tuple(r) for r in out.orderBy("category_short").collect()] == [("a", 1.0, 2.0, 6.0, 11.0), ("b", 1.0, 2.0, 6.0, 11.0)]


def test_confusion_keeps_unlisted_labels(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "new"), ("old", "b"), (None, "a"), ("b", None)], "true_label string, pred_label string")
    long = {(r["true_label"], r["pred_label"]): r["n"] for r in EV.confusion_long(pairs, ["a", "b"]).collect()}
    assert len(long) == 16 and sum(long.values()) == 3
    assert long["a", "new"] == long["old", "b"] == long["a", "a"] == 1
    wide = EV.confusion_matrix(pairs, ["b", "a"])
    assert wide.columns == ["true_label", "b", "a", "new", "old"]
    assert wide.agg(*(F.sum(c) for c in wide.columns[1:])).first()[:] == (1, 1, 1, 0)
    support = EV.classification_report(EV.confusion_long(pairs, ["a", "b"])).where("class = 'macro avg'").first()["support"]
    assert support == 3


def test_merged_sink_returns_every_year(spark):
    ensure_checkpoint_dir(spark)
    back = PS.q_merged_partitioned_sink(spark, SF_SMALL)
    assert back.count() == PR.cleaned(spark, SF_SMALL).count()
    assert back.select("requested_year").distinct().count() > 1
    plan = back.where("requested_year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(requested_year" in plan
