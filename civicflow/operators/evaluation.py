"""Classifier evaluation: confusion matrix, per-class report, top confusions, splits
(M11, M12, W9, L3, L7-L9, B12).

Everything is derived from the (true, predicted) pairs by aggregation; the label
set is a parameter (the class list of the data set), extended by labels that only
the pairs hold, so no pair is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions.draws import SPAN, draw
from civicflow.operators.common import ntile_of_rank, rank_pieces

SUMMARY_ROWS = ("accuracy", "macro avg", "weighted avg")


def _labels(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label string")


def confusion_long(pairs: DataFrame, labels: list[str], true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """M11 long form: every (true, pred) label pair with its count, zeros kept. The labels are the given
    ones and any others that the pairs hold; pairs with a null label are left out."""
    spark = pairs.sparkSession
    counts = pairs.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    ).where("true_label IS NOT NULL AND pred_label IS NOT NULL").checkpoint()  # labels squared at most, read thrice
    lab = _labels(spark, labels).union(counts.select("true_label")).union(counts.select("pred_label")).distinct()
    grid = lab.select(F.col("label").alias("true_label")).crossJoin(lab.select(F.col("label").alias("pred_label")))
    # grid is labels x labels (the class list squared). The result is that small too, and the
    # report reads it several times: checkpoint it.
    return grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    ).checkpoint()


def confusion_matrix(pairs: DataFrame, labels: list[str], true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """M11 wide form: one row per true label, one column per predicted label (others than the given come last)."""
    long = confusion_long(pairs, labels, true, pred)
    others = sorted({r[0] for r in long.select("pred_label").distinct().collect()} - set(labels))  # the class list
    return long.groupBy("true_label").pivot("pred_label", [*labels, *others]).agg(F.sum("n")).na.fill(0)


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class plus accuracy / macro / weighted rows;
    divisions by zero give 0 (as the reference's ``zero_division=0``)."""
    tp = confusion.filter(F.col("true_label") == F.col("pred_label")).select(
        F.col("true_label").alias("class"), F.col("n").alias("tp")
    )
    support = confusion.groupBy(F.col("true_label").alias("class")).agg(F.sum("n").alias("support"))
    predicted = confusion.groupBy(F.col("pred_label").alias("class")).agg(F.sum("n").alias("n_pred"))
    per = tp.join(support, "class").join(predicted, "class")
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("class", "tp", p.alias("precision"), r.alias("recall"), F.col("support").cast("double").alias("support"))
    per = per.withColumn(
        "f1_score",
        F.when(F.col("precision") + F.col("recall") > 0,
               2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)),
    )
    tot = per.agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    acc = F.col("tp") / F.col("n")
    summary = [
        tot.select(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"),
                   acc.alias("f1_score"), acc.alias("support")),
        tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                   F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                   F.col("wf").alias("f1_score"), F.col("n").alias("support")),
    ]
    rows = per.select("class", "precision", "recall", "f1_score", "support")
    return reduce(DataFrame.unionByName, [rows, *summary])


def class_rows_by_f1(report: DataFrame) -> DataFrame:
    """B12 + L3: class rows only, best F1 first."""
    return report.filter(~F.col("class").isin(*SUMMARY_ROWS)).orderBy(F.desc("f1_score"), "class")


def top_confusions(confusion: DataFrame, k: int = 10) -> DataFrame:
    """The k largest off-diagonal cells, zeros excluded (a top-k report)."""
    off = confusion.filter((F.col("true_label") != F.col("pred_label")) & (F.col("n") > 0))
    return off.orderBy(F.desc("n"), "true_label", "pred_label").limit(k)


def _signed_draw(seed: int, key: str) -> Column:
    """The seeded draw of a row as a signed 64-bit number, in the same order."""
    return (draw(seed, F.col(key)) - F.lit(SPAN // 2)) * F.lit((1 << 64) // SPAN)


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class the round(share * n) rows first in the order of a seeded draw are 'test'.
    Exact per class and deterministic; only keys are ranked (``rank_pieces``), so a class
    holding a third of all rows is still spread over many tasks and no text is shuffled."""
    cut = rank_pieces(df, [label], key, _signed_draw(seed, key), lambda rank, n: F.when(rank <= F.round(n * test_share), 0).otherwise(1))
    return cut.withColumn("split", F.when(F.col("_piece") == 0, "test").otherwise("train")).drop("_piece")


def assign_folds(train: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified k-fold ids (1..k): ntile of the rank by a seeded draw inside each class."""
    cut = rank_pieces(train, [label], key, _signed_draw(seed + 1, key), lambda rank, n: ntile_of_rank(rank, n, k))
    return cut.withColumnRenamed("_piece", "fold")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows chosen by a seeded draw (a sampling operator: the limit is the feature)."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)
