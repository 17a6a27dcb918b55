"""Operator 2: segments against brute force, folds, held-out accuracy, odd inputs."""

import random
import zlib

from civicflow.llm import toxicity
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.1")


def best_segments(scores):
    """All maximal segments by their definition: take the best (shortest, leftmost), then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (i, j, total)
    if best is None:
        return []
    i, j, _ = best
    return best_segments(scores[:i]) + [best] + [(a + j + 1, b + j + 1, s) for a, b, s in best_segments(scores[j + 1:])]


def test_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, -1.0, 2.531, 0.7173, 4.2719]) for _ in range(rng.randint(0, 25))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        want = best_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_tail_is_monotone():
    law = (-3.0, 1.3)
    values = [toxicity.tail(x / 4, law) for x in range(-80, 200)]
    assert values == sorted(values) and values[0] >= 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 10000
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    toxic, flagged = sum(truth[r["doc_id"]] for r in held), sum(r["predicted"] for r in held)
    pos = sorted(r["score"] for r in held if truth[r["doc_id"]])
    neg = sorted(r["score"] for r in held if not truth[r["doc_id"]])
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    print("held out", len(held), "toxic", toxic, "flagged", flagged, "hit", hit, "auc", auc)
    assert auc > 0.97 and hit / toxic > 0.9 and hit / flagged > 0.95


def test_labels_outside_training_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 4) = 2, 1 - toxic, toxic) toxic")
    a, b = (sorted(map(tuple, toxicity.score_documents(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "idiot " * 30, 3.0), (4, "word " * 20000, 4.0), (4, "word " * 20000, 4.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        rows = toxicity.score_documents(docs, lab).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        kept = toxicity.drop_toxic(docs, lab)
        assert kept.columns == docs.columns and kept.count() == 5
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_texts_without_evidence_score_alike_and_stay(spark):
    """Short, empty and null texts without lexicon words take the one score without evidence, also
    where the training rows are too few to calibrate on."""
    clean = [(i, f"plain words about topic number {i}") for i in range(40)]
    toxic = [(100 + i, "vile slur insult here again") for i in range(12)]
    bare = [(200, ""), (201, None), (202, "plain")]
    docs = spark.createDataFrame(clean + toxic + bare, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len({rows[i]["score"] for i in (200, 201, 202)}) == 1
    assert {rows[i]["predicted"] for i in (200, 201, 202)} == {0}
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()} >= {i for i, _ in clean + bare}


def test_training_rows_shuffle_no_text(spark):
    """Check failure: the text of every document crossed a shuffle to meet the marks."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "again"), (None, "none"), (5, None)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
        train = toxicity.training_rows(docs, labels)
        plan = train._jdf.queryExecution().sparkPlan().toString()
        rows = sorted(map(tuple, train.collect()))
    finally:
        spark.conf.set(name, before)
    part = {i: zlib.crc32(str(i).encode()) % 4 for i in range(20)}
    texts = [(i, f"text {i}") for i in range(20)] + [(3, "again")]
    assert rows == sorted((t, i % 2, int(part[i] == 3)) for i, t in texts if part[i] != 2)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
