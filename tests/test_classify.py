"""Text scoring by sums over a weight table against the fitted pyspark.ml model."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from civicflow.operators import classify as CL
from civicflow.operators import text as X
from civicflow.sources.tables import state


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = {"road": "pothole street paving asphalt crack".split(), "tree": "branch leaf root fallen trunk".split(),
             "water": "leak pipe drain flood hydrant".split()}
    rows = []
    for k in range(240):
        label = rng.choice(sorted(words))
        pool = words[label] * 3 + ["the", "city", "near", "corner"] + words["road"]
        rows.append((k, label, " ".join(rng.choices(pool, k=rng.choice([3, 8, 30])))))
    docs = CL.prepare(spark.createDataFrame(rows, "doc_id long, label string, text string"), "text").checkpoint()
    return docs, CL.fit(docs, "doc_id", "label")


def others(spark, docs):
    new = [(1000, "x", ""), (1001, "x", None), (1002, "x", "words that no training text holds"), (1003, "x", "leak " * 5000 + "pipe")]
    return CL.prepare(docs.select("doc_id", "label", "text").union(spark.createDataFrame(new, "doc_id long, label string, text string")), "text")


def test_scores_equal_the_model(spark, corpus):
    docs, model = corpus
    texts = others(spark, docs)
    vectors = CL.written_vectors(CL.vectorise(texts, "doc_id", "norm", model.vocab, model.n_features))
    expected = {r["doc_id"]: r for r in model.lr.transform(vectors).select("doc_id", "prediction", vector_to_array("probability").alias("p")).collect()}
    label = {r["label_idx"]: r["label"] for r in model.labels.collect()}
    found = CL.predict(model, texts, "doc_id").collect()
    assert len(found) == len(expected) == 244
    for r in found:
        np.testing.assert_allclose(r["probs"], expected[r["doc_id"]]["p"], rtol=0, atol=1e-9)
        assert r["predicted"] == label[expected[r["doc_id"]]["prediction"]]
        assert r["confidence"] == round(max(r["probs"]), 3) or abs(r["confidence"] - max(r["probs"])) <= 5e-4
    for k in (1000, 1001, 1002):  # no known term: the intercepts alone
        assert next(r for r in found if r["doc_id"] == k)["probs"] == pytest.approx(expected[1000]["p"])


@pytest.mark.parametrize("arrow", ["false", "true"])
def test_scores_whether_arrow_is_on_or_off(spark, corpus, arrow):
    docs, model = corpus
    name = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow)
    try:
        coef = {r["term"]: r["coef"] for r in model.weights().collect()}
        scored = CL.predict(model, docs, "doc_id").count()
    finally:
        spark.conf.set(name, before)
    matrix = model.lr.coefficientMatrix.toArray()
    assert coef == {r["term"]: matrix[:, r["idx"]].tolist() for r in model.vocab.collect()} and scored == docs.count()


def test_vectors_equal_tf_idf(spark, corpus):
    docs, model = corpus
    vocab = {r["term"]: (r["idx"], r["idf"]) for r in model.vocab.collect()}
    counts = {}
    for r in X.term_counts(docs, "doc_id", "norm").collect():
        if r["term"] in vocab:
            counts.setdefault(r["doc"], {})[vocab[r["term"]][0]] = (1 + np.log(r["tf"])) * vocab[r["term"]][1]
    for r in CL.written_vectors(CL.vectorise(docs, "doc_id", "norm", model.vocab, model.n_features)).collect():
        want = counts.get(r["doc_id"], {})
        assert r["features"].indices.tolist() == sorted(want)
        norm = np.sqrt(sum(v * v for v in want.values()))
        np.testing.assert_allclose(r["features"].values, [want[i] / norm for i in sorted(want)], rtol=1e-12)


def test_no_python_on_the_scoring_path(spark, corpus):
    docs, model = corpus
    plan = CL.predict(model, docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    package = pathlib.Path(CL.__file__).parents[1]
    assert not [p for p in package.rglob("*.py") if "llm" not in p.parts and "F.udf" in p.read_text()]


def test_top_terms_are_the_largest_coefficients(spark, corpus):
    _, model = corpus
    label = {int(r["label_idx"]): r["label"] for r in model.labels.collect()}
    term = {r["idx"]: r["term"] for r in model.vocab.collect()}
    found = {r["category"]: r["top_terms"] for r in CL.top_terms(model, 3).collect()}
    for k, row in enumerate(model.lr.coefficientMatrix.toArray()):
        best = sorted(range(len(row)), key=lambda i: (-row[i], term[i]))[:3]
        assert all(term[i] in found[label[k]] for i in best)


def test_state_follows_the_files(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(5).write.parquet(f"{folder}/documents.parquet")
    before = state(spark, folder, "documents")
    assert before == state(spark, folder, "documents")
    spark.range(7).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert before != state(spark, folder, "documents")


def written(spark):
    base = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent
    return sum(f.stat().st_size for f in base.rglob("*") if f.is_file())


def test_a_fit_and_its_scores_write_less_than_the_texts_twice(spark):
    """Most terms of a corpus are rare: no row for each (document, term) is kept on disk."""
    rng = random.Random(3)
    rows = [(k, "ab"[k % 2], " ".join([("road", "tree")[k % 2]] * 3 + [f"w{rng.randrange(10**7)}" for _ in range(12000)])) for k in range(120)]
    docs = CL.prepare(spark.createDataFrame(rows, "doc_id long, label string, text string"), "text")
    before = written(spark)
    model = CL.fit(docs, "doc_id", "label")
    assert CL.predict(model, docs, "doc_id").where("predicted IS NOT NULL").count() == 120
    assert written(spark) - before < 2 * sum(len(text) for *_, text in rows)


def test_models_without_a_fold_equal_fits_of_their_own(spark, corpus, monkeypatch):
    monkeypatch.setattr(CL, "MAX_FEATURES", 23)  # the cut differs from fold to fold
    train = corpus[0].withColumn("fold", F.col("doc_id") % 3 + 1)
    vectors = CL.left_out_vectors(train, "doc_id", "label", "fold")
    assert sorted(vectors) == [1, 2, 3]
    for k in vectors:
        part, held = train.filter(F.col("fold") != k), train.filter(F.col("fold") == k)
        own, shared = CL.fit(part, "doc_id", "label"), CL.fit(part, "doc_id", "label", vectors[k])
        assert {r["term"]: r["idf"] for r in own.vocab.collect()} == {r["term"]: r["idf"] for r in shared.vocab.collect()}
        a, b = ({r["doc_id"]: r["probs"] for r in CL.predict(m, held, "doc_id").collect()} for m in (own, shared))
        assert len(a) == held.count() and a.keys() == b.keys()
        for d in a:
            np.testing.assert_allclose(a[d], b[d], rtol=0, atol=1e-6)


def test_vectors_counted_in_the_row_equal_those_added_up_by_document(spark, corpus, monkeypatch):
    docs = others(spark, corpus[0])

    def found():
        rows = CL.scaled(CL.training_vectors(docs, "doc_id", "label")).collect()
        return sorted((r["label"], r["features"].indices.tolist(), np.round(r["features"].values, 9).tolist()) for r in rows)

    single = found()
    monkeypatch.setattr(CL, "one_row_ids", lambda *_: False)
    assert single == found() and len(single) == 244


def test_rows_of_one_document_are_added_up(spark):
    rows = [(1, "a", "leak pipe"), (1, "b", "leak leak"), (2, "a", "pipe drain"), (3, "b", "drain leak"), (None, "a", "leak drain")]
    docs = CL.prepare(spark.createDataFrame(rows, "doc_id long, label string, text string"), "text")
    assert CL.left_out_vectors(docs.withColumn("fold", F.lit(1)), "doc_id", "label", "fold") is None
    vectors = CL.training_vectors(docs, "doc_id", "label")
    idf = {r["term"]: r["idf"] for r in vectors.vocab.collect()}
    assert idf == pytest.approx({t: np.log(6 / (1 + df)) + 1 for t, df in {"leak": 3, "pipe": 2, "drain": 3}.items()})
    weight = {"leak": (1 + np.log(3)) * idf["leak"], "pipe": idf["pipe"]}  # document 1: three leaks, a pipe, no pair of two rows
    at = {r["term"]: r["idx"] for r in vectors.vocab.collect()}
    norm = np.sqrt(sum(w * w for w in weight.values()))
    same = [r["label"] for r in vectors.rows.collect() if dict(zip(r["features"].indices.tolist(), r["features"].values)) == pytest.approx({at[t]: w / norm for t, w in weight.items()})]
    assert sorted(same) == ["a", "a", "b", "b"] and vectors.rows.count() == 6
