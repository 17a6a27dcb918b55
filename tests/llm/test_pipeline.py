"""The pipeline: each stage on its own input, the order, and odd tables."""

import random

import pytest

import corpus_pipeline
from civicflow.llm import bpe
from civicflow.llm.common import without_clash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id int, __gone string, __items int, __toxic_score double, __n_removed int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    plain, vile = [f"word{i}" for i in range(400)], [f"vile{i}ness" for i in range(6)]

    def some(n):
        return " ".join(rng.choice(plain) for _ in range(n))

    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, some(30) + (" " + " ".join(rng.choice(vile) for _ in range(8)) if bad else "") + "\n" + some(30)))
        labels.append((i, 0, int(bad)))
    item = some(60)
    copy = rows[301][1].split()
    copy[70 % len(copy)] = "changed"
    rows += [(1001, some(20) + " " + item + " " + some(20)), (1002, None), (1003, ""), (1004, " ".join(copy)), (1005, rows[302][1]),
             (1006, rows[303][1].split("\n")[0] + "\n" + some(50)), (1007, some(15000)), (None, some(40)), (1006, None)]
    full = [(i, t, "en", "hot", None if t is None else len(t), 1, "g", 2, 0.5, 3) for i, t in rows]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path), {i: t for i, t in rows if i not in (None, 1006)}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "jaccard", "decontaminate", "bpe"]


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        ids = set(rows)
        assert all(r["__id"] == 1 and r["__gone"] == "g" and r["__items"] == 2 and r["__n_removed"] == 3 for r in rows.values())
        if name == "toxicity":
            assert not ids & set(range(0, 400, 5)) and ids >= {i for i in range(400) if i % 5} | {1001, 1002, 1003, None}
        elif name == "lines":
            assert len(rows) == docs.select("doc_id").distinct().count()
            assert rows[1005]["text"] == "" and rows[1005]["n_chars"] == 0 and rows[1002]["text"] is None
            assert rows[302]["text"] == texts[302]
            assert rows[1007]["text"] == texts[1007]
        elif name == "jaccard":
            assert 1004 not in ids and ids >= {301, 302, 1001, 1002, 1003, 1005, 1007, None}
        else:
            assert 1001 not in ids and ids >= {301, 302, 1002, 1003, 1005, 1007, None}
        out.write.parquet(f"{path}/after-{name}")
        docs = spark.read.parquet(f"{path}/after-{name}")


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
    want = bpe.encode_digests(docs).collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_and_no_items_keep_all(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == stages["decontaminate"](spark, docs, str(tmp_path)).count() == docs.count()


def test_without_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "kept0 int, __a int, kept_1 int")
    got = without_clash(df, lambda d: d.selectExpr("*", "1 __a"))
    assert got.columns == ["kept0", "__a", "kept_1", "__a"] and tuple(got.first()) == (1, 2, 3, 1)
