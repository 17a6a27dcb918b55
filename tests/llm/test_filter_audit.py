"""Operator 13 against the definition, document by document and order by order."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from civicflow.llm import filter_audit
from tests.conftest import SF_SMALL

DOCS = "doc_id long, source string, text string, n int"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    out = []
    for doc_id, _, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text),
            doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[2] or "") == text for o in rows))) if bad})
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failing, out = fails(rows), {}
    for part in {r[1] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failing) if (r[1] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def texts(rng):
    words = [rng.choice(["ab", "Abc", "c", "déjà", "x#y", " wide", "z" * 30]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([1, 49, 50, 51, 90]))]
    return rng.choice([" ", "\n", " \t\x0b"]).join(words) + rng.choice(["", " ", "%", " SHOUT" * 20])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = [texts(rng) for _ in range(40)] + [None, "", " ", "plain " * 60, "Z" * 50_000]
    out = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "b", "ünter"]), rng.choice(some), 1) for _ in range(150)]
    return out + out[:10] + [(1000 + i, "hot", "one and the same text", 1) for i in range(200)]


def as_dict(df):
    rows = [r.asDict() for r in df.collect()]
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
             for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_definition(spark, rows):
    rng = random.Random(4)
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as digest", "1 as mask", "0 as words", "1 as good", "2 as part")
    marks = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' as text", "1 as part")
    assert as_dict(filter_audit.audit(docs, marks)) == brute(rows, labels)


def test_empty_tables(spark, rows):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).count() == 0
    assert as_dict(filter_audit.audit(spark.createDataFrame(rows[:20], DOCS), no_labels)) == brute(rows[:20], [])


def test_walk_equals_subset_sums():
    counts = np.random.default_rng(5).integers(0, 50, (4, 32))
    states = filter_audit.gray_walk(counts)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_equals_sql(spark):
    found = filter_audit.audit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    twin = con.execute(f"SELECT {', '.join(found.columns)} FROM ({filter_audit.SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(twin)
