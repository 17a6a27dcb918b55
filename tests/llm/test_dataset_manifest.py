"""Operator 11 against a tree built and opened in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest

from civicflow.llm import dataset_manifest
from tests.conftest import SF_SMALL

DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, i):
    """(left, right) of each level."""
    out = []
    for level in levels[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        mine = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = mine, levels_of([leaf_of(r) for r in mine])
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        mine, levels = trees[s]
        for i, row in enumerate(mine):
            path = way(levels, i) + way(top, k)
            given = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                given = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            h = leaf_of(given)
            for left, right in path:
                h = H(*left, h, *right)
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], H(*(x for left, right in path for x in left + right)), h, h == top[-1][0],
                        sum(len(left) + len(right) for left, right in path)))
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, DOCS).repartition(parts).selectExpr("*", "1 as lo", "'x' as tree", "2 as hash", "'y' as path", "0 as first")
    found = sorted(map(tuple, dataset_manifest.manifest(docs).collect()), key=repr)
    assert found == sorted(brute(rows), key=repr)
    return found


def random_rows(rng, n, sources):
    return [(rng.choice([None, rng.randrange(n), rng.randrange(n)]), rng.choice(sources), rng.choice([None, "", "de"]),
             rng.choice([None, 0, 17]), rng.choice([None, "", "Ärger ABC", "z|9:-", f"Text {rng.randrange(n)}"])) for _ in range(n)]


def test_equals_tree(spark):
    rng = random.Random(1)
    rows = random_rows(rng, 400, [None, "", "a", "hot", "hot", "hot", "hot", "é", "Z"])
    rows += rows[:30] + [(7, "single", "en", 1, "one row's source"), (8, "long", None, 2, "Q" * 300_000)]
    found = check(spark, rows)
    assert any(not r[6] for r in found) and any(r[6] for r in found)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, n):
    check(spark, [(i, "s", "en", i, f"T{i}") for i in range(n)])


@pytest.mark.parametrize("n", [17])
def test_many_sources(spark, n):
    check(spark, [(i, f"s{i % n}" if i % n else None, "en", i, f"T{i}") for i in range(3 * n)])


def test_empty_table(spark):
    assert dataset_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_equals_sql(spark):
    found = dataset_manifest.manifest(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    twin = con.execute(f"SELECT {', '.join(found.columns)} FROM ({dataset_manifest.SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(twin)
