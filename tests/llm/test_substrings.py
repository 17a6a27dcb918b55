"""Operator 1 against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from civicflow.llm import substrings
from tests.conftest import SF_SMALL


def brute(rows, window):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = {}
    for doc, w in split:
        if doc is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for doc, w in split:
        gone = set()
        if doc is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)] + ["é", "Ω x"]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    shared = [some(rng.randint(5, 40)) for _ in range(8)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += some(rng.randint(0, 12)) + (p := rng.choice(shared))[rng.choice([0, 0, 3]) : len(p) - rng.choice([0, 0, 2])]
        docs.append((rng.randint(0, 1000), rng.choice([" ", "\n", "\t "]).join(w)))
    docs = list({d[0]: d for d in docs}.values())
    docs += [(2000 + i, docs[5][1]) for i in range(40)] + [(3000, "a b " * 500), (3001, "a b " * 300), (3002, None), (3003, ""), (None, docs[5][1]), docs[7]]
    return docs


def test_equals_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    want = brute(rows, 6)
    assert sum(r[2] > 0 for r in want) > 50
    assert sorted(map(tuple, substrings.dedup_substrings(df, 6, 3).collect()), key=str) == want
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)  # many shards, then all anchors hot, then no broadcast
    assert sorted(map(tuple, substrings.dedup_substrings(df, 6, 3).collect()), key=str) == want
    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, substrings.dedup_substrings(df, 6, 3).collect()), key=str) == want


def test_block_repeated_in_one_document(spark, monkeypatch):
    rng = random.Random(4)
    x, p, y, z = ([f"{c}{rng.randint(0, 999)}" for _ in range(15)] for c in "xpyz")
    rows = [(1, " ".join(z + p + z)), (2, " ".join(x + p + y + x + p + y)), (2, " ".join(y[3:] + x + p + y)), (5, " ".join(p + x + p + y))]
    want = brute(rows, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup_substrings(df, 6, 3).collect()), key=str) == want
    monkeypatch.setattr(substrings, "HOT", 0)
    assert sorted(map(tuple, substrings.dedup_substrings(df, 6, 3).collect()), key=str) == want


def test_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()], 50)
    assert sorted(map(tuple, substrings.dedup_substrings(df).collect()), key=str) == want
    assert any(r[2] for r in want)


def test_index_counts_patterns():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    closed = np.append(text, 0)
    index = substrings.FMIndex(closed, 8)
    for size in (1, 3, 8):
        for at in range(0, 390, 17):
            pattern = text[at : at + size]
            low, high = np.array([0]), np.array([index.n])
            for word in pattern[::-1]:
                low, high = index.extend(np.array([np.searchsorted(index.symbols, word)]), low, high)
            want = sum((text[i : i + size] == pattern).all() for i in range(len(text) - size + 1))
            assert high[0] - low[0] == want


def test_segments_cover_every_window():
    h = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    anchor, _, _, pos, length = substrings.segments(substrings.mix(h), 20, 5)
    covered = sorted(w for p, n in zip(pos.tolist(), length.tolist()) for w in range(p, p + n - 19))
    assert covered == list(range(481))
    assert all(len(x) == 0 for x in substrings.segments(h[:19], 20, 5))


def test_empty(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
