"""Operator 5 against all pairs."""

import random

import numpy as np
import pytest

from civicflow.llm import jaccard
from tests.conftest import SF_SMALL


def shingles(text, k):
    w = bytes(text or "", "utf-8").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4, percent=85):
    sets = [shingles(r[1], k) for r in rows]
    low = [r[0] for r in rows]
    changed = True
    ok = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    links = [(i, j) for i in ok for j in ok if j < i and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j]))
             and (b := len(sets[i] & sets[j])) * 100 >= percent * (len(sets[i]) + len(sets[j]) - b)]
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return sorted(((r[0], len(s), c) for r, s, c in zip(rows, sets, low)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for size in (6, 20, 60, 150, 400, 900):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, size // 40])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).replace("w1", rng.choice(["w1", "W1"])))
    hub = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(90):  # a crowd in which only the hub is close to all
        w = list(hub)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(60):  # a passage that many otherwise different texts hold
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(2, 30))] + passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]))
    texts += ["One two", "one  TWO", "one", "É é", "é É", "a\x1cb c d e", " ".join(vocabulary[:3] * 3000)]
    rng.shuffle(texts)
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, None), (None, texts[0]), (5, texts[5])]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, rows, k, percent, monkeypatch):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = jaccard.components(df, k, percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, percent)
    if k == 4:  # frequent classes and split cells in the small
        monkeypatch.setattr(jaccard, "RARE", 2)
        monkeypatch.setattr(jaccard, "BLOCK", 8)
        assert sorted(map(tuple, jaccard.components(df, k, percent).collect()), key=str) == brute(rows, k, percent)
        kept = jaccard.keep_one(df, k, percent)
        assert kept.columns == df.columns
        assert sorted((r[0] for r in kept.collect()), key=str) == sorted((a for a, _, c in brute(rows, k, percent) if a == c), key=str)


def test_keys_cover_all_links(rows):
    """Any linked pair shares a key, whatever the share of frequent shingles."""
    sh = jaccard.Shingler(4)
    sets = [sh.set_of(t) for _, t in rows if t and t.split()]
    sets = list({s.tobytes(): s for s in sets}.values())
    toks, counts = np.unique(np.concatenate(sets), return_counts=True)
    df = dict(zip(toks.tolist(), counts.tolist()))
    keys = []
    for s in sets:
        t = np.array([x for x in s.tolist() if df[x] > 1], dtype=np.uint64)
        keys.append(set(jaccard.keys_of(len(s), t.view(np.int64), np.array([df[x] for x in t.tolist()], dtype=np.int64), 85).tolist()))
    n = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                n += 1
                assert keys[i] & keys[j]
    assert n > 300


def test_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(map(tuple, jaccard.components(df).collect()), key=str)
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(df).count() == 0 and jaccard.keep_one(df).count() == 0
