"""Operator 12 against the model written out with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from civicflow.llm import ngram_lm
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, source string"
END, BEGIN = object(), object()


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not all(n):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k) for k in (1, 2, 3))]


class Brute:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            t = tokens(text)
            self.words.update(t)
            self.pairs.update(zip([BEGIN, *t], t))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.contexts = Counter(w for _, w in self.pairs)
        self.after = defaultdict(list)
        for (v, _), c in self.pairs.items():
            self.after[v].append(c)
        self.d, self.e = discounts(self.pairs.values()), discounts(self.contexts.values())
        self.left = sum(self.e[min(c, 3)] for c in self.contexts.values())

    def q(self, w):
        if not self.pairs:
            return 1 / (self.v + 1)
        c = self.contexts[w]
        return (c - self.e[min(c, 3)]) / len(self.pairs) + self.left / len(self.pairs) / (self.v + 1)

    def p(self, v, w):
        after = self.after.get(v)
        if not after:
            return self.q(w)
        c = self.pairs[v, w]
        return (c - self.d[min(c, 3)]) / sum(after) + sum(self.d[min(k, 3)] for k in after) / sum(after) * self.q(w)

    def row(self, doc_id, text):
        t = tokens(text)
        return (doc_id, held(doc_id), len(t), sum(self.words[w] > 0 for w in t), self.n,
                sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in t),
                sum(math.log10(self.p(v, w)) for v, w in zip([BEGIN, *t], t)))


def rows_of(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Ärger", "ärger", "İ", "x y", "A", "a"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = []
    for k in range(n):
        text = rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40]))) + rng.choice(["", f" rare{k}"])
        out.append((rng.choice([None, rng.randrange(10 * n), rng.randrange(10 * n)]), rng.choice([None, "", text, text, text]), "s"))
    return out + out[:5] + [(77, "hot word " * 3000, "s"), (78, "long " + " ".join(f"u{i}" for i in range(3000)), None)]


def compare(found, expected):
    order = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[6], 5))
    found, expected = sorted(map(tuple, found), key=order), sorted(expected, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(2), 300)


@pytest.mark.parametrize("sizes", [(2_000_000, 2_000_000), (500, 3_000)])
def test_equals_definition(spark, rows, monkeypatch, sizes):
    monkeypatch.setattr(ngram_lm, "BLOCK_TOKENS", sizes[0])
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", sizes[1])  # the small one splits contexts over shards
    monkeypatch.setattr(ngram_lm, "PART", 1 << 12)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 as block", "'x' as kind", "2 as shard", "true as held")
    model = Brute([t for d, t, _ in rows if not held(d)])
    compare(ngram_lm.score_documents(docs).collect(), [model.row(d, t) for d, t, _ in rows])


def test_other_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 4_000)
    learnt = ngram_lm.fit(spark.createDataFrame(rows, DOCS))
    others = rows_of(random.Random(8), 40)
    model = Brute([t for d, t, _ in rows if not held(d)])
    scores = ngram_lm.score(spark.createDataFrame(others, DOCS), learnt)
    compare(scores.collect(), [model.row(d, t) for d, t, _ in others])
    total = scores.agg(ngram_lm.perplexity(scores)).first()[0]
    logs = [model.row(d, t) for d, t, _ in others]
    assert total == pytest.approx(10 ** (-sum(r[6] for r in logs) / sum(r[2] for r in logs)))


def test_probabilities_sum_to_one(rows):
    model = Brute([t for _, t, _ in rows])
    for v in ["w0", "hot", "never"]:
        assert sum(model.p(v, w) for w in model.words) + model.p(v, "unknown word") == pytest.approx(1)


def test_empty_and_untrained(spark):
    assert ngram_lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(d, "some words", "s") for d in range(200) if held(d)]
    compare(ngram_lm.score_documents(spark.createDataFrame(rows, DOCS)).collect(), [Brute([]).row(d, t) for d, t, _ in rows])


def test_better_than_base_on_held_out(spark):
    scores = ngram_lm.score_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in scores) > sum(r["base_score"] for r in scores)
