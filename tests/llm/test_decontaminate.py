"""Operator 3 against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from civicflow.llm import decontaminate as op
from tests.conftest import SF_SMALL


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute(docs, items):
    out = []
    prepared = {}
    for item, text in {(r[0], r[1]) for r in items if r[0] is not None}:
        w = words(text)
        if w:
            k = min(5, len(w))
            prepared[item] = (w, k, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])
    for doc_id, text, *_ in docs:
        w, best = words(text), {}
        for item, (iw, k, sh) in prepared.items():
            mine, held, m = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)], set(sh), len(sh)
            hits = [p for p, s in enumerate(mine) if s in held]
            starts = {max(0, min(s, len(w) - len(iw))) for p in hits for s in range(p - m + 1, p + 1)}  # all that hold a hit
            for s in starts:
                a, b = Counter(mine[s : s + len(sh)]), Counter(sh)
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + len(sh) - both)
                if sim >= 0.8:
                    best[item] = max(best.get(item, 0), sim)
        out.append((doc_id, bool(best), len(best), ",".join(map(str, sorted(best))), max(best.values(), default=0.0)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    items += [(900, "just three words"), (901, ""), (902, None), (None, "no id at all here and more"), (903, "a b a b a b a b a b a b a b"), items[0]]
    filler = [f"filler{i}" for i in range(200)]

    def some(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    docs = []
    for i in range(150):
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "changed"
        w = w[rng.choice([0, 0, 1, 3]) : len(w) - rng.choice([0, 0, 2])]
        docs.append((i, some(rng.randint(0, 60)) + " " + rng.choice(["", "> "]) + " ".join(w).upper() + "! " + some(rng.randint(0, 60)), 1))
    docs += [(500, None, 1), (501, "", 1), (502, "x just three, words y", 1), (503, "a b " * 50, 1), (None, items[3][1], 1), (7, docs[7][1], 1),
             (504, some(20000) + " " + items[5][1], 1), (505, items[6][1] + "\n" + items[7][1], 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, similarity int"), spark.createDataFrame(items, "item_id long, text string"), docs, items)


def test_equals_brute_force(tables):
    docs, benchmark, rows, items = tables
    got = op.find_contamination(docs, benchmark).collect()
    want = brute(rows, items)
    assert sum(w[1] for w in want) > 50
    assert [(a, b, c, d, round(e, 9)) for a, b, c, d, e in sorted(map(tuple, got), key=str)] == [(a, b, c, d, round(e, 9)) for a, b, c, d, e in want]


def test_drop_keeps_columns(tables):
    docs, benchmark, rows, items = tables
    kept = op.drop_contaminated(docs, benchmark)
    clean = {w[0] for w in brute(rows, items) if not w[1]}
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == clean


def test_given_tables(spark):
    docs, benchmark = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    got = op.find_contamination(docs, benchmark)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == [w[:4] for w in want]
    assert "Python" not in got._jdf.queryExecution().toString()


def test_windows_at_the_threshold(spark):
    rng = random.Random(6)
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(49)] for _ in range(300)]  # 45 shingles; one changed word leaves 40 of 50
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([*w[:20], "changed", *w[21:]])) for i, w in enumerate(texts)], "doc_id long, text string")
    got = op.find_contamination(docs, items).select("doc_id", "item_ids", "similarity").collect()
    assert sorted(map(tuple, got)) == [(i, str(i), 0.8) for i in range(300)]


def test_empty(spark, tables):
    docs, benchmark, *_ = tables
    assert op.find_contamination(docs.limit(0), benchmark).count() == 0
    assert op.find_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert op.drop_contaminated(docs, benchmark.where("item_id = 901")).count() == docs.count()


def test_swapped_halves(spark):
    w = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(["x"] * 9 + w[30:] + w[:30] + ["y"] * 30)), (2, " ".join(w[20:40] + w[:20] + w[40:])), (3, " ".join(w[40:] + w[20:40] + w[:20] + ["y"] * 9)),
            (4, " ".join(["x"] * 400 + w[30:] + w[:30])), (5, " ".join(w[30:] + w[:25]))]
    items = [(7, " ".join(w)), (8, " ".join(["z"] * 70))]
    got = op.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert [x[1] for x in want] == [True, False, False, True, False]
    assert [(*tuple(r)[:4], round(r[4], 9)) for r in got.orderBy("doc_id").collect()] == [(*x[:4], round(x[4], 9)) for x in want]


def test_columns_named_as_helpers(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 4, 5, 6), (2, "other words", 7, 8, 9)], "doc_id long, text string, __id int, __items int, __row int")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    kept = op.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "other words", 7, 8, 9)]


def test_index_and_contents_are_not_broadcast(spark, tables):
    """A broadcast table keyed by several columns takes 64 MB of the driver; the index has 2,788 rows an item."""
    docs, benchmark, *_ = tables
    got = op.contaminated_windows(docs, benchmark)
    assert got.count() > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and not any("block#" in line or "c1#" in line.split("],")[0] for line in joins)


def test_no_plan_holds_all_steps(spark, tables):
    """The steps are written one after the other, so that the driver never plans and launches all their shuffles at once."""
    docs, benchmark, *_ = tables
    plan = op.drop_contaminated(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert 0 < sum(line.lstrip(" :+-").startswith("Exchange ") for line in plan.splitlines()) <= 8
