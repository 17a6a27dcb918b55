"""Operator 4 against a brute-force scan and its SQL twin."""

import random

import duckdb
import pytest

from civicflow.llm import lines
from tests.conftest import SF_SMALL


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def brute(rows):
    """Texts after dedup, by row."""
    seen, out = [], {}
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: d[:2])
    for none, doc_id, text in docs:
        kept = []
        for line in text.split("\n"):
            w = line.replace("\r", " ").replace("\t", " ").replace("\x0b", " ").replace("\f", " ").split(" ")
            w = [x for x in w if x]
            gone = any(w == o or min(len(w), len(o)) >= lines.NEAR_WORDS and one_edit(w, o) for o in seen)
            if w:
                seen.append(w)
            if not gone:
                kept.append(line)
        out[(None if none else doc_id, text)] = "\n".join(kept)
    return [(*r[:1], None if r[1] is None else out[r[0], r[1]], *r[2:]) for r in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 14))) for _ in range(25)]

    def vary(line):
        w = line.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w[i : i + rng.choice([0, 1])] = rng.choice([["x"], [], ["y"]])
        return rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\r"])

    out = [(i, "\n".join(vary(rng.choice(base)) for _ in range(rng.randint(0, 6))), "x", 1) for i in range(120)]
    long = " ".join(f"w{i}" for i in range(3000))
    out += [(500, None, "x", 1), (501, "", "x", 1), (502, "\n\n", "x", 1), (503, long + "\n" + long.replace("w7 ", "v7 "), "x", 1),
            (504, "one\ntwo words\none", "x", 1), (505, " two  words\n\tone \n", "x", 1),
            (None, base[3] + "\nsomething new that nobody has written before today", "x", 1), (3, out[3][1], "x", 1)]
    return out


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, n int")
    got = lines.drop_repeated_lines(df)
    assert got.columns[:4] == df.columns
    assert sorted(map(tuple, got.drop("__n_lines", "__n_removed").collect()), key=str) == sorted(brute(rows), key=str)


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = sorted(con.execute(lines.SQL).fetchall())
    assert sorted(map(tuple, lines.dedup_lines(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_emptied_documents(spark):
    df = spark.createDataFrame([(1, "Yes.\n\nthree short words"), (2, "Yes.\nthree  short words"), (3, "Yes.\nno\nYes.")], "doc_id long, text string")
    got = lines.drop_repeated_lines(df).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["Yes.\n\nthree short words", "", "no"]
    assert [r["__n_removed"] for r in got] == [0, 2, 2]


def test_columns_named_as_helpers(spark):
    df = spark.createDataFrame([(1, "a line that stands twice", 5, 6, 7), (2, "a line that stands twice\nx", 8, 9, 10)],
                               "doc_id long, text string, __id int, __row int, __removed int")
    got = lines.drop_repeated_lines(df).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in got] == [(1, "a line that stands twice", 5, 6, 7), (2, "x", 8, 9, 10)]
