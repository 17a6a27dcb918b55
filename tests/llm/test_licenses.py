"""Operator 9 against a plain Python scan with the same rules."""

import re

import pytest

from civicflow.llm import licenses
from tests.conftest import SF_SMALL

ODD = [None, "", "   ", "CC-BY", "cc by cc by 4.0 CC BY-SA 3.0", "All rights\nreserved. all rights all rights reserved",
       "Licensed under the GNU General Public License, version 3.", "éall rights reservedé", "mit der MIT License und mit",
       "Apache License, Version 2.0 (the License); Apache License", "Copyright (c) 2020 Some Body Inc. All rights reserved.",
       "general public license " * 400, "K" * 3000, "GPL-2.0-or-later; LGPL v2.1 or later", "no license at all",
       "GNU Lesser General Public License 2.1", "gnu library general public licence v2"]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    joined = " " + " ".join(words) + " "
    base, found = [], []
    for i, (label, priority, key, pattern) in enumerate(licenses.RULES):
        for m in re.finditer(f" (?:{pattern})(?= )", joined) if key in joined else []:
            first = joined[: m.start()].count(" ")
            found.append((first, first + m.group().count(" ") - 1, priority, i, label))
            if i < len(licenses.BASE):
                base.append((first, label))
    kept = [x for x in found if not any(
        y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2]
        and ((y[0], y[1]) != (x[0], x[1]) or (-y[2], y[3]) < (-x[2], x[3])) for y in found)]
    starts = [b[0] for b in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b[1] for b in base})),
            ",".join(sorted({b[1] for b in base} | {x[4] for x in kept})), 1 - 1 / (1 + sum(x[2] for x in kept)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "cc by", "x"), (4, ODD[4], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string").union(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang"))


def test_scan_equals_brute_force(docs):
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in docs.collect()), key=str)


def test_rules_are_whole():
    assert len(licenses.RULES) > 200 and len(set(licenses.RULES)) == len(licenses.RULES)
    for _, _, key, pattern in licenses.RULES:  # literal rules: the keyword is part of what they match
        if not re.search(r"[(\[?]", pattern):
            assert key in pattern
    assert all(any(g in k for g in licenses.GATE) for k in licenses.KEYWORDS)


def test_suppression_and_empty(spark, docs):
    row = licenses.scan(spark.createDataFrame([(1, ODD[6])], "doc_id long, text string")).first()
    assert row["labels"] == "gpl,gpl-3" and row["n_base"] == 1 and row["first_word"] == 4
    assert licenses.scan(docs.limit(0)).count() == 0
