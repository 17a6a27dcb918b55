"""Terms counted in the row and the vocabulary from hash buckets, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicflow.functions import text as T
from civicflow.operators import text as X


def corpus():
    """Frequent, rare and tied words; a repeated text, a null, an empty one, one of single letters."""
    rows = [(i, "g%d" % (i % 2), " ".join(["common"] * (i % 4 + 1) + [f"w{i % 7}", f"pair{i % 3}", f"once{i}"]))
            for i in range(60)]
    return rows + [(60, "g0", rows[0][2]), (61, "g1", None), (62, "g0", ""), (63, "g1", "a b c"), (64, "g0", "é ñandú")]


def plain(text):
    words = [w for w in (text or "").split() if len(w) >= 2]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def plain_vocabulary(docs, min_df, max_df, k):
    df, total = Counter(), Counter()
    for counts in docs:
        df.update(counts.keys())
        total.update(counts)
    kept = [t for t in df if min_df <= df[t] <= max_df * len(docs)]
    kept = sorted(kept, key=lambda t: (-total[t], t))[:k]
    return {t: (df[t], total[t]) for t in kept}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(corpus(), "doc_id long, grp string, norm string")


def test_row_terms_equal_a_plain_count_without_an_exchange(frame):
    counts = X.row_terms(frame, "doc_id", "norm")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc"], r["term"]): r["tf"] for r in counts.collect()}
    assert got == {(i, t): n for i, _, text in corpus() for t, n in plain(text).items()}


# Few buckets (each full of unrelated terms), one bucket for all, and many.
@pytest.mark.parametrize("buckets", [1, 5, 64, 1 << 20])
@pytest.mark.parametrize("k", [1, 7, 12, 1000])
def test_heavy_vocabulary_is_exact_for_any_buckets(frame, monkeypatch, buckets, k):
    monkeypatch.setattr(X, "FIRST_BUCKETS", 2)
    vocab = X.heavy_vocabulary(X.row_terms(frame, "doc_id", "norm"), X.doc_count(frame), min_df=2, max_df=0.9,
                               max_features=k, buckets=buckets)
    got = {r["term"]: (r["df"], r["total"]) for r in vocab.collect()}
    assert got == plain_vocabulary([plain(t) for *_, t in corpus()], 2, 0.9, k)


def test_heavy_vocabulary_counts_what_the_first_pass_left(spark, monkeypatch):
    """The largest buckets hold frequent terms that the document share prunes; the vocabulary lies beyond."""
    monkeypatch.setattr(X, "FIRST_BUCKETS", 1)
    rows = [(i, "all " * 9 + f"mid{i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, norm string")
    counts = X.row_terms(docs, "doc_id", "norm", max_n=1)
    vocab = X.heavy_vocabulary(counts, X.doc_count(docs), min_df=2, max_df=0.5, max_features=1)
    assert [(r["term"], r["total"]) for r in vocab.collect()] == [("mid0", 10)]


def test_heavy_vocabulary_by_group_and_with_rows_as_parts_of_documents(frame, monkeypatch):
    monkeypatch.setattr(X, "FIRST_BUCKETS", 2)
    counts = X.row_terms(frame, "doc_id", "norm", group=["grp"])
    vocab = X.heavy_vocabulary(counts, X.doc_count(frame, ["grp"]), ["grp"], min_df=2, max_features=3, buckets=64)
    for g in ("g0", "g1"):
        got = {r["term"]: (r["df"], r["total"]) for r in vocab.filter(F.col("grp") == g).collect()}
        assert got == plain_vocabulary([plain(t) for _, grp, t in corpus() if grp == g], 2, 1.0, 3)

    parts = X.row_terms(frame, "grp", "norm")
    n = frame.agg(F.count_distinct("grp").alias("n_docs"))
    vocab = X.heavy_vocabulary(parts, n, min_df=1, max_features=9, one_row_docs=False, buckets=64)
    whole = [sum((plain(t) for _, grp, t in corpus() if grp == g), Counter()) for g in ("g0", "g1")]
    expected = plain_vocabulary(whole, 1, 1.0, 9)
    assert {r["term"]: (r["df"], r["total"]) for r in vocab.collect()} == expected
    tf = {(r["doc"], r["term"]): r["tf"] for r in X.counts_of(parts, vocab).collect()}
    assert tf == {(g, t): c[t] for g, c in zip(("g0", "g1"), whole) for t in expected if c[t]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, norm string")
    counts = X.row_terms(docs, "doc_id", "norm")
    assert X.heavy_vocabulary(counts, X.doc_count(docs), max_features=5).count() == 0


def test_support_is_one_scan(spark):
    rows = [("a", "long enough"), ("a", "also long enough"), ("b", "long enough"), ("b", "tiny"), (None, "long enough"), ("c", None)]
    docs = spark.createDataFrame(rows, "label string, text string")
    got = {tuple(r) for r in X.class_support(docs, "text", "label", 2).collect()}
    assert got == {("a", 2, True), ("b", 1, False)}


def test_texts_are_read_for_the_buckets_and_once_for_the_counts(spark, frame):
    """The counts of the vocabulary come from the written rows: the plan reads no text."""
    counts = X.row_terms(frame, "doc_id", "norm")
    vocab, kept = X.heavy_counts(counts, X.doc_count(frame), min_df=2, max_df=0.9, max_features=12, buckets=64)
    assert sorted(vocab.collect()) == sorted(X.heavy_vocabulary(counts, X.doc_count(frame), min_df=2, max_df=0.9, max_features=12, buckets=64).collect())
    assert sorted(kept.collect()) == sorted(X.counts_of(counts, vocab).select(*kept.columns).collect())
    assert "regexp" not in kept._jdf.queryExecution().executedPlan().toString()


def test_words_are_those_of_the_normalised_text(spark):
    texts = ["", None, "a", "Caf\u00e9-Bar, d'\u00c9t\u00e9!  x\tyy\u00a0zz", "see https://a.b/c?d xhttp://e f_1 \u0660\u0661 \u4e2d\u6587\u3002\u4e2d", "e\u0301a\u0308 \U0001d400b \U0001d400 \x85ab\x1ccd|ef",
             "one two three"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.lower("text")
    for pattern in (T.URL_PATTERN, T.NON_WORD_PATTERN, T.WS_RUN_PATTERN):
        old = F.regexp_replace(old, pattern, " ")
    old = T.strip_accents(F.trim(old))
    alone = F.trim(F.regexp_replace(F.regexp_replace(old, r"(?<!\S)\S(?!\S)", ""), " +", " "))
    rows = df.select(old.alias("old"), X.normalise(df, "text").alias("new"), F.array_remove(F.split(alone, " "), "").alias("was"),
                     T.tokens(X.normalise(df, "text")).alias("of_norm"), T.tokens(X.words(df, "text")).alias("of_words")).collect()
    assert all(r["old"] == r["new"] and r["was"] == r["of_norm"] == r["of_words"] for r in rows)
    pairs = df.select(T.bigrams(T.tokens(X.words(df, "text"))).alias("p")).collect()
    assert [r["p"] for r in pairs] == [[f"{a} {b}" for a, b in zip(r["was"] or [], (r["was"] or [])[1:])] for r in rows]


def test_stop_words_and_null_texts(spark, frame):
    kept = X.row_terms(frame, "doc_id", "norm", stop_words=["common"], max_n=1).filter("doc IN (0, 61, 62)")
    assert sorted((r["doc"], r["term"], r["tf"]) for r in kept.collect()) == [(0, "once0", 1), (0, "pair0", 1), (0, "w0", 1)]


def test_places_give_the_same_counts_from_words_written_once(spark, frame, monkeypatch):
    """Bucket sums need no count by document: an exchange of (bucket, count) and no sort; nothing reads the texts again."""
    monkeypatch.setattr(X, "FIRST_BUCKETS", 2)
    for group, stop in (([], None), (["grp"], ["common"])):
        tokens = X.written_tokens(frame, "doc_id", "norm", group, stop)
        places = X.occurrences(tokens, group)
        assert "regexp" not in (plan := places._jdf.queryExecution().executedPlan().toString()) and "sort_array" not in plan
        counts = X.row_terms(frame, "doc_id", "norm", group, stop)
        of = [*group, "term"]
        assert sorted(places.groupBy(*of).count().collect()) == sorted(counts.groupBy(*of).agg(F.sum("tf")).collect())
        n = X.doc_count(frame, group)
        old, kept = X.heavy_counts(counts, n, group, max_features=7, buckets=64)
        new, mine = X.heavy_counts(X.counted_tokens(tokens, group), n, group, max_features=7, buckets=64, places=places)
        assert sorted(new.collect()) == sorted(old.collect()) and sorted(mine.collect()) == sorted(kept.collect())
