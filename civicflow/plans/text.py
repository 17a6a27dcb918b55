"""Registered text queries: normalisation, TF-IDF, slice / zone vocabularies,
support filter, splits and the evaluation reports.

Stand-ins (SURVEY 7.2): request descriptions = ``documents.text``; category =
``documents.source`` (20 classes); language slices = ``documents.lang``; zones
for the zone-term page = ``source``; the evaluated predictions compare
``labels`` (quality / toxic) with a length rule on ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions import stopwords
from civicflow.functions import text as T
from civicflow.functions.draws import draw_sql
from civicflow.operators import evaluation as EV
from civicflow.operators import text as X
from civicflow.sources.tables import read_table, spread

# Vectoriser settings of the classifier and of the two dashboard pages.
MAX_FEATURES, MIN_DF, MAX_DF = 10000, 2, 0.95
SLICE_MAX_FEATURES, SLICE_TOP = 30, 20
ZONE_MAX_FEATURES, ZONE_TOP, ALL_ZONES_TOP = 500, 20, 40
MIN_CLASS_SIZE = 50
# Stand-in evaluation classes and the length rule that "predicts" them.
EVAL_LABELS = ["good", "poor", "toxic"]


def docs(spark, sf_dir) -> DataFrame:
    """Documents as scanned: terms are counted inside the row, so no text is shuffled (but for
    ``spread``, where the table has fewer row groups than there are cores)."""
    return spread(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def q_text_normalise(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", X.normalise(d, "text").alias("norm"))


def tfidf_weights(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    words = d.select("doc_id", X.words(d, "text").alias("words"))
    tokens = X.written_tokens(words, "doc_id", "words")
    vocab, counts = X.heavy_counts(X.counted_tokens(tokens), X.doc_count(tokens), min_df=MIN_DF, max_df=MAX_DF, max_features=MAX_FEATURES,
                                   places=X.occurrences(tokens))
    return X.tfidf(counts, vocab)


def q_tfidf_terms(spark, sf_dir):
    w = tfidf_weights(spark, sf_dir)
    return w.select(F.col("doc").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def slice_scores(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    words = d.select("lang", "doc_id", X.words(d, "text", strip_accents=False).alias("words"))
    tokens = X.written_tokens(words, "doc_id", "words", group=["lang"], stop_words=list(stopwords.english()))
    n = X.doc_count(d, ["lang"])
    vocab, counts = X.heavy_counts(X.counted_tokens(tokens, ["lang"]), n, ["lang"], min_df=MIN_DF, max_features=SLICE_MAX_FEATURES,
                                   places=X.occurrences(tokens, ["lang"]))
    return X.mean_weights(X.tfidf(counts, vocab, ["lang"]), n, ["lang"])


def q_slice_vocabulary(spark, sf_dir):
    top = X.top_terms(slice_scores(spark, sf_dir), ["lang"], SLICE_TOP)
    return top.select(
        "lang", "term", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"),
        X.font_sizes(top, ["lang"]).alias("size"),
    )


def q_slice_term_list(spark, sf_dir):
    """S24 then S23: the top terms of each slice formatted as one string, and parsed back."""
    top = X.top_terms(slice_scores(spark, sf_dir), ["lang"], SLICE_TOP)
    packed = top.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", F.col("score").alias("weight")))).alias("t")
    )  # <= SLICE_TOP entries per slice
    listed = packed.select("lang", T.format_terms(F.col("t")).alias("top_terms"))
    parsed = listed.select("lang", "top_terms", F.posexplode(T.parse_terms(F.col("top_terms"))).alias("pos", "p"))
    return parsed.select("lang", (F.col("pos") + 1).alias("rank"), F.col("p.term").alias("term"),
                         F.col("p.weight").alias("weight"))


def zone_scores(spark, sf_dir) -> DataFrame:
    """M17 + G24: zones as documents without building one text per zone: per-description
    term counts are summed per zone (so no bigram spans two descriptions)."""
    d = spread(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")).withColumnRenamed("source", "zone")
    words = d.select("zone", "doc_id", T.word_text(F.col("text"), strip_urls=False).alias("words"))
    tokens = X.written_tokens(words, "zone", "words", stop_words=stopwords.ZONE_STOP_WORDS)
    n_zones = d.agg(F.count_distinct("zone").alias("n_docs"))
    vocab, zone_counts = X.heavy_counts(X.counted_tokens(tokens), n_zones, min_df=1, max_features=ZONE_MAX_FEATURES, one_row_docs=False,
                                        places=X.occurrences(tokens))
    w = X.tfidf(zone_counts, vocab).withColumnRenamed("doc", "zone")
    return X.top_terms(w.withColumnRenamed("weight", "score"), ["zone"], ZONE_TOP)


def q_zone_distinctive_terms(spark, sf_dir):
    z = zone_scores(spark, sf_dir)
    return z.select("zone", "term", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def q_all_zone_terms(spark, sf_dir):
    """Summed zone weights / number of zones, top 40 (a top-k report)."""
    z = zone_scores(spark, sf_dir)
    n = z.agg(F.count_distinct("zone").alias("n_zones"))
    merged = z.groupBy("term").agg(F.sum("score").alias("s")).crossJoin(F.broadcast(n))  # one-row frame
    merged = merged.select("term", (F.col("s") / F.col("n_zones")).alias("score"))
    top = merged.orderBy(F.desc("score"), "term").limit(ALL_ZONES_TOP)
    return top.select("term", F.round("score", 6).alias("score"))


def q_min_support_filter(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "text", "source")
    return X.class_support(d, "text", "source", MIN_CLASS_SIZE)


def labelled(spark, sf_dir) -> DataFrame:
    """(doc_id, source, true_label, pred_label) for the evaluation stand-in."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    j = lab.join(d, "doc_id")
    true = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    pred = F.when(F.col("n_chars") < 1000, "poor").when(F.col("n_chars") < 8000, "good").otherwise("toxic")
    return j.select("doc_id", "source", true.alias("true_label"), pred.alias("pred_label"))


def q_confusion_matrix(spark, sf_dir):
    return EV.confusion_long(labelled(spark, sf_dir), EVAL_LABELS)


def q_confusion_wide(spark, sf_dir):
    return EV.confusion_matrix(labelled(spark, sf_dir), EVAL_LABELS)


def q_classification_report(spark, sf_dir):
    rep = EV.classification_report(EV.confusion_long(labelled(spark, sf_dir), EVAL_LABELS))
    return rep.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "support")])


def q_report_by_f1(spark, sf_dir):
    """B12 + L3: class rows only (summary rows excluded), best F1 first."""
    rep = EV.classification_report(EV.confusion_long(labelled(spark, sf_dir), EVAL_LABELS))
    return EV.class_rows_by_f1(rep).select("class", F.round("f1_score", 6).alias("f1_score"),
                                            F.round("support", 6).alias("support"))


def q_top_confusions(spark, sf_dir):
    return EV.top_confusions(EV.confusion_long(labelled(spark, sf_dir), EVAL_LABELS))


def usable_docs(spark, sf_dir) -> DataFrame:
    return X.usable_with_support(docs(spark, sf_dir), "text", "source", MIN_CLASS_SIZE)[0]


def q_stratified_split(spark, sf_dir):
    s = EV.stratified_split(usable_docs(spark, sf_dir), "source", "doc_id")
    train = EV.assign_folds(s.filter(F.col("split") == "train"), "source", "doc_id")
    test = s.filter(F.col("split") == "test").withColumn("fold", F.lit(None).cast("int"))
    return train.unionByName(test).select("doc_id", "source", "split", "fold")


def q_split_counts(spark, sf_dir):
    """Exact per-class sizes of the split and folds (independent of the hash)."""
    s = q_stratified_split(spark, sf_dir)
    return s.groupBy("source", "split", "fold").agg(F.count(F.lit(1)).cast("long").alias("n"))


def q_seeded_sample(spark, sf_dir):
    return EV.seeded_sample(docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 100)


QUERIES = {
    "text_normalise": q_text_normalise,
    "tfidf_terms": q_tfidf_terms,
    "slice_vocabulary": q_slice_vocabulary,
    "slice_term_list": q_slice_term_list,
    "zone_distinctive_terms": q_zone_distinctive_terms,
    "all_zone_terms": q_all_zone_terms,
    "min_support_filter": q_min_support_filter,
    "confusion_matrix": q_confusion_matrix,
    "confusion_wide": q_confusion_wide,
    "classification_report": q_classification_report,
    "top_confusions": q_top_confusions,
    "report_by_f1": q_report_by_f1,
    "stratified_split": q_stratified_split,
    "split_counts": q_split_counts,
    "seeded_sample": q_seeded_sample,
}

# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB; RE2 regexes spelled with the same classes)
# ---------------------------------------------------------------------------

_WS = r"\p{Z}\t\n\x0B\f\r"


def _norm_sql(col: str, strip_urls: bool = True, accents: bool = True) -> str:
    t = f"lower({col})"
    if strip_urls:
        t = f"regexp_replace({t}, 'http\\S+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g')"
    t = f"trim(regexp_replace({t}, '[{_WS}]+', ' ', 'g'))"
    if accents:
        t = f"translate({t}, '{T.ACCENT_SRC}', '{T.ACCENT_DST}')"
    return t


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + "]"


def _terms_sql(norm: str, stop=None) -> str:
    tk = f"list_filter(string_split({norm}, ' '), lambda w: length(w) >= 2)"
    if stop:
        tk = f"list_filter({tk}, lambda w: NOT list_contains({_sql_list(stop)}, w))"
    return f"list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))", tk


def _counts_sql(group: str, norm: str, stop=None, src: str = "documents", id_col: str = "doc_id") -> str:
    terms, tk = _terms_sql("norm", stop)
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}doc, term, count(*) AS tf FROM (
  SELECT {g}doc, unnest({terms}) AS term FROM (
    SELECT {g}{id_col} AS doc, {tk} AS tk FROM (SELECT *, {norm} AS norm FROM {src}) n0) n1) n2
GROUP BY ALL"""


_D = "CAST(1.0 AS DOUBLE)"


def _tfidf_sql(counts: str, vocab: str, group: str = "") -> str:
    using = f"{group}, term" if group else "term"
    part = f"{group}, doc" if group else "doc"
    g = f"{group}, " if group else ""
    return f"""
SELECT {g}doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY {part})) AS weight FROM (
  SELECT {g}doc, term, ({_D} + ln(CAST(tf AS DOUBLE))) * (ln(({_D} + n_docs) / ({_D} + df)) + {_D}) AS w
  FROM ({counts}) c JOIN ({vocab}) v USING ({using})) t"""


_TC = _counts_sql("", _norm_sql("text"))
_VOC = f"""
SELECT term, df, total, n_docs FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM ({_TC}) c GROUP BY term) s,
  (SELECT count(*) AS n_docs FROM documents) n
WHERE df >= {MIN_DF} AND df <= CAST({MAX_DF} AS DOUBLE) * n_docs
ORDER BY total DESC, term LIMIT {MAX_FEATURES}"""

_SLICE_TC = _counts_sql("lang", _norm_sql("text", accents=False), stopwords.english())
_SLICE_N = "(SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)"
_SLICE_VOC = f"""
SELECT lang, term, df, total, n_docs FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) AS rk FROM (
    SELECT lang, term, count(*) AS df, sum(tf) AS total FROM ({_SLICE_TC}) c GROUP BY lang, term) s
  JOIN {_SLICE_N} n USING (lang) WHERE df >= {MIN_DF} AND df <= CAST(1.0 AS DOUBLE) * n_docs) r
WHERE rk <= {SLICE_MAX_FEATURES}"""
_SLICE_TOP = f"""
SELECT lang, term, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM (
    SELECT lang, term, sum(weight) / any_value(n_docs) AS score
    FROM ({_tfidf_sql(_SLICE_TC, _SLICE_VOC, 'lang')}) w JOIN {_SLICE_N} n USING (lang) GROUP BY lang, term) s
  WHERE score > 0) r WHERE rank <= {SLICE_TOP}"""

_ZONE_TC_DOC = _counts_sql("source", _norm_sql("text", strip_urls=False, accents=False), stopwords.ZONE_STOP_WORDS)
_ZONE_TC = f"SELECT source AS doc, term, sum(tf) AS tf FROM ({_ZONE_TC_DOC}) c GROUP BY source, term"
_ZONE_VOC = f"""
SELECT term, df, total, n_docs FROM (
  SELECT term, count(*) AS df, sum(tf) AS total FROM ({_ZONE_TC}) c GROUP BY term) s,
  (SELECT count(DISTINCT source) AS n_docs FROM documents) n
WHERE df >= 1 AND df <= CAST(1.0 AS DOUBLE) * n_docs
ORDER BY total DESC, term LIMIT {ZONE_MAX_FEATURES}"""
_ZONE_TOP = f"""
SELECT zone, term, score, rank FROM (
  SELECT doc AS zone, term, weight AS score,
         row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS rank
  FROM ({_tfidf_sql(_ZONE_TC, _ZONE_VOC)}) w WHERE weight > 0) r WHERE rank <= {ZONE_TOP}"""

_LABELLED = """
SELECT l.doc_id, d.source,
       CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS true_label,
       CASE WHEN n_chars < 1000 THEN 'poor' WHEN n_chars < 8000 THEN 'good' ELSE 'toxic' END AS pred_label
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
_LAB = "(SELECT unnest(['good', 'poor', 'toxic']) AS label)"
_CONF = f"""
SELECT t.label AS true_label, p.label AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM {_LAB} t CROSS JOIN {_LAB} p
LEFT JOIN (SELECT true_label, pred_label, count(*) AS n FROM ({_LABELLED}) x GROUP BY ALL) c
  ON c.true_label = t.label AND c.pred_label = p.label"""
_PER = f"""
SELECT class, tp, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CAST(support AS DOUBLE) AS support
FROM (SELECT true_label AS class, n AS tp FROM ({_CONF}) c WHERE true_label = pred_label) a
JOIN (SELECT true_label AS class, sum(n) AS support FROM ({_CONF}) c GROUP BY 1) b USING (class)
JOIN (SELECT pred_label AS class, sum(n) AS n_pred FROM ({_CONF}) c GROUP BY 1) d USING (class)"""
_PER_F1 = f"""
SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
FROM ({_PER}) p"""
_USABLE = f"""
SELECT * FROM documents WHERE coalesce(length(trim(text)) > 5, false) AND source IS NOT NULL"""
_USABLE_COUNTS = f"SELECT source, count(*) AS n FROM ({_USABLE}) u GROUP BY source"

ORACLE = {
    "text_normalise": f"SELECT doc_id, {_norm_sql('text')} AS norm FROM documents",
    "tfidf_terms": f"SELECT doc AS doc_id, term, round(weight, 6) AS weight FROM ({_tfidf_sql(_TC, _VOC)}) w",
    "slice_vocabulary": f"""
SELECT lang, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank,
       CAST(trunc(12.0 + (score - min(score) OVER (PARTITION BY lang))
             / (max(score) OVER (PARTITION BY lang) - min(score) OVER (PARTITION BY lang) + 1e-9) * 36.0) AS INTEGER) AS size
FROM ({_SLICE_TOP}) t""",
    "slice_term_list": f"""
SELECT lang, CAST(rank AS INTEGER) AS rank, term, CAST(printf('%.3f', score) AS DOUBLE) AS weight FROM ({_SLICE_TOP}) t""",
    "zone_distinctive_terms": f"SELECT zone, term, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_ZONE_TOP}) z",
    "all_zone_terms": f"""
SELECT term, round(s / n, 6) AS score FROM (
  SELECT term, sum(score) AS s FROM ({_ZONE_TOP}) z GROUP BY term) a,
  (SELECT count(DISTINCT zone) AS n FROM ({_ZONE_TOP}) z) b
ORDER BY s / n DESC, term LIMIT {ALL_ZONES_TOP}""",
    "min_support_filter": f"""
SELECT source, CAST(n AS BIGINT) AS n, n >= {MIN_CLASS_SIZE} AS viable FROM ({_USABLE_COUNTS}) c""",
    "confusion_matrix": _CONF,
    "confusion_wide": f"""
SELECT true_label, sum(n) FILTER (WHERE pred_label = 'good') AS good, sum(n) FILTER (WHERE pred_label = 'poor') AS poor,
       sum(n) FILTER (WHERE pred_label = 'toxic') AS toxic FROM ({_CONF}) c GROUP BY true_label""",
    "classification_report": f"""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(support, 6) AS support FROM (
  SELECT class, precision, recall, f1_score, support FROM ({_PER_F1}) a
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support) FROM ({_PER_F1}) b
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM ({_PER_F1}) c
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), sum(support) FROM ({_PER_F1}) d) r""",
    "report_by_f1": f"""
SELECT class, round(f1_score, 6) AS f1_score, round(support, 6) AS support FROM ({_PER_F1}) p""",
    "top_confusions": f"""
SELECT true_label, pred_label, n FROM ({_CONF}) c WHERE true_label <> pred_label AND n > 0
ORDER BY n DESC, true_label, pred_label LIMIT 10""",
    "split_counts": f"""
WITH k AS (SELECT source, n FROM ({_USABLE_COUNTS}) c WHERE n >= {MIN_CLASS_SIZE}),
t AS (SELECT source, CAST(round(n * 0.2) AS BIGINT) AS n_test, n - CAST(round(n * 0.2) AS BIGINT) AS n_train FROM k),
f AS (SELECT source, fold, CAST(n_train // 5 + CASE WHEN fold <= n_train % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
      FROM t, range(1, 6) r(fold))
SELECT source, 'test' AS split, CAST(NULL AS INTEGER) AS fold, n_test AS n FROM t WHERE n_test > 0
UNION ALL SELECT source, 'train', CAST(fold AS INTEGER), n FROM f WHERE n > 0""",
    "stratified_split": f"""
WITH u AS ({_USABLE}),
r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n,
             row_number() OVER (PARTITION BY source ORDER BY {draw_sql(42, 'doc_id')}, doc_id) AS rk FROM u),
s AS (SELECT doc_id, source, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r WHERE n >= {MIN_CLASS_SIZE})
SELECT doc_id, source, split, CAST(ntile(5) OVER (PARTITION BY source ORDER BY {draw_sql(43, 'doc_id')}, doc_id) AS INTEGER) AS fold
FROM s WHERE split = 'train'
UNION ALL SELECT doc_id, source, split, NULL FROM s WHERE split = 'test'""",
    "seeded_sample": f"""
SELECT doc_id, source FROM documents ORDER BY {draw_sql(42, 'doc_id')}, doc_id LIMIT 100""",
}
