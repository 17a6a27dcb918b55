"""Operator 2: toxic passages as maximum-scoring segments of token log-odds.

*Log-odds.* From labelled training rows: for each word, and for its first five and four
letters, the number of distinct texts of either class that hold it. Each count gets a
Dirichlet prior: a stem's prior is the share of toxic texts, a word's prior is its stem's
posterior. The lexicon keeps the features whose log-odds are above ``MIN_LOG_ODDS`` by two
standard errors. A token scores as its word, else its longer, else its shorter stem; all
other tokens score the (small, negative) log-odds of not being in the lexicon.

*Segments.* One linear scan a document finds all maximal scoring segments (every disjoint
run of tokens that no extension or cut improves); only lexicon tokens and the gaps between
them are touched.

*Extreme values.* The best segment S of n tokens is turned into x = S - ln(n), whose
distribution over non-toxic texts with a segment is fitted by a Gumbel law; -ln of its tail
probability (0 without a segment) goes through a one-variable logistic fit, which gives the
score. Both fits have a weak prior, the same at every size, which stands alone where no text speaks. A passage is significant if its
own tail probability is below ``SIGNIFICANT``.

The calibration scores the training rows with crc32 remainder 3 by a lexicon of those with 0
and 1; the lexicon in use is then counted over all three. Rows with remainder 2 are held out. The fit reads at most about ``MAX_TRAIN`` labelled rows (a hash of
the id decides which), and the lexicon holds at most ``MAX_FEATURES`` entries, which bounds
what is sent to the tasks. Scoring is one narrow pass over every whole text.

Defined cases: null or empty text scores as a text without lexicon tokens; a labels table
without toxic or without other rows gives an empty lexicon and score 0; null labels and null
ids train nothing; of repeated label rows any toxic one counts; rows keep their
multiplicity; a null doc_id is not held out; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import batched, ship, staged, without_clash

MAX_TRAIN = 60_000
MAX_FEATURES = 30_000
MIN_LOG_ODDS = 1.0
MIN_TOXIC = 3
PRIOR = 2.0
THRESHOLD = 0.3
SIGNIFICANT = 0.01
STEMS = (5, 4)
WORD = re.compile(r"[^\W\d_]+")
MEMO = 100_000
#: Weight, in texts, of the law (0, 1) of the best segment before any text is seen.
LAW_PRIOR = 2.0


def features(words) -> set[str]:
    """Words and stems of a text; a stem is marked by its length."""
    return {w for w in words} | {f"{k}:{w[:k]}" for w in words for k in STEMS if len(w) > k}


def fold(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part (0: lexicon, 1: calibration) of distinct labelled texts."""
    marks = (labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 2))
    n = max(1, marks.count())
    share = int(min(1.0, MAX_TRAIN / n) * (1 << 30))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null")
    # About MAX_TRAIN rows at most, whatever the tables' size: sent to the scan, so that no other row's text is shuffled.
    return rows.join(F.broadcast(marks), "doc_id").select("text", "toxic", (fold() == 3).cast("int").alias("part"))


def count_features(train: DataFrame) -> DataFrame:
    """f, part, clean, toxic: number of distinct texts with the feature; '#texts' and
    '#words' hold the totals."""
    def run(batches):
        for batch in batches:
            counts: dict[tuple[int, int], Counter] = {(p, t): Counter() for p in (0, 1) for t in (0, 1)}
            for text, toxic, part in zip(*(batch.column(i) for i in range(3))):
                text, toxic, part = text.as_py(), toxic.as_py(), part.as_py()
                words = WORD.findall(text.lower())
                c = counts[part, min(max(toxic, 0), 1)]
                c.update(features(words))
                c["#texts"] += 1
                c["#words"] += len(words)
            for part in (0, 1):
                clean, toxic = counts[part, 0], counts[part, 1]
                names = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([part] * len(names), pa.int32()),
                     pa.array([clean[w] for w in names], pa.int64()), pa.array([toxic[w] for w in names], pa.int64())],
                    names=["f", "part", "clean", "toxic"])

    texts = train.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("part").alias("part"))
    return texts.mapInArrow(batched(run), "f string, part int, clean long, toxic long").groupBy("f", "part").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit_lexicon(counted: DataFrame) -> tuple[dict[str, float], float]:
    """(positive log-odds by feature, log-odds of a token outside the lexicon)."""
    counted = counted.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r["f"]: r for r in counted.where("f in ('#texts', '#words')").collect()}
    if "#texts" not in totals or not totals["#texts"]["toxic"] or not totals["#texts"]["clean"]:
        return {}, -1e-3
    n_toxic, n_clean = totals["#texts"]["toxic"], totals["#texts"]["clean"]
    base = n_toxic / (n_toxic + n_clean)
    kept = (counted.where(f"not startswith(f, '#') and toxic >= {MIN_TOXIC} and toxic * {n_clean} > clean * {n_toxic}")
            .orderBy(F.col("toxic") / (F.col("clean") + 1) * -1, F.col("toxic").desc(), "f").limit(MAX_FEATURES).collect())
    counts = {r["f"]: (r["toxic"], r["clean"]) for r in kept}
    odds0 = math.log(base / (1 - base))
    lexicon: dict[str, float] = {}
    for f, (toxic, clean) in counts.items():
        stem = next((counts[s] for k in STEMS if (s := f"{k}:{f[:k]}") in counts), None) if f[1:2] != ":" else None
        prior = base if stem is None else (stem[0] + PRIOR * base) / (stem[0] + stem[1] + PRIOR)
        a, b = toxic + PRIOR * prior, clean + PRIOR * (1 - prior)
        value, error = math.log(a / b) - odds0, math.sqrt(1 / a + 1 / b)
        if value - 2 * error > MIN_LOG_ODDS:
            lexicon[f] = value
    # Expected number of lexicon words in a text, from the document counts of words alone.
    hits = [sum(c[i] for f, c in counts.items() if f in lexicon and f[1:2] != ":") + 1 for i in (0, 1)]
    share = [min(0.5, hits[0] / (totals["#words"]["toxic"] + 2)), min(0.5, hits[1] / (totals["#words"]["clean"] + 2))]
    return lexicon, min(-1e-3, math.log((1 - share[0]) / (1 - share[1])))


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [first, last] of a sequence that has the positive
    scores ``hits`` at ascending places and ``gap`` (negative) everywhere else."""
    out: list[tuple[int, int, float, float]] = []  # first, last, cumulative score before and after
    total, at = 0.0, 0
    for place, score in hits:
        total += gap * (place - at)
        first, before = place, total
        total += score
        at = place + 1
        last, after = place, total
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= after:
                break
            first, before = out[j][0], out[j][2]
            del out[j:]
        out.append((first, last, before, after))
    return [(a, b, after - before) for a, b, before, after in out]


EULER = 0.5772156649


class Scanner:
    """Token scores of one lexicon, remembered by word."""

    def __init__(self, lexicon: dict[str, float], gap: float):
        self.lexicon, self.gap, self.memo = lexicon, gap, {}

    def score(self, word: str) -> float:
        if len(self.memo) > MEMO:
            self.memo.clear()
        value = self.lexicon.get(word)
        for k in STEMS:
            if value is None and len(word) > k:
                value = self.lexicon.get(f"{k}:{word[:k]}")
        self.memo[word] = value = value or 0.0
        return value

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall((text or "").lower())
        memo = self.memo
        scores = [memo[w] if w in memo else self.score(w) for w in words]
        return len(words), segments([(i, s) for i, s in enumerate(scores) if s > 0], self.gap)


def statistic(n: int, found: list[tuple[int, int, float]]) -> float | None:
    """x of the best segment; None for a text without segments, whatever its length."""
    return max(s for *_, s in found) - math.log(n) if found else None


def tail(x: float | None, law: tuple[float, float]) -> float:
    """-ln P(X >= x) under the Gumbel law (location, scale); 0 without a segment."""
    if x is None:
        return 0.0
    e = math.exp(min(50.0, -(x - law[0]) / law[1]))
    return min(60.0, -math.log(-math.expm1(-e))) if e > 1e-26 else 60.0


def calibrate(train: DataFrame, lexicon: dict[str, float], gap: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """(Gumbel law of x over non-toxic texts, logistic intercept and slope). The driver gets
    a histogram of x in steps of 1/8 for either class."""
    def run(batches):
        scanner = Scanner(lexicon, gap)
        for batch in batches:
            stats = [statistic(*scanner.scan(t)) for t in (v.as_py() for v in batch.column(0))]
            bins = [None if x is None else round(8 * min(200.0, max(-30.0, x))) for x in stats]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column(1)], names=["bin", "toxic"])

    bins = train.where("part = 1").select("text", "toxic").mapInArrow(batched(run), "bin long, toxic int").groupBy("bin").agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("clean")).collect()
    bins = [(None if r["bin"] is None else r["bin"] / 8, r["toxic"], r["clean"]) for r in bins]
    bins.sort(key=lambda b: (b[0] is not None, b[0] or 0.0))
    found = [b for b in bins if b[0] is not None]
    clean = sum(b[2] for b in found)
    # Moments of the Gumbel law, those of the law (0, 1) first with the weight of LAW_PRIOR texts.
    weight = clean + LAW_PRIOR
    mean = (sum(b[0] * b[2] for b in found) + LAW_PRIOR * EULER) / weight
    variance = (sum((b[0] - mean) ** 2 * b[2] for b in found) + LAW_PRIOR * (math.pi**2 / 6 + (EULER - mean) ** 2)) / weight
    scale = max(0.25, math.sqrt(6 * variance) / math.pi)
    law = (mean - EULER * scale, scale)
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps; a weak pull to (-1, 1) keeps separable data finite
        g, h = [-0.5 * (a + 1), -0.5 * (b - 1)], [[0.5, 0.0], [0.0, 0.5]]
        for x, toxic, other in bins:
            t = tail(x, law)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * t))))
            e, w = toxic - (toxic + other) * p, (toxic + other) * p * (1 - p)
            g[0] += e
            g[1] += e * t
            h[0][0] += w
            h[0][1] += w * t
            h[1][1] += w * t * t
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        da, db = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
        norm = max(1.0, math.hypot(da, db) / 2)
        a, b = a + da / norm, b + db / norm
        if abs(da) + abs(db) < 1e-9:
            break
    return law, (a, max(b, 1e-6))


class Model:
    """What a fit gives: lexicon, gap score, Gumbel law, logistic fit."""

    def __init__(self, lexicon, gap, law, logit):
        self.lexicon, self.gap, self.law, self.logit = lexicon, gap, law, logit


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    train = staged(training_rows(docs, labels), "toxic-train")
    counted = staged(count_features(train), "toxic-counts")
    lexicon, gap = fit_lexicon(counted)
    # The calibration rows must be new to the lexicon that scores them.
    half, half_gap = fit_lexicon(counted.where("part = 0"))
    return Model(lexicon, gap, *calibrate(train, half, half_gap))


PASSAGES = "array<struct<first:long,last:long,score:double>>"


def score_texts(docs: DataFrame, model: Model, column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus score, predicted, passages (significant ones, in words of the
    lower-cased text), all named with ``prefix``."""
    from pyspark.sql.types import StructType

    lexicon, gap, law, (a, b) = model.lexicon, model.gap, model.law, model.logit
    place = docs.columns.index(column)
    names = [f"{prefix}{n}" for n in ("score", "predicted", "passages")]
    schema = StructType(docs.schema.fields + list(StructType.fromDDL(f"{names[0]} double, {names[1]} int, {names[2]} {PASSAGES}")))
    passage_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        scanner = Scanner(lexicon, gap)
        need = -math.log(SIGNIFICANT)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(place):
                n, found = scanner.scan(text.as_py())
                t = tail(statistic(n, found), law)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * t)))) if lexicon else 0.0)
                passages.append([{"first": i, "last": j, "score": s} for i, j, s in found if tail(s - math.log(max(n, 1)), law) >= need])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                 pa.array(passages, passage_type)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(batched(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, toxic_words."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    rows = rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return score_texts(rows, fit(docs, labels)).select(
        "doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"),
        F.expr("aggregate(passages, 0L, (s, p) -> s + p.last - p.first + 1)").alias("toxic_words"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay."""
    def work(rows):
        return score_texts(rows, fit(rows, labels), prefix="__toxic_").where("__toxic_predicted = 0").select(*rows.columns)

    return without_clash(docs, work)
