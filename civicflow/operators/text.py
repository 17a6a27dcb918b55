"""TF-IDF as a long (doc, term, weight) table and the text-side reports
(S11-S12, M7, M16-M18, W10, G24, B5-B6, J6-J7).

Weighting (the vectoriser convention the reference uses): 1-2 word grams of
tokens with >= 2 word characters, document-frequency pruning (min_df count,
max_df fraction), the ``max_features`` terms with the largest corpus counts,
tf' = 1 + ln(tf), idf = ln((1 + n) / (1 + df)) + 1, then L2 per document.

Scale: tokenising, n-gramming and the counting of a document's terms are array
functions on its row (``row_terms``: no exchange, no text shuffled). The vocabulary
comes from ``heavy_vocabulary`` (over words written once by ``written_tokens``): hash buckets bound every term's count from above, and
only the terms of buckets that can reach the vocabulary are counted exactly, so the rare
terms (most of a corpus's bigrams) never cross a shuffle. The vocabulary is bounded by
``max_features`` so it is broadcast; per-group rankings use a salted two-stage top-k (no
whole group is sorted in one task).
An optional ``group`` column runs independent TF-IDF models per corpus slice.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from civicflow.functions import text as T
from civicflow.operators.common import broadcast_if_small, top_k_per_group
from civicflow.session import scratch_path

# Hash buckets of ``heavy_vocabulary``: a parameter of speed only, the result is exact for any.
TERM_BUCKETS = 1 << 20
# Buckets counted in its first pass, at least (more for vocabularies that are larger).
FIRST_BUCKETS = 4096
# A frame of at most this many (group, bucket) rows, 16 bytes and a short name each, is broadcast.
BROADCAST_BUCKETS = 1 << 20


def normalise(docs: DataFrame, text_col: str, strip_accents: bool = True) -> Column:
    t = T.normalise_text(F.col(text_col))
    return T.strip_accents(t) if strip_accents else t


def words(docs: DataFrame, text_col: str, strip_accents: bool = True) -> Column:
    """``normalise`` for counting terms: the same tokens, without the pass that drops punctuation."""
    t = T.word_text(F.col(text_col))
    return T.strip_accents(t) if strip_accents else t


def ngram_terms(tokens: Column, max_n: int = 2) -> Column:
    """Unigrams plus, when max_n == 2, space-joined neighbouring pairs."""
    if max_n == 1:
        return tokens
    return F.concat(tokens, T.bigrams(tokens))


def document_tokens(
    docs: DataFrame,
    id_col: str,
    norm_col: str,
    group: list[str] | None = None,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """(group..., doc, _tok): the array of a document's words that are not stop words, in order.
    ``norm_col`` holds normalised text, or its words already (``written_words``)."""
    group = group or []
    cut = F.col(norm_col) if isinstance(docs.schema[norm_col].dataType, ArrayType) else T.tokens(F.col(norm_col))
    toks = docs.select(*group, F.col(id_col).alias("doc"), cut.alias("_tok"))
    if stop_words:
        # Stop words go before pairing (as the reference vectoriser does); the JVM
        # remover does a hash-set lookup per token.
        remover = StopWordsRemover(inputCol="_tok", outputCol="_kept", stopWords=sorted(set(stop_words)),
                                   caseSensitive=True)
        toks = toks.withColumn("_tok", F.coalesce("_tok", F.array().cast("array<string>")))  # it takes no null
        toks = remover.transform(toks).drop("_tok").withColumnRenamed("_kept", "_tok")
    return toks


def written_tokens(
    docs: DataFrame,
    id_col: str,
    norm_col: str,
    group: list[str] | None = None,
    stop_words: list[str] | None = None,
) -> DataFrame:
    """``document_tokens`` written under the shared checkpoint folder and read back: the texts are scanned
    and cut into words once, whatever the number of passes over the words (less than the text in bytes)."""
    toks = document_tokens(docs, id_col, norm_col, group, stop_words)
    path = scratch_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    toks.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(toks.schema).parquet(path)


def written_words(docs: DataFrame, norm_col: str) -> DataFrame:
    """``docs`` with the words of ``norm_col`` in its place, written under the shared checkpoint folder and read back."""
    rows = docs.withColumn(norm_col, T.tokens(F.col(norm_col)))
    path = scratch_path(docs.sparkSession, f"words-{uuid.uuid4().hex}")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def occurrences(tokens: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., term): a row for each place of a term (1-2 words) in ``document_tokens``, for sums
    that need no count by document. Each word meets the next one in the row: no sort, no lambda."""
    following = F.expr("slice(_tok, 2, greatest(size(_tok) - 1, 0))")
    pairs = tokens.select(*(group or []), F.inline(F.arrays_zip(F.col("_tok").alias("_a"), following.alias("_b"))).alias("_a", "_b"))
    terms = F.array("_a", F.concat("_a", F.lit(" "), "_b"))  # no pair after a document's last word
    return pairs.select(*(group or []), F.explode(terms).alias("term")).where("term IS NOT NULL")


def row_terms(
    docs: DataFrame,
    id_col: str,
    norm_col: str,
    group: list[str] | None = None,
    stop_words: list[str] | None = None,
    max_n: int = 2,
) -> DataFrame:
    """(group..., doc, term, tf) counted inside each row: the terms are sorted and each run's
    length is its count, so the plan has no exchange. A null text has no terms. Rows that
    share a ``doc`` keep their counts apart (``heavy_vocabulary`` and ``tfidf`` add them up
    where ``one_row_docs`` is false)."""
    return counted_tokens(document_tokens(docs, id_col, norm_col, group, stop_words), group, max_n)


def counted_tokens(tokens: DataFrame, group: list[str] | None = None, max_n: int = 2) -> DataFrame:
    """``row_terms`` of ``document_tokens``."""
    group = group or []
    rows = tokens.select(*group, "doc", ngram_terms(F.col("_tok"), max_n).alias("_terms"))
    rows = rows.select(*group, "doc", F.sort_array("_terms").alias("_terms"))
    at = F.col("_terms")
    # No filter on empty arrays: it would be pushed to the scan, with the whole tokenising in it.
    first = F.when(F.size(at) > 0, F.filter(
        F.sequence(F.lit(0), F.size(at) - 1),
        lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1)),
    ))
    rows = rows.select(*group, "doc", "_terms", first.alias("_first"))
    runs = F.transform(
        F.col("_first"),
        lambda i, n: F.struct(
            F.get(at, i).alias("term"),
            (F.coalesce(F.get(F.col("_first"), n + 1), F.size(at)) - i).cast("long").alias("tf"),
        ),
    )
    return rows.select(*group, "doc", F.inline(runs))


def term_counts(
    docs: DataFrame,
    id_col: str,
    norm_col: str,
    group: list[str] | None = None,
    stop_words: list[str] | None = None,
    max_n: int = 2,
) -> DataFrame:
    """(group..., doc, term, tf) from normalised text, rows of one ``doc`` summed."""
    rows = row_terms(docs, id_col, norm_col, group, stop_words, max_n)
    return rows.groupBy(*(group or []), "doc", "term").agg(F.sum("tf").alias("tf"))


def vocabulary(
    counts: DataFrame,
    n_docs: DataFrame,
    group: list[str] | None = None,
    min_df: int = 2,
    max_df: float | int = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """(group..., term, df, total) kept after df pruning and the max_features cut
    (largest corpus count first, ties by term)."""
    group = group or []
    stats = counts.groupBy(*group, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
    )
    # Ungrouped: a one-row frame. Grouped: one row per slice, left to AQE's size check.
    stats = stats.join(n_docs, group) if group else stats.crossJoin(F.broadcast(n_docs))
    hi = F.lit(float(max_df)) if isinstance(max_df, int) else F.lit(float(max_df)) * F.col("n_docs")
    stats = stats.filter((F.col("df") >= min_df) & (F.col("df") <= hi))
    if max_features is not None:
        order = [F.desc("total"), F.asc("term")]
        if group:
            stats = top_k_per_group(stats, group, order, max_features, ["term"]).drop("rank")
        else:
            stats = stats.orderBy(*order).limit(max_features)
    return stats.select(*group, "term", "df", "total", "n_docs")


def heavy_vocabulary(
    counts: DataFrame,
    n_docs: DataFrame,
    group: list[str] | None = None,
    min_df: int = 2,
    max_df: float | int = 1.0,
    max_features: int = 10000,
    one_row_docs: bool = True,
    buckets: int = TERM_BUCKETS,
    places: DataFrame | None = None,
) -> DataFrame:
    """``vocabulary`` with the ``max_features`` cut, the same rows, without counting every term.

    1. Term counts are summed per hash bucket (at most ``buckets`` rows a group and task
       cross the shuffle). A bucket's sum bounds the count of each of its terms.
    2. The terms of the largest buckets are counted exactly, pruned and cut. The smallest
       count kept (0 where fewer than ``max_features`` are found) is a floor: a term of a
       bucket below it cannot enter.
    3. Buckets that reach the floor and were not counted yet are counted too, and the cut
       is made over both. Any term outside has a smaller count than the floor: the result
       is exact, ties included.

    ``counts`` is computed once a pass (from the scan, with no checkpoint); the buckets and the cut
    vocabularies, both bounded, are checkpointed. The result is too. No count by document is written
    (``heavy_counts`` writes those of steps 2 and 3 as Parquet, for its second result). ``places``
    (``occurrences`` of the same tokens) spares the buckets the count by document."""
    return _heavy(counts, places, n_docs, group, min_df, max_df, max_features, one_row_docs, buckets, keep=False)[0]


def heavy_counts(
    counts: DataFrame,
    n_docs: DataFrame,
    group: list[str] | None = None,
    min_df: int = 2,
    max_df: float | int = 1.0,
    max_features: int = 10000,
    one_row_docs: bool = True,
    buckets: int = TERM_BUCKETS,
    places: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``heavy_vocabulary`` and the (group..., doc, term, tf) of its terms, from the written rows that it
    was found in: the texts are read for the buckets and once for the counts. ``places`` (``occurrences``
    of the same tokens) spares the buckets the count by document."""
    vocab, parts = _heavy(counts, places, n_docs, group, min_df, max_df, max_features, one_row_docs, buckets)
    rows = parts[0]
    for part in parts[1:]:  # the first buckets and the rest: no term is in both
        rows = rows.unionByName(part)
    terms = [*(group or []), "term"]
    return vocab, rows.join(broadcast_if_small(vocab.select(*terms), BROADCAST_BUCKETS), terms, "left_semi")


def _heavy(counts, places, n_docs, group, min_df, max_df, max_features, one_row_docs, buckets, keep=True) -> tuple[DataFrame, list[DataFrame]]:
    """The vocabulary and, to ``keep``, the written (group..., doc, term, tf) of the buckets that were counted exactly."""
    group, spark, written = group or [], counts.sparkSession, []
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    keyed = counts.withColumn("_hash", bucket)
    if places is None:
        sums = keyed.groupBy(*group, "_hash").agg(F.sum("tf").alias("_bound"))
    else:
        sums = places.select(*group, bucket.alias("_hash")).groupBy(*group, "_hash").agg(F.count(F.lit(1)).alias("_bound"))
    sums = sums.checkpoint()
    ranked = max(FIRST_BUCKETS, 4 * max_features)
    order = [F.desc("_bound"), F.asc("_hash")]
    if group:
        chosen = top_k_per_group(sums, group, order, ranked, ["_hash"]).select(*group, "_hash")
    else:
        chosen = sums.orderBy(*order).limit(ranked).select("_hash")
    chosen = chosen.checkpoint()
    on = [*group, "_hash"]

    def exact(which: DataFrame) -> DataFrame:
        rows = keyed.join(broadcast_if_small(which, BROADCAST_BUCKETS), on, "left_semi")
        if not one_row_docs:
            rows = rows.groupBy(*group, "doc", "term").agg(F.sum("tf").alias("tf"))
        if not keep:
            return vocabulary(rows, n_docs, group, min_df, max_df, max_features)
        path = scratch_path(spark, f"counts-{uuid.uuid4().hex}")  # terms are dictionary-encoded, a document's rows stand together
        rows.select(*group, "doc", "term", "tf").write.parquet(path)
        rows = spark.read.schema(rows.select(*group, "doc", "term", "tf").schema).parquet(path)
        written.append(rows)
        return vocabulary(rows, n_docs, group, min_df, max_df, max_features)

    found = exact(chosen).checkpoint()
    full = F.count(F.lit(1)) >= max_features
    if group:
        floors = found.groupBy(*group).agg(F.when(full, F.min("total")).alias("_floor"))
        rest = sums.join(F.broadcast(chosen), on, "left_anti")
        rest = rest.join(broadcast_if_small(floors, BROADCAST_BUCKETS), group, "left")
        rest = rest.filter(F.col("_bound") >= F.coalesce("_floor", F.lit(0)))
    else:
        floor = found.agg(F.when(full, F.min("total"))).first()[0] or 0
        rest = sums.join(F.broadcast(chosen), on, "left_anti").filter(F.col("_bound") >= floor)
    rest = rest.select(*on).checkpoint()
    if rest.isEmpty():
        return found, written
    both = found.unionByName(exact(rest))
    order = [F.desc("total"), F.asc("term")]
    if group:
        cut = top_k_per_group(both, group, order, max_features, ["term"]).drop("rank")
    else:
        cut = both.orderBy(*order).limit(max_features)
    return cut.checkpoint(), written


def left_out_vocabularies(
    tokens: DataFrame,
    part: str,
    min_df: int = 2,
    max_df: float = 1.0,
    max_features: int = 10000,
    buckets: int = TERM_BUCKETS,
) -> DataFrame:
    """(part, term, df, total, n_docs): for each part of the rows (few, each a number) the ``vocabulary`` of the rows
    of all others; the documents are rows of their own. ``tokens`` holds (part, doc, _tok).

    As ``heavy_vocabulary``, once for all: a bucket's sum over every part bounds its terms in any of them, so
    the least floor decides which buckets are counted, and a term's counts by part give those without one."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_hash")
    sizes = {r[0]: r[1] for r in tokens.groupBy(part).count().collect()}  # the parts are few
    sums = occurrences(tokens).select(bucket).groupBy("_hash").agg(F.count(F.lit(1)).alias("_bound")).checkpoint()
    chosen = sums.orderBy(F.desc("_bound"), F.asc("_hash")).limit(max(FIRST_BUCKETS, 4 * max_features)).select("_hash").checkpoint()
    keyed = counted_tokens(tokens, [part]).withColumn("_hash", bucket)
    order = [F.desc("total"), F.asc("term")]

    def exact(which: DataFrame) -> DataFrame:
        rows = keyed.join(broadcast_if_small(which, BROADCAST_BUCKETS), "_hash", "left_semi")
        sums_of = [f(F.when(F.col(part) == p, x)).alias(f"_{n}{i}") for i, p in enumerate(sizes)
                   for f, n, x in ((F.count, "d", F.lit(1)), (F.sum, "t", F.col("tf")))]
        terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("_d"), F.sum("tf").alias("_t"), *sums_of)
        without = [F.struct(F.lit(p).alias(part), (F.col("_d") - F.col(f"_d{i}")).alias("df"), (F.col("_t") - F.coalesce(f"_t{i}", F.lit(0))).alias("total"),
                            F.lit(sum(sizes.values()) - n).alias("n_docs")) for i, (p, n) in enumerate(sizes.items())]
        kept = terms.select("term", F.inline(F.array(*without))).filter((F.col("df") >= min_df) & (F.col("df") <= float(max_df) * F.col("n_docs")))
        return top_k_per_group(kept, [part], order, max_features, ["term"]).drop("rank")

    if not sizes:
        return tokens.select(part, F.lit("").alias("term"), *(F.lit(0).cast("long").alias(c) for c in ("df", "total", "n_docs")))
    found = exact(chosen).checkpoint()
    full = F.count(F.lit(1)) >= max_features
    floors = {r[0]: r[1] for r in found.groupBy(part).agg(F.when(full, F.min("total"))).collect()}
    rest = sums.join(F.broadcast(chosen), "_hash", "left_anti").filter(F.col("_bound") >= min((floors.get(p) or 0) for p in sizes))
    rest = rest.select("_hash").checkpoint()
    if not rest.isEmpty():
        found = top_k_per_group(found.unionByName(exact(rest)), [part], order, max_features, ["term"]).drop("rank").checkpoint()
    return found.select(part, "term", "df", "total", "n_docs")


def counts_of(counts: DataFrame, vocab: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., doc, term, tf) of the vocabulary's terms, the rows of a ``doc`` added up."""
    group = group or []
    terms = broadcast_if_small(vocab.select(*group, "term"), BROADCAST_BUCKETS)
    kept = counts.join(terms, [*group, "term"], "left_semi")
    return kept.groupBy(*group, "doc", "term").agg(F.sum("tf").alias("tf"))


def tfidf(counts: DataFrame, vocab: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., doc, term, weight): sublinear tf x smooth idf, L2-normalised per document."""
    group = group or []
    # Ungrouped, the vocabulary is bounded by max_features, so it is broadcast; per-slice
    # vocabularies grow with the number of slices and are broadcast behind a count.
    v = vocab.select(*group, "term", "df", "n_docs")
    j = counts.join(broadcast_if_small(v, BROADCAST_BUCKETS) if group else F.broadcast(v), [*group, "term"])
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    w = (1.0 + F.log(F.col("tf").cast("double"))) * idf
    j = j.withColumn("_w", w)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*group, "doc")))
    return j.select(*group, "doc", "term", (F.col("_w") / norm).alias("weight"))


def doc_count(docs: DataFrame, group: list[str] | None = None) -> DataFrame:
    group = group or []
    return docs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"))


def mean_weights(weights: DataFrame, n_docs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean weight of each term over all documents of the slice (absent = 0)."""
    group = group or []
    s = weights.groupBy(*group, "term").agg(F.sum("weight").alias("_s"))
    s = s.join(n_docs, group) if group else s.crossJoin(F.broadcast(n_docs))
    return s.select(*group, "term", (F.col("_s") / F.col("n_docs")).alias("score"))


def top_terms(scores: DataFrame, group: list[str], k: int, score: str = "score") -> DataFrame:
    """Top ``k`` terms per group by score (ties by term), positive scores only."""
    pos = scores.filter(F.col(score) > 0)
    return top_k_per_group(pos, group, [F.desc(score), F.asc("term")], k, ["term"])


def font_sizes(top: DataFrame, group: list[str], score: str = "score") -> Column:
    """12 + 36 * min-max normalised score (truncated to int), per group."""
    w = Window.partitionBy(*group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return (F.lit(12.0) + (F.col(score) - lo) / (hi - lo + F.lit(1e-9)) * F.lit(36.0)).cast("int")


def class_support(docs: DataFrame, text_col: str, label: str, min_size: int) -> DataFrame:
    """B5 + B6: (label, n, viable) over usable texts, one row a class, in one scan."""
    from civicflow.functions.labels import usable_text

    usable = docs.filter(usable_text(F.col(text_col)) & F.col(label).isNotNull())
    return usable.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("viable", F.col("n") >= min_size)


def usable_with_support(docs: DataFrame, text_col: str, label: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """B5 + B6 + J6 + J7: usable texts of classes with >= min_size of them; also the
    excluded classes with their counts."""
    from civicflow.functions.labels import usable_text

    usable = docs.filter(usable_text(F.col(text_col)) & F.col(label).isNotNull())
    counts = usable.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    viable = counts.filter(F.col("n") >= min_size)
    kept = usable.join(F.broadcast(viable.select(label)), label, "left_semi")  # the class list: no text is shuffled for it
    excluded = counts.join(viable.select(label), label, "left_anti")
    return kept, excluded
