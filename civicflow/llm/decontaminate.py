"""Operator 3 [native]: benchmark decontamination by SimHash over item-sized windows.

Text is lower-cased and cut into words (runs of letters, digits and everything beyond ASCII);
a shingle is five words, or all words of an item that has fewer.

1. *Windows.* A window has as many words as a benchmark item. Of a window and an item with m
   shingles each, 4/9 of the 2 m must be shared for a similarity of 0.8. Moving a window on to
   the next shingle that is one of an item's of that size (a hit) loses nothing shared, so windows start
   at hits (or are the document's last); of these, all with enough hits are taken, in
   whatever order the hits come. Windows with equal words are one content from then on, so a
   passage that a third of all documents hold is fingerprinted and verified once.
2. *Fingerprints.* 64-bit SimHash of a window's shingles, each counted as often as it occurs.
3. *Multi-index.* A fingerprint is cut into four blocks of 16 bits. Within ``RADIUS`` = 15
   differing bits at least one block differs in three bits or fewer, so each item stores
   every block value within three flips and each content looks up its four: no fingerprint
   within the radius is missed.
4. *Beyond the radius.* At a similarity of 0.8 some 2 % of fingerprints differ in more bits. A
   content and an item that are similar enough share one of the first fifth of their shingles
   in any common order; with the item shingles that fewest items have first (and shingles of
   no item before them), one join on these prefixes adds every pair the index lacks.
5. *Verification.* Weighted Jaccard similarity (the weight of a shingle is its number of
   occurrences), exactly, by one join on (item, shingle).

Only DataFrame functions are used. The benchmark's shingles are broadcast if there are at
most ``BROADCAST_ROWS`` of them (checked), and joined by shuffle if not. The index of 3. and the
contents are always joined by shuffle.

Defined cases: null and empty texts and items match nothing; a document shorter than the
item is compared whole; rows keep their multiplicity, null doc_id included; benchmark items
with a null id match nothing, repeated items count once; a document's other columns stay (``drop_contaminated``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import checked_broadcast, staged, without_clash

SHINGLE = 5
PERCENT = 80
SIMILARITY = PERCENT / 100
BLOCKS = 4
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_ROWS = 2_000_000
CONTENT = ["c1", "c2"]


def _hashed_words(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus __h (a hash of each word, in order) and __n."""
    words = r"trim(regexp_replace(lower({0}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' '))".format(text)
    return (df.withColumn("__w", F.expr(words))
            .withColumn("__h", F.expr("if(__w = '', cast(array() as array<bigint>), transform(split(__w, ' '), w -> xxhash64(w)))"))
            .withColumn("__n", F.size("__h")).drop("__w"))


def _shingles(k: int) -> str:
    """All k-word shingles of __h as hashes."""
    parts = ", ".join(f"__h[i + {j}]" for j in range(k))
    return f"if(__n >= {k}, transform(sequence(0, __n - {k}), i -> xxhash64({k}, {parts})), cast(array() as array<bigint>))"


def _identified(docs: DataFrame) -> DataFrame:
    return (docs.select(F.expr("cast(doc_id as long)").alias("__id"), F.expr("cast(text as string)").alias("__text"))
            .where("__text is not null").withColumn("__row", F.xxhash64("__text")))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item, n (words), k (words of a shingle), sh (its shingles)."""
    items = (benchmark.selectExpr("cast(item_id as long) item", "cast(text as string) __text").where("item is not null and __text is not null")
             .distinct())
    items = _hashed_words(items, "__text").where("__n > 0")
    sizes = [f"when __n = {k} then {_shingles(k)}" for k in range(1, SHINGLE)]
    return items.selectExpr("item", "__n n", f"least(__n, {SHINGLE}) k", f"case {' '.join(sizes)} else {_shingles(SHINGLE)} end sh")


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., fp: 64-bit SimHash of the hashes in column h."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("m"), *[F.sum(F.expr(f"shiftrightunsigned(h, {b}) & 1L")).alias(f"b{b}") for b in range(64)])
    bits = " | ".join(f"shiftleft(if(2 * b{b} > m, 1L, 0L), {b})" for b in range(64))
    return sums.selectExpr(*by, f"({bits}) fp")


def prefixes(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """by..., k, h: the shingles, by (f, h), that two sets of SIMILARITY cannot all differ in."""
    over = Window.partitionBy(*by)
    before = F.sum(weight).over(over.orderBy("f", "h").rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum(weight).over(over))
            .where(f"before <= total - ceil({SIMILARITY} * total) and f > 0").select(*by, "k", "h"))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """__id, __row, start, n (words), item, similarity of every verified window."""
    items = staged(benchmark_items(benchmark), "decontaminate-items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    shingles = items.select("item", "n", "k", F.posexplode("sh").alias("at", "h"))
    if items.select(F.sum(F.size("sh"))).first()[0] in (None,) or not sizes:
        return docs.sparkSession.createDataFrame([], "__id long, __row long, start long, n int, item long, similarity double")
    known = shingles.select("h", "k", "n").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)

    def doc_shingles(k):
        return _hashed_words(_identified(docs), "__text").select("__id", "__row", "__n", F.posexplode(F.expr(_shingles(k))).alias("pos", "h"))

    windows = None
    for k in sizes:
        part = (doc_shingles(k).join(known.where(F.col("k") == k), "h")
                .select("__id", "__row", "__n", "k", "n", "pos"))
        windows = part if windows is None else windows.union(part)
    # Hits of one document are never more than its words.
    starts = (windows.groupBy("__id", "__row", "__n", "k", "n").agg(F.sort_array(F.collect_set("pos")).alias("p"))
              .selectExpr("*", "least(__n, n) - k + 1 m", "greatest(0, __n - n) last")
              .withColumn("need", F.expr(f"cast(({PERCENT} * (m + n - k + 1) + {99 + PERCENT}) div {100 + PERCENT} as int)"))
              .where("size(p) >= need")
              .withColumn("at", F.expr("filter(sequence(0, size(p) - need), i -> p[i + need - 1] < least(p[i], last) + m)"))
              .where("size(at) > 0"))
    per_doc = (starts.withColumn("w", F.expr("transform(array_distinct(transform(at, i -> least(p[i], last))), s -> struct(k, n, s as start))"))
               .groupBy(F.col("__id").alias("__i"), F.col("__row").alias("__r")).agg(F.flatten(F.collect_list("w")).alias("found")))
    source = _identified(docs).dropDuplicates(["__id", "__row"])
    texts = source.join(per_doc, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r")))
    texts = _hashed_words(texts, "__text")
    cut = "case " + " ".join(f"when w.k = {k} then slice({_shingles(k).replace('__', 's__')}, w.start + 1, greatest(least(w.n, s__n) - {k} + 1, 0))" for k in sizes) + " end"
    found = (texts.selectExpr("__id", "__row", "__h s__h", "__n s__n", "explode(found) w")
             if sizes != [SHINGLE] else
             texts.selectExpr("__id", "__row", "found", f"{_shingles(SHINGLE)} sh", "__n s__n").selectExpr("__id", "__row", "sh", "s__n", "explode(found) w"))
    if sizes == [SHINGLE]:
        cut = f"slice(sh, w.start + 1, greatest(least(w.n, s__n) - {SHINGLE} + 1, 0))"
    found = found.selectExpr("__id", "__row", "w.start start", "w.n n", "w.k k", f"{cut} sh").where("size(sh) > 0")
    found = staged(found.selectExpr("*", "xxhash64(k, n, sh) c1", "xxhash64(sh, n, k, 1) c2"), "decontaminate-windows")

    contents = found.groupBy(*CONTENT).agg(F.first("k").alias("k"), F.first("sh").alias("sh"))
    content_rows = staged(contents.select(*CONTENT, "k", F.explode("sh").alias("h")), "decontaminate-contents")
    # Each step is written before the next: one plan of them all has some twenty shuffles at once, whose plans,
    # task binaries and codegen the driver would hold together.
    weights = staged(content_rows.groupBy(*CONTENT, "k", "h").agg(F.count("*").alias("a")), "decontaminate-weights")
    content_fp = staged(fingerprints(content_rows, [*CONTENT, "k"]), "decontaminate-content-fingerprints")
    item_fp = staged(fingerprints(shingles, ["item", "k"]), "decontaminate-fingerprints")
    blocks = [f"struct({j} as block, shiftrightunsigned(fp, {16 * j}) & 65535L as value)" for j in range(BLOCKS)]
    masks = ", ".join(f"{m}L" for m in range(1 << 16) if m.bit_count() <= FLIPS)  # 697 values
    stored = (item_fp.selectExpr("item", "k", "fp item_fp", f"explode(array({', '.join(blocks)})) b")
              .selectExpr("item", "k", "item_fp", "b.block block", f"explode(transform(array({masks}), m -> b.value ^ m)) value"))
    asked = content_fp.selectExpr(*CONTENT, "k", "fp", f"explode(array({', '.join(blocks)})) b").selectExpr(*CONTENT, "k", "fp", "b.block block", "b.value value")
    # 697 rows an item and block: however small the items look, this is not broadcast. Nor are the joins by CONTENT:
    # a broadcast table with a key of two columns takes a memory page of the driver at least (up to 64 MB, by its heap).
    within = asked.join(stored.hint("merge"), ["block", "value", "k"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}").select(*CONTENT, "item")
    within = staged(within.distinct(), "decontaminate-within")

    item_weights = shingles.groupBy("item", "k", "h").agg(F.count("*").alias("b"))
    held = staged(item_weights.groupBy("h").agg(F.count("*").alias("f")), "decontaminate-held")
    first = staged(prefixes(item_weights.join(held, "h"), ["item"], "b"), "decontaminate-prefixes")
    own = weights.join(checked_broadcast(held, BROADCAST_ROWS), "h", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    beyond = prefixes(own, CONTENT, "a").drop("k").join(checked_broadcast(first.drop("k"), BROADCAST_ROWS), "h").select(*CONTENT, "item")  # h is of k too
    candidates = staged(within.union(beyond).distinct(), "decontaminate-candidates")

    totals = weights.groupBy(*CONTENT).agg(F.sum("a").alias("na"))
    weights, item_weights = weights.drop("k"), item_weights.drop("k")
    item_totals = items.select("item", F.size("sh").alias("nb"))
    shared = (candidates.join(weights.hint("merge"), CONTENT).join(item_weights, ["item", "h"])
              .groupBy(*CONTENT, "item").agg(F.sum(F.least("a", "b")).alias("both")))
    shared = staged(shared, "decontaminate-shared")
    verified = (shared.join(totals.hint("merge"), CONTENT).join(item_totals, "item")
                .selectExpr(*CONTENT, "item", "both / (na + nb - both) similarity").where(f"similarity >= {SIMILARITY}"))
    return found.join(verified.hint("merge"), CONTENT).selectExpr("__id", "__row", "cast(start as long) start", "n", "item", "similarity")


def _by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = contaminated_windows(docs, benchmark)
    return (hits.groupBy(F.col("__id").alias("__i"), F.col("__row").alias("__r"))
            .agg(F.sort_array(F.collect_set("item")).alias("__items"), F.max("similarity").alias("__similarity")))


def _marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = docs.withColumn("__id", F.expr("cast(doc_id as long)")).withColumn("__row", F.expr("xxhash64(cast(text as string))"))
    return rows.join(_by_document(docs, benchmark), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r")), "left")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted, comma-joined), similarity (of the closest window, 0 if none)."""
    rows = docs.select("doc_id", "text")
    return _marked(rows, benchmark).select(
        F.col("__id").alias("doc_id"), F.col("__items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("__items").cast("array<string>"), ","), F.lit("")).alias("item_ids"),
        F.coalesce("__similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    return without_clash(docs, lambda rows: _marked(rows, benchmark).where("__items is null").select(*rows.columns))
