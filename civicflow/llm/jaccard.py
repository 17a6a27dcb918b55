"""Operator 5: n-gram Jaccard join with token-combination prefixes.

A document's set are its distinct ``words``-word shingles, as 64-bit hashes. Two documents link if
100 * intersection >= ``percent`` * union. Only components are asked for, so no group of
similar documents is expanded into its pairs:

1. Equal sets are one node (smallest doc_id) from the start.
2. *Sieve.* Of the ``n`` shingles of a set at most ``n - o`` are missing in a partner, where
   ``o`` is the smallest overlap that links. So the ``n - o + 1 + m`` shingles that come first by
   hash hold at least ``m + 1`` that are also among the first of the partner; sets with fewer
   shared ones link with nothing and go no further.
3. *Prefixes.* The shingles of the rest are put in order of document frequency. A pair shares
   a shingle of its prefixes (the first ``p = n - o + 1``). A rare one (in at most ``RARE``
   sets) is a key by itself. If the first common one is frequent, all common ones are, and
   prefixes extended by ``g`` hold ``g + 1`` of them: dealt by hash to ``g`` hands, two lie
   in one hand. So frequent shingles are indexed as the pairs within each hand, which are as few
   as the prefix is long.
4. *Stars.* Under each key all members are verified against one centre, the member with the
   fewest shingles of its own: as many candidates as members.
5. *Across components.* Keys whose members are not yet in one component are compared across the
   components only: in cells of at most about ``BLOCK`` x ``BLOCK`` members, by size and by a histogram of
   hashes whose minima bound the overlap from above; what passes is verified exactly.

Defined cases: null and empty texts and texts without words have an empty set and link with
nothing; a set of fewer than ``words`` words is its whole sequence; a null doc_id links with
nothing and has a null component; rows with one doc_id and different texts count as one
document that links as any of its texts; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import batched, checked_broadcast, connected_components, ship, staged, without_clash

RARE = 32
BLOCK = 1024
BINS = 256
SIEVE = 20  # m is one SIEVE-th of the smallest overlap
BROADCAST_ROWS = 400_000
PART = 4 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(texts: pa.Array):
    """Slices of about ``PART`` bytes of text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), len(texts)]
    return (texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    if not 0 < n <= len(h):
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * MULTIPLIER + h[i : len(h) - n + 1 + i])
    return out


class Shingler:
    """Sets of shingle hashes."""

    def __init__(self, words: int):
        self.words = words

    def set_of(self, text: str | None) -> np.ndarray:
        return next(self.sets_of(pa.array([text], pa.string())))

    def sets_of(self, texts: pa.Array):
        """The sorted distinct shingle hashes of each text, in order. Only A-Z is lower-cased and
        only ASCII blanks part words; a word is hashed once for each slice of the batch."""
        for part in _parts(texts):
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
            flat = split.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            doc = np.repeat(np.arange(len(part)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
            sizes = np.bincount(doc[full.to_numpy(zero_copy_only=False)], minlength=len(part))
            coded = flat.filter(full).dictionary_encode()
            known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
            h = known[coded.indices.to_numpy()]
            rolled = _rolled(h, self.words)
            start = 0
            for size in sizes.tolist():
                n = min(self.words, size)
                found = rolled[start : start + size - n + 1] if n == self.words else _rolled(h[start : start + size], n)
                start += size
                found = np.sort(found + np.uint64(n))
                yield found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def least_overlap(n, percent: int):
    """Smallest intersection with which a set of n can link."""
    return (percent * n + 99) // 100


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (hash of the set), low (first shingles by hash), need (how many of
    them must be shared)."""
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for s in Shingler(words).sets_of(batch.column(1)):
                n = len(s)
                o = int(least_overlap(n, percent))
                m = o // SIEVE
                low = s[: n - o + 1 + m]
                a, b = mix(s + np.uint64(1)), mix(s ^ MULTIPLIER)
                row = (n, int(a.sum().view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64)) if n else 0, low.view(np.int64),
                       int(least_overlap(o, percent)) // SIEVE + 1)
                for c, v in zip(cols, row):
                    c.append(v)
            sizes = np.cumsum([0, *map(len, cols[3])])
            flat = np.concatenate(cols[3]) if cols[3] else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(cols[4], pa.int64())],
                names=["doc_id", "n", "s1", "s2", "low", "need"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        batched(run), "doc_id long, n long, s1 long, s2 long, low array<long>, need long")


def _survivors(sets: DataFrame) -> DataFrame:
    """node (smallest doc_id of an equal set), s1, s2 of the sets that pass the sieve."""
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    low = sets.where("n > 0 and doc_id is not null").select("doc_id", "s1", F.explode("low").alias("tok"))
    # A token counts as shared if two different sets hold it; 32 bits tell sets apart well enough, as an
    # error of one in 2^32 could only hide a token that no third set holds.
    shared = low.groupBy("tok").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("tok")
    reps = sets.select("doc_id", "s1", "s2", "n", "need", "low").join(
        nodes.select(F.col("s1").alias("__1"), F.col("s2").alias("__2"), F.col("n").alias("__n"), "node"),
        (F.col("s1") == F.col("__1")) & (F.col("s2") == F.col("__2")) & (F.col("n") == F.col("__n")) & (F.col("doc_id") == F.col("node")), "left_semi")
    counted = (reps.select(F.col("doc_id").alias("node"), "s1", "s2", "need", F.explode("low").alias("tok"))
               .join(shared, "tok").groupBy("node", "s1", "s2", "need").agg(F.countDistinct("tok").alias("c")))
    return counted.where("c >= need").select("node", "s1", "s2")


def _tokens(docs: DataFrame, survivors: DataFrame, words: int) -> DataFrame:
    """node, n, tokens array<long> (the whole set) of the surviving nodes."""
    def run(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in Shingler(words).sets_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    rows = docs.selectExpr("cast(doc_id as long) node", "cast(text as string) text")
    wanted = checked_broadcast(staged(survivors.select("node").distinct(), "jaccard-survivors"), BROADCAST_ROWS)
    return rows.join(wanted, "node", "left_semi").mapInArrow(batched(run), "node long, n long, tokens array<long>").dropDuplicates(["node", "tokens"])


def hands(n: int) -> int:
    """Number of hands for sets of n: a power of two near n / 16."""
    return 1 << max(0, int(math.log2(max(1, n / 16))))


def keys_of(n: int, tokens: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set: ``tokens`` those in two sets or more, ``df`` their frequencies."""
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    own = n - len(tokens)  # shingles of no other set come first
    p = n - int(least_overlap(n, percent)) + 1
    out = [tokens[: max(0, p - own)][df[: max(0, p - own)] <= RARE].view(np.uint64)]
    for g in {hands(int(least_overlap(n, percent))), hands(n), hands(100 * n // percent)}:
        part = tokens[: max(0, p + g - own)]
        part = part[df[: len(part)] > RARE].view(np.uint64)
        hand = part % np.uint64(g)
        by = np.lexsort((part, hand))
        part, hand = part[by], hand[by]
        for step in range(1, len(part)):
            same = hand[step:] == hand[:-step]
            if not same.any():
                break
            out.append(mix(mix(part[:-step][same] * MULTIPLIER + np.uint64(g)) + part[step:][same]))
    return np.unique(np.concatenate(out)).view(np.int64)


def _keys(tokens: DataFrame, percent: int) -> DataFrame:
    """key, node, n, own (shingles of no other set)."""
    rows = tokens.select("node", "n", F.explode("tokens").alias("tok"))
    frequency = rows.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    known = rows.join(frequency, "tok").groupBy("node", "n").agg(F.collect_list("tok").alias("tok"), F.collect_list("df").alias("df"))

    def run(batches):
        for batch in batches:
            node, n, own, key = [], [], [], []
            for row in zip(*(batch.column(i) for i in range(4))):
                v, size = row[0].as_py(), row[1].as_py()
                tok, df = (x.values.to_numpy(zero_copy_only=False) for x in row[2:])
                found = keys_of(size, tok, df, percent)
                node.append(np.full(len(found), v))
                n.append(np.full(len(found), size))
                own.append(np.full(len(found), size - len(tok)))
                key.append(found)
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (key, node, n, own)], names=["key", "node", "n", "own"])

    return known.mapInArrow(batched(run), "key long, node long, n long, own long")


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    a = tokens.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = tokens.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b").distinct())


def _cells(batches):
    """Consecutive rows of equal (key, i, j) as lists of columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield now, rows


def _across(keys: DataFrame, components: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a key and could link."""
    labelled = staged(keys.join(components, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "jaccard-labelled")
    open_ = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")).where("a <> b")

    def sketch(batches):
        for batch in batches:
            out = [np.bincount(t.values.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(BINS), minlength=BINS).astype("<u2").tobytes()
                   for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "bins"])

    rows = labelled.join(open_.select("key", "members"), "key")
    sketches = (tokens.join(rows.select("node").distinct(), "node", "left_semi").where(f"n < {1 << 16}")
                .select("node", "tokens").mapInArrow(batched(sketch), "node long, bins binary"))
    cells = (rows.join(sketches, "node", "left").withColumn("g", F.expr(f"cast(ceil(members / {BLOCK}) as long)"))
             .withColumn("block", F.expr("pmod(xxhash64(node, 5), g)")).withColumn("other", F.expr("explode(sequence(0L, g - 1))"))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component", "bins"))

    def compare(batches):
        for (_, i, j), rows in _cells(batches):
            block, node, n, comp, bins = (list(c) for c in zip(*rows))
            block, node, n, comp = (np.array(c) for c in (block, node, n, comp))
            full = np.full(BINS, np.iinfo(np.uint16).max, dtype=np.int64)  # no sketch: no bound
            bins = np.stack([full if b is None else np.frombuffer(b, "<u2").astype(np.int64) for b in bins])
            for x in range(len(node) - 1):
                rest = np.arange(x + 1, len(node))
                low, high = np.minimum(n[x], n[rest]), np.maximum(n[x], n[rest])
                rest = rest[(comp[rest] != comp[x]) & (100 * low >= percent * high) & ((i == j) | (block[rest] != block[x]))]
                if len(rest):
                    most = np.minimum(bins[x], bins[rest]).sum(axis=1)
                    rest = rest[100 * most >= percent * (n[x] + n[rest] - most)]
                if len(rest):
                    a, b = np.minimum(node[x], node[rest]), np.maximum(node[x], node[rest])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    order = ["key", "i", "j"]
    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(batched(compare), "a long, b long").distinct()


def components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    sets = staged(_sets(docs, words, percent), "jaccard-sets")
    tokens = staged(_tokens(docs, _survivors(sets), words), "jaccard-tokens")
    keys = staged(_keys(tokens, percent), "jaccard-keys")
    centre = (keys.groupBy("key").agg(F.min(F.struct("own", "node", "n")).alias("c"), F.count("*").alias("members"))
              .where("members > 1").select("key", F.col("c.node").alias("hub"), F.col("c.n").alias("hub_n")))
    star = (keys.join(centre, "key").where(f"node <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    first = staged(_verified(star, tokens, percent), "jaccard-stars")
    found = staged(connected_components(first, "jaccard-cc1"), "jaccard-components")
    more = staged(_verified(_across(keys, found, tokens, percent), tokens, percent), "jaccard-across")
    if not more.isEmpty():
        label = found.select(F.col("node").alias("__node"), "component")
        joined = more.join(label, F.col("a") == F.col("__node"), "left").select(F.coalesce("component", "a").alias("a"), "b")
        joined = joined.join(label, F.col("b") == F.col("__node"), "left").select("a", F.coalesce("component", "b").alias("b"))
        merged = connected_components(joined, "jaccard-cc2").select(F.col("node").alias("__node"), F.col("component").alias("__merged"))
        every = found.union(merged.select("__node", "__node")).distinct()
        found = every.join(merged, F.col("component") == F.col("__node"), "left").select("node", F.coalesce("__merged", "component").alias("component"))
        found = staged(found.groupBy("node").agg(F.min("component").alias("component")), "jaccard-merged")
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    by_set = nodes.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("__component"))
    per_row = sets.select("doc_id", "s1", "s2", "n").join(by_set, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("__component", "doc_id"))
    return per_row.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each component; all columns stay.
    Rows with a null doc_id stay; rows that share a doc_id are one document."""
    def work(rows):
        gone = staged(components(rows, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
        return rows.join(checked_broadcast(gone, BROADCAST_ROWS), F.expr("cast(doc_id as long)") == F.col("__gone"), "left_anti")

    return without_clash(docs, work)
