"""Operator 1: substring dedup with a compressed FM-index per shard.

A word of a document goes if it lies in a window of ``WINDOW`` words whose sequence also starts in a
document with a smaller doc_id. Windows are judged on the input.

1. *Segments.* Every window is filed under its anchor: the smallest hash among its ``GRAM``-word
   grams. Consecutive windows with one anchor form a segment; equal windows have equal anchors in
   all documents, so only segments under one anchor need comparing.
2. *Sieve.* Anchors that only one document has are dropped with their segments (one aggregate).
   Equal segments become one, held by their smallest doc_id: the first step of a copy of any
   size, so a passage that a third of all documents hold enters an index once.
3. *Shards.* The distinct segments go by anchor to shards of about ``SHARD_WORDS`` words. A shard is
   indexed: word ids, suffix array, Burrows-Wheeler transform in a wavelet matrix of packed bits
   with rank counts. Its segments are streamed through backward search; the search keeps the
   longest match at each word up to ``WINDOW`` (the matching statistic), and the interval of every full
   window gives the smallest document that holds it.
4. *Hot anchors.* An anchor with more than ``HOT`` distinct segments (the border of a passage that
   very many texts hold) would crowd one shard. Its segments are taken apart into windows, and
   equal windows find their smallest document by one aggregate: exact, and spread by window.
5. What is found of a segment holds wherever its holder has it: intervals and hot windows go, as
   places in the segment, to every other occurrence in rows of that doc_id.
6. The intervals are gathered per document, and the kept words are joined.

Defined cases: null text has no words; a document shorter than the window loses nothing; a
repeated passage within one document stays; rows with one doc_id count as one document (each
row loses what smaller documents have); a null doc_id is compared with nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import checked_broadcast, ship, staged
from civicflow.llm.jaccard import mix

WINDOW = 50
GRAM = 16
SHARD_WORDS = 1_000_000
HOT = 4_000
BROADCAST_ROWS = 400_000
MEMO = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(BASE_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


class Hashed:
    """Rolling hashes of one document's words: any run of words in constant time."""

    powers = Powers()

    def __init__(self, h: np.ndarray):
        up, self.down = self.powers.upto(len(h) + 1)
        self.one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
        self.two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * up[:-1], dtype=np.uint64)])

    def runs(self, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        end = start + length
        size = np.uint64(0) + np.asarray(length).astype(np.uint64)
        return (mix((self.one[end] - self.one[start]) * self.down[start] + size),
                mix((self.two[end] - self.two[start]) * self.down[start] ^ size))


class Words:
    """Words of a text and their 64-bit hashes, remembered by word."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = (text or "").encode("utf-8").split()  # bytes: cut at ASCII white space alone
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return words, np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def segments(h: np.ndarray, window: int, gram: int):
    """(anchor, hash, second hash, first word, number of words) of each segment, as arrays."""
    n = len(h) - window + 1
    if n < 1:
        empty = np.empty(0, dtype=np.uint64)
        return empty, empty, empty, empty.astype(np.int64), empty.astype(np.int64)
    rolled = Hashed(h)
    grams = rolled.runs(np.arange(len(h) - gram + 1), gram)[0]
    span = window - gram + 1
    place = np.empty(n, dtype=np.int64)
    for a in range(0, n, 1 << 16):  # bounds the memory of the sliding view's result
        view = np.lib.stride_tricks.sliding_window_view(grams[a : a + (1 << 16) + span - 1], span)[: n - a]
        place[a : a + len(view)] = view.argmin(axis=1) + np.arange(a, a + len(view))
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:], [n]])  # one past the last window
    length = last - first + window - 1
    return (grams[place[first]], *rolled.runs(first, length), first, length)


class FMIndex:
    """FM-index of word sequences, for patterns of at most ``depth`` words.

    ``ids``: the sequences, each closed by 0; other symbols are positive."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        self.n, self.depth = n, depth
        symbol, rank = np.unique(ids, return_inverse=True)
        ranks = [rank.astype(np.int64)]  # ranks[j]: order of the first 2^j words
        order = np.argsort(ranks[0], kind="stable")
        while 1 << (len(ranks) - 1) < depth:
            step = 1 << (len(ranks) - 1)
            follow = np.zeros(n, dtype=np.int64)
            follow[: max(0, n - step)] = ranks[-1][step:]
            key = ranks[-1] * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            ranks.append(new)
        self.sa = order
        self.starts = {d: self._boundaries(ranks, d) for d in (depth - 1, depth)}
        self.symbols = symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ranks[0], minlength=len(symbol)))])
        self._wavelet(ranks[0][(order - 1) % n])

    def _boundaries(self, ranks, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(class of each suffix by its first ``depth`` words, first suffix of each class and the end)."""
        differs, at, rest = np.zeros(self.n, dtype=bool), 0, depth
        differs[:1] = True
        for j in reversed(range(len(ranks))):
            if rest >= 1 << j:
                place = self.sa + at
                value = np.where(place < self.n, ranks[j][np.minimum(place, self.n - 1)], -1)
                differs[1:] |= value[1:] != value[:-1]
                at, rest = at + (1 << j), rest - (1 << j)
        starts = np.flatnonzero(differs)
        return np.cumsum(differs) - 1, np.append(starts, self.n)

    def _wavelet(self, bwt: np.ndarray) -> None:
        """Levels of packed bits, most significant first, with the ones before each word."""
        self.levels = []
        for bit in reversed(range(max(1, int(len(self.symbols) - 1).bit_length()))):
            ones = (bwt >> bit) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bit, words, counts, self.n - int(ones.sum())))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of ``symbol`` among the first ``at`` of the transform, minus that of smaller
        paths (the constant that makes differences of ranks and LF steps come out)."""
        begin = np.zeros_like(at)
        for bit, words, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            for x in (at, begin):
                word = x >> 6
                ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                x[:] = np.where(one, zeros + ones, x - ones)
        return at - begin

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of symbol + pattern."""
        n = len(symbol)
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[:n], self.first[symbol] + both[n:]

    def windows(self, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        """Streams the sequences ids[start : start + length] through backward search, all at
        once, from their last word to their first. Yields, word by word, (which sequences,
        at which word, matching statistic, first suffix of the interval); the statistic is
        capped at ``depth``. Sequences of the index itself always extend; a foreign one whose
        match breaks begins anew at that word, so its statistic is then a lower bound."""
        size = len(starts)
        low, high = np.zeros(size, dtype=np.int64), np.full(size, self.n, dtype=np.int64)
        match = np.zeros(size, dtype=np.int64)
        classes, begins = self.starts[self.depth - 1]
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= back)
            at = lengths[live] - back
            full = live[match[live] == self.depth]  # forget the last word: back to depth - 1
            of = classes[low[full]]
            low[full], high[full] = begins[of], begins[of + 1]
            match[full] -= 1
            word = ids[starts[live] + at]
            symbol = np.minimum(np.searchsorted(self.symbols, word), len(self.symbols) - 1)
            known = self.symbols[symbol] == word
            lo, hi = self.extend(symbol, low[live], high[live])
            found = known & (lo < hi)
            low[live] = np.where(found, lo, np.where(known, self.first[symbol], 0))
            high[live] = np.where(found, hi, np.where(known, self.first[symbol + 1], self.n))
            match[live] = np.where(found, match[live] + 1, known)
            yield live, at, match[live], low[live]


def repeated_intervals(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int):
    """Of each sequence (``ids`` without closing zeros, held by the document ``docs``): the windows that a smaller
    document holds, as (sequence, first window, last window) arrays."""
    closed = np.zeros(len(ids) + len(lengths), dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.ones(len(closed), dtype=bool)
    inside[starts + lengths] = False
    closed[inside] = ids
    index = FMIndex(closed, window)
    classes, begins = index.starts[window]
    smallest = np.minimum.reduceat(docs[owner[index.sa]], begins[:-1])
    which, where = [], []
    for live, at, match, low in index.windows(starts, lengths, closed):
        full = match == window
        hit = full.copy()
        hit[full] = smallest[classes[low[full]]] < docs[live[full]]
        which.append(live[hit])
        where.append(at[hit])
    which, where = np.concatenate(which), np.concatenate(where)
    order = np.lexsort((where, which))
    which, where = which[order], where[order]
    cut = np.flatnonzero((which[1:] != which[:-1]) | (where[1:] != where[:-1] + 1)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)[: len(which)]
    last = np.concatenate([cut - 1, [len(which) - 1]]).astype(np.int64)[: len(first)]
    return which[first], where[first], where[last]


SEGMENT = "struct<anchor:long,h1:long,h2:long,pos:int,len:int>"
INTERVAL = "doc long, row long, pos int, first int, last int"  # first and last: words of the segment at pos


def _scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, row, n_words, sha (of all words), segments of every document."""
    def run(batches):
        split = Words()
        for batch in batches:
            counts, digests, parts = [], [], []
            for text in batch.column(2).to_pylist():
                words, h = split(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                parts.append(segments(h, window, gram))
            sizes = np.cumsum([0] + [len(p[0]) for p in parts])
            flat = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(5)]
            cols = [pa.array(c.view(np.int64)) for c in flat[:3]] + [pa.array(c.astype(np.int32)) for c in flat[3:]]
            rows = pa.StructArray.from_arrays(cols, names=["anchor", "h1", "h2", "pos", "len"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)], names=["doc", "row", "n_words", "sha", "segments"])

    return docs.mapInArrow(run, f"doc long, row long, n_words long, sha string, segments array<{SEGMENT}>")


def _cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Words of the wanted segments. ``wanted``: doc, row, parts array<(shard, pos, len)>; a
    null shard asks for the hashes of the segment's windows instead."""
    def run(batches):
        split = Words()
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                words, h = split(text)
                rolled = Hashed(h) if any(p["shard"] is None for p in parts) else None
                for p in parts:
                    if p["shard"] is not None:
                        out.append((p["shard"], doc, row, p["pos"], 0, b" ".join(words[p["pos"] : p["pos"] + p["len"]]), None, None))
                    else:
                        at = np.arange(p["pos"], p["pos"] + p["len"] - window + 1)
                        one, two = (x.view(np.int64).tolist() for x in rolled.runs(at, window))
                        out += [(None, doc, row, p["pos"], a, None, x, y) for a, x, y in zip(range(len(at)), one, two)]
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    names = ["shard", "doc", "row", "pos", "at", "words", "w1", "w2"]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    joined = docs.join(wanted.withColumnRenamed("doc", "__d").withColumnRenamed("row", "__r"),
                       (F.col("doc") == F.col("__d")) & (F.col("row") == F.col("__r")))
    return joined.select("doc", "row", "text", "parts").mapInArrow(run, "shard long, doc long, row long, pos int, at int, words binary, w1 long, w2 long")


def _search(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """Intervals of words that smaller documents hold, by one FM-index per shard."""
    def solve(rows):
        docs, lengths, ids, words = np.array([r[1] for r in rows]), [], [], {}
        for r in rows:
            part = [words.setdefault(w, len(words) + 1) for w in r[5].split()]
            lengths.append(len(part))
            ids += part
        which, first, last = repeated_intervals(docs, np.array(lengths), np.array(ids, dtype=np.int64), window)
        pos = np.array([r[3] for r in rows])[which]
        row = np.array([r[2] for r in rows])[which]
        return pa.RecordBatch.from_arrays(
            [pa.array(docs[which]), pa.array(row), pa.array(pos.astype(np.int32)), pa.array(first.astype(np.int32)),
             pa.array((last + window).astype(np.int32))], names=["doc", "row", "pos", "first", "last"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != now and rows:
                    yield solve(rows)
                    rows = []
                now = r[0]
                rows.append(r)
        if rows:
            yield solve(rows)

    own = contents.where("shard is not null").select("shard", "doc", "row", "pos", "at", "words")
    return own.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, INTERVAL)


def removed_intervals(docs: DataFrame, scanned: DataFrame, window: int) -> DataFrame:
    """doc, row, first, last (one past): words that windows held by smaller documents cover."""
    all_segments = scanned.where("doc is not null").select("doc", "row", F.explode("segments").alias("s")).select("doc", "row", "s.*")
    shared = staged(all_segments.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor"), "substring-anchors")
    held = staged(all_segments.join(checked_broadcast(shared, BROADCAST_ROWS), "anchor", "left_semi"), "substring-held")
    key = ["anchor", "h1", "h2"]
    distinct = staged(held.groupBy(*key).agg(F.min(F.struct("doc", "row", "pos", "len")).alias("f")), "substring-distinct")
    others = staged(held.join(distinct, key).where("doc > f.doc or row <> f.row or pos <> f.pos").select(
        "doc", "row", "pos", "len", F.col("f.doc").alias("of"), F.col("f.row").alias("of_row"), F.col("f.pos").alias("of_pos")), "substring-others")
    copies = others.where("doc > of").select("doc", "row", F.col("pos").alias("first"), (F.col("pos") + F.col("len")).alias("last"))
    words = distinct.select(F.sum("f.len")).first()[0]
    if not words:
        return copies
    shards = max(1, -(-words // SHARD_WORDS))
    crowded = staged(distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(f"c > {HOT}").select("anchor"), "substring-hot")
    routed = distinct.join(crowded.withColumn("hot", F.lit(True)), "anchor", "left").select(
        "f.*", F.when(F.col("hot").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"))
    wanted = staged(routed.groupBy("doc", "row").agg(F.collect_list(F.struct("shard", "pos", "len")).alias("parts")), "substring-wanted")
    contents = staged(_cut(_only(docs, wanted), wanted, window), "substring-contents")
    found = _search(contents, shards, window)
    windows = contents.where("shard is null").select("doc", "row", "pos", "at", "w1", "w2")
    smallest = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"))
    apart = windows.join(smallest, ["w1", "w2"]).where("doc > least").select(
        "doc", "row", "pos", F.col("at").alias("first"), (F.col("at") + window).alias("last"))
    hits = staged(found.union(apart), "substring-hits")
    again = staged(others.where("doc = of").select("doc", F.col("of_row").alias("row"), F.col("of_pos").alias("pos"),
                                                   F.col("row").alias("to_row"), F.col("pos").alias("to")).distinct(), "substring-again")
    here = hits.select("doc", "row", F.col("pos") + F.col("first"), F.col("pos") + F.col("last"))
    there = hits.join(checked_broadcast(again, BROADCAST_ROWS), ["doc", "row", "pos"]).select(
        "doc", "to_row", F.col("to") + F.col("first"), F.col("to") + F.col("last"))
    return copies.union(here).union(there)


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents named in ``wanted``, before their text is shuffled (if the names are few enough to broadcast)."""
    n = wanted.count()
    if n > BROADCAST_ROWS:
        return docs
    names = wanted.select(F.col("doc").alias("__d"), F.col("row").alias("__r")).distinct()
    return docs.join(F.broadcast(names), (F.col("doc") == F.col("__d")) & (F.col("row") == F.col("__r")), "left_semi")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc", "xxhash64(cast(text as string)) row", "cast(text as string) text")
    scanned = staged(_scanned(rows, window, gram), "substring-scanned")
    removed = removed_intervals(rows, scanned, window)
    per_doc = staged(removed.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "substring-removed")

    def run(batches):
        for batch in batches:
            counts, digests = [], []
            for text, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = (text or "").encode("utf-8").split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, [g["first"] for g in gone], 1)
                np.add.at(change, [g["last"] for g in gone], -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                counts.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                                             names=["__d", "__r", "n_removed", "kept"])

    texts = _only(rows, per_doc).dropDuplicates(["doc", "row"]).join(
        per_doc.withColumnRenamed("doc", "__d").withColumnRenamed("row", "__r"), (F.col("doc") == F.col("__d")) & (F.col("row") == F.col("__r")))
    changed = texts.select("doc", "row", "text", "gone").mapInArrow(run, "__d long, __r long, n_removed long, kept string")
    return (scanned.select("doc", "row", "n_words", "sha").join(changed, (F.col("doc") == F.col("__d")) & (F.col("row") == F.col("__r")), "left")
            .select(F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("kept", "sha").alias("kept_sha256")))
