"""Operator 12: scores of an interpolated modified Kneser-Ney word model.

The model is of order two: the probability of a word after its predecessor, interpolated with the
word's continuation probability (in how many contexts it stands) and that with the uniform one:

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) * q(w)
    q(w)     = max(n(w) - E(n), 0) / n + g / (V + 1)

``D`` and ``E`` have one discount for counts of 1, 2 and 3 or more, from the counts of counts; ``g``
hands on exactly what was discounted, so the probabilities over the vocabulary and one unknown
word sum to 1. An unseen context gives q(w). All counts cover all training documents.

1. *Blocks.* A pass over the texts writes the tokens as numbers: blocks of about ``BLOCK_TOKENS`` tokens,
   with their distinct 64-bit word hashes and an index a token. No later step reads a text.
2. *Words.* Each block sends its distinct words, by hash range, to shards of about ``SHARD_TOKENS``
   tokens; a shard sums the counts.
3. *Pairs.* Each block sends its distinct (context, word) pairs once, with their training counts, to the
   shard of the context. The shard merges them into sorted arrays (contexts, offsets, word hashes,
   counts), writes them to a file under ``spark.checkpoint.dir``, memory-maps it and answers each
   block with the counts of the pairs it sent. A context with ``T`` or more tokens is split by word over several
   shards; its sums, at most ``HOT_LIMIT`` rows, are added up and go to all tasks.
4. *Continuations.* The shards send the contexts counted per word to the word shards, which write and
   map their sorted arrays (hash, count, contexts) and answer the blocks.
5. *Scores.* A block with its answers gives the logarithms of its tokens and their sums by document.

What is shuffled are distinct words and pairs of a block, in packed arrays, so a word or passage that
a third of all rows hold is sent once a block. Nothing is kept by count: no vocabulary limit,
no pruning. The files stay with the model: ``score(docs, fit(...))`` maps them again for other texts.

Words in contexts are told apart by 48 hash bits within one context (64 for words and contexts): two
words that agree in them would share a count.

Defined cases: null text is the empty text (one end token); rows with null doc_id learn and are not
held out; repeated rows count each; without training tokens every probability is 1; if a count of
counts is zero its discounts are 0.5, 1 and 1.5; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import ship, staged, staging_dir
from civicflow.llm.jaccard import mix
from civicflow.llm.token_files import open_fs, qualified

HELD_OUT = 10
BLOCK_TOKENS = 2_000_000
SHARD_TOKENS = 2_000_000
HOT_LIMIT = 2_000_000  # contexts that may be split; 40 bytes each on every task
PART = 1 << 22  # bytes of text tokenised at a time
PRIOR = 0.1
END = xxhash.xxh64_intdigest(b" end")  # words hold no space
BEGIN = xxhash.xxh64_intdigest(b" begin")
FALLBACK = (0.5, 1.0, 1.5)
SUFFIX_BITS = 48
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_KIND = ("kind string, block long, shard int, uri string, nums array<long>, a binary, b binary, c binary, d binary, e binary, f binary")
_SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("shard", pa.int32()), ("uri", pa.string()),
                     ("nums", pa.list_(pa.int64())), *((x, pa.binary()) for x in "abcdef")])
_ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _row(kind, block=None, shard=None, uri=None, nums=None, **arrays):
    return {"kind": kind, "block": block, "shard": shard, "uri": uri, "nums": nums, **{k: v.tobytes() for k, v in arrays.items()}}


def _table(rows) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``staged``, its shuffle files removed once the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


# --- blocks ---------------------------------------------------------------------------------------

def _hashes(texts: pa.Array):
    """Word hashes and number of words of each text, by slices of about ``PART`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts, cuts[1:]):
        if j == i:
            continue
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(i, j - i), "")))
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        doc = np.repeat(np.arange(j - i), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        sizes = np.bincount(doc[full.to_numpy(zero_copy_only=False)], minlength=j - i)
        coded = flat.filter(full).dictionary_encode()
        known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
        yield i, j, sizes, known[coded.indices.to_numpy()]


def _block_row(parts, number: int):
    """Tokens of a block: doc ids, flags, sizes (with the end), distinct hashes, an index a token."""
    sizes = np.concatenate([p[2] for p in parts])
    words = np.concatenate([p[3] for p in parts])
    tokens = np.empty(len(words) + len(sizes), dtype=np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
    tokens[np.cumsum(sizes + 1) - 1] = END
    vocabulary, index, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent words first: small numbers pack better
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return _row("block", number, nums=[len(tokens), len(sizes), len(vocabulary)], a=np.concatenate([p[0] for p in parts]), b=np.concatenate([p[1] for p in parts]),
                d=(sizes + 1).astype("<u4"), e=vocabulary[order]) | {"f": _packed(rank[index])}


def _packed(index: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(index.astype("<u4").view("u1").reshape(-1, 4).T))


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0).alias("held"))

    def run(batches):
        parts, tokens, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            state = (pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False).astype("u1")
                     + 2 * batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1"))
            for i, j, sizes, words in _hashes(batch.column(1)):
                parts.append((ids[i:j], state[i:j], sizes, words))
                tokens += len(words) + j - i
                if tokens >= BLOCK_TOKENS:
                    yield from _table([_block_row(parts, number)]).to_batches()
                    parts, tokens, number = [], 0, number + 1
        if parts:
            yield from _table([_block_row(parts, number)]).to_batches()

    return rows.mapInArrow(run, _KIND)


@dataclass
class Block:
    number: int
    doc_ids: np.ndarray
    state: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, row):
        words, index = np.frombuffer(row["e"], "<u8"), _unpacked(row["f"])
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return cls(row["block"], np.frombuffer(row["a"], "<i8"), np.frombuffer(row["b"], "u1"), np.frombuffer(row["d"], "<u4").astype(np.int64),
                   words[order], place[index])

    def learns(self) -> np.ndarray:
        return np.repeat(self.state & 1 == 0, self.sizes)

    def pairs(self):
        """(context, word, inverse): indices of the distinct pairs, in hash order with BEGIN last, and the pair of each token."""
        n = len(self.vocabulary)
        before = np.empty(len(self.index), dtype=np.int64)
        before[1:] = self.index[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = n
        code, inverse = np.unique(before * (n + 1) + self.index, return_inverse=True)
        return code // (n + 1), code % (n + 1), inverse


def _rows_of(batches):
    for batch in batches:
        yield from batch.to_pylist()


# --- shards ---------------------------------------------------------------------------------------

def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: shards of a sorted array are slices of it."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair_shards(context: np.ndarray, suffix: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of each pair: that of its context, for split contexts one of ``hot[1]`` by word."""
    out = shard_of(context, shards)
    at, found = _search(hot[0], context)
    if found.any():
        ways = hot[1][at[found]]
        out[found] = (out[found] + (mix(suffix[found]) % ways.astype(np.uint64)).astype(np.int64)) % shards
    return out


def _search(keys: np.ndarray, wanted: np.ndarray):
    """(place, found) of each wanted number in a sorted array."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, those of 255 and more in an array of their own."""
    return np.minimum(counts, 255).astype("u1"), counts[counts >= 255].astype("<u8")


def _unsmall(low: np.ndarray, big: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[low == 255] = big.astype(np.int64)
    return out


def _write(root: str, name: str, arrays: list[np.ndarray]) -> str:
    """A file of arrays, each at a multiple of eight bytes, under a name of its own: a repeated task writes another."""
    fs, base = open_fs(root)
    path = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{base}/{path}") as f:
        f.write(np.array([len(a) for a in arrays], dtype="<i8").tobytes())
        for a in arrays:
            raw = a.tobytes()
            f.write(raw + b"\0" * (-len(raw) % 8))
    return f"{root}/{path}"


def _map(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; a file of another file system is fetched first."""
    fs, path = open_fs(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        with fs.open_input_stream(path) as f, tempfile.NamedTemporaryFile(delete=False) as local:
            shutil.copyfileobj(f, local)
        path = local.name
    whole = np.memmap(path, mode="r", dtype="u1")
    if not isinstance(fs, pafs.LocalFileSystem):
        os.unlink(path)  # stays mapped
    lengths, at, out = whole[: 8 * len(kinds)].view("<i8"), 8 * len(kinds), []
    for n, kind in zip(lengths.tolist(), kinds):
        size = n * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size + -size % 8
    return out


class PairShard:
    """Sorted arrays of one shard: contexts, offsets, words of each context, counts."""

    KINDS = ["<u8", "<u4", "<u4", "<u2", "u1", "<u8"]

    def __init__(self, uri: str):
        self.contexts, self.offsets, self.low, self.high, small, big = _map(uri, self.KINDS)
        self.counts = _unsmall(small, big)
        classes = [self.counts, self.counts == 1, self.counts == 2, self.counts >= 3]
        self.sums = np.stack([np.add.reduceat(c.astype(np.int64), self.offsets[:-1].astype(np.int64)) for c in classes]
                             ) if len(self.contexts) else np.zeros((4, 0), np.int64)

    @classmethod
    def write(cls, root: str, name: str, context: np.ndarray, suffix: np.ndarray, counts: np.ndarray) -> str:
        """Pairs in the order of (context, suffix)."""
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        small, big = _small(counts)
        return _write(root, name, [context[first], np.append(first, len(context)).astype("<u4"), (suffix & np.uint64(0xFFFFFFFF)).astype("<u4"),
                                   (suffix >> np.uint64(32)).astype("<u2"), small, big])

    def stats(self, contexts: np.ndarray) -> np.ndarray:
        """Tokens and words counted once, twice, more often, of each context: four rows."""
        at, found = _search(self.contexts, contexts)
        return np.where(found, self.sums[:, at], 0) if len(self.contexts) else np.zeros((4, len(contexts)), np.int64)

    def count(self, contexts: np.ndarray, runs: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Counts of pairs, given as contexts with so many words each: binary search in each context."""
        if not len(self.contexts) or not len(suffix):
            return np.zeros(len(suffix), np.int64)
        at, found = _search(self.contexts, contexts)
        low = np.repeat(np.where(found, self.offsets[at], 0).astype(np.int64), runs)
        high = np.repeat(np.where(found, self.offsets[at + 1], 0).astype(np.int64), runs)
        end = high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            less = self.suffix(mid) < suffix[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        place = np.minimum(low, len(self.counts) - 1)
        return np.where((low < end) & (self.suffix(place) == suffix), self.counts[place], 0)

    def suffix(self, place: np.ndarray) -> np.ndarray:
        return self.low[place].astype(np.uint64) | self.high[place].astype(np.uint64) << np.uint64(32)


class WordShard:
    """Sorted arrays of one shard: word hashes, counts, contexts."""

    KINDS = ["<u8", "<u8", "<u8"]

    def __init__(self, uri: str):
        self.words, self.counts, self.contexts = _map(uri, self.KINDS)

    def answer(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, found = _search(self.words, words)
        if not len(self.words):
            return np.zeros(len(words), "<u8"), np.zeros(len(words), "<u8")
        return np.where(found, self.counts[at], 0).astype("<u8"), np.where(found, self.contexts[at], 0).astype("<u8")


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


# --- the model ------------------------------------------------------------------------------------

def discounts(of: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items counted 1, 2, 3 and 4 times."""
    if not all(of):
        return FALLBACK
    y = of[0] / (of[0] + 2 * of[1])
    return tuple(min(max(k - (k + 1) * y * of[k] / of[k - 1], 0.01), float(k)) for k in (1, 2, 3))


@dataclass
class Model:
    """``files``: a row per shard file (kind, shard, uri), and the numbers that every task gets."""

    files: DataFrame | None
    shards: int
    tokens: int  # of training
    words: int  # distinct ones
    hot: tuple[np.ndarray, np.ndarray]  # split contexts and the number of shards of each
    hot_stats: np.ndarray | None = None
    pair_discounts: tuple = FALLBACK
    word_discounts: tuple = FALLBACK
    word_classes: tuple = (0, 0, 0, 0)  # distinct pairs; words with one, two, more contexts

    def unigram(self, contexts: np.ndarray) -> np.ndarray:
        """q(w) of words with so many contexts."""
        total = self.word_classes[0]
        if not total:
            return np.full(len(contexts), 1.0 / (self.words + 1))
        left = sum(d * n for d, n in zip(self.word_discounts, self.word_classes[1:])) / total
        taken = np.array([0.0, *self.word_discounts])[np.minimum(contexts, 3)]
        return (contexts - taken) / total + left / (self.words + 1)

    def probability(self, counts: np.ndarray, stats: np.ndarray, q: np.ndarray) -> np.ndarray:
        """p(w | v) from the pair's count, the four sums of its context and q(w)."""
        total = np.maximum(stats[0], 1)
        taken = np.array([0.0, *self.pair_discounts])[np.minimum(counts, 3)]
        left = sum(d * n for d, n in zip(self.pair_discounts, stats[1:])) / total
        return np.where(stats[0] > 0, (counts - taken) / total + left * q, q)


def _word_asks(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block): distinct words, occurrences, occurrences in training."""
    def run(batches):
        for row in _rows_of(batches):
            b = Block.of(row)
            n = len(b.vocabulary)
            every = np.bincount(b.index, minlength=n)
            learnt = np.bincount(b.index[b.learns()], minlength=n)
            shard = shard_of(b.vocabulary, shards)
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [n]
            for i, j in zip(cuts, cuts[1:]):
                yield from _table([_row("ask", b.number, int(shard[i]), a=b.vocabulary[i:j], b=every[i:j].astype("<u4"), c=learnt[i:j].astype("<u4"))]).to_batches()

    return blocks.mapInArrow(run, _KIND)


def _arrays(table: pa.Table, kind: str):
    return table.filter(pc.equal(table["kind"], kind)).to_pylist()


def _word_counts(asks: DataFrame, hot_from: int) -> DataFrame:
    """A row per shard: words with training counts above 0, the words with ``hot_from`` tokens, totals."""
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, inverse = np.unique(np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows]), return_inverse=True)
        every, learnt = (np.bincount(inverse, weights=np.concatenate([np.frombuffer(r[k], "<u4") for r in rows]), minlength=len(words)).astype("<u8") for k in "bc")
        is_hot, known = every >= hot_from, learnt > 0
        return _table([_row("count", None, rows[0]["shard"], nums=[int(learnt.sum()), int(known.sum())], a=words[known], b=learnt[known], c=words[is_hot], d=every[is_hot])])

    return asks.groupBy("shard").applyInArrow(merge, _KIND)


def _pair_asks(blocks: DataFrame, shards: int, hot) -> DataFrame:
    """(shard, block): contexts, words a context, the words, training counts of the distinct pairs."""
    def run(batches):
        for row in _rows_of(batches):
            b = Block.of(row)
            context, word, inverse = b.pairs()
            learnt = np.bincount(inverse[b.learns()], minlength=len(context))
            del inverse
            for shard, chosen, h, suffix in _dealt(b, context, word, shards, hot):
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                small, big = _small(learnt[chosen])
                yield from _table([_row(
                    "ask", b.number, shard, a=h[first], b=np.diff(np.append(first, len(h))).astype("<u4"), c=(suffix & np.uint64(0xFFFFFFFF)).astype("<u4"),
                    d=(suffix >> np.uint64(32)).astype("<u2"), e=small, f=big)]).to_batches()

    return blocks.mapInArrow(run, _KIND)


def _dealt(b: Block, context: np.ndarray, word: np.ndarray, shards: int, hot):
    """(shard, its pairs, their context hashes, their word hashes), one shard after the other."""
    hashes = np.append(b.vocabulary, np.uint64(BEGIN))[context]
    suffix = b.vocabulary[word] >> np.uint64(64 - SUFFIX_BITS)
    shard = _pair_shards(hashes, suffix, shards, hot)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)).tolist() + [len(order)]
    for i, j in zip(cuts, cuts[1:]):
        chosen = order[i:j]
        yield int(shard[order[i]]), chosen, hashes[chosen], suffix[chosen]


def _pair_answers(asks: DataFrame, model: Model, root: str | None) -> DataFrame:
    """Per shard: the file (written to ``root``, or a row of ``asks`` names it), the answers to the blocks; when
    written, also the contexts counted per word and the sums of split contexts."""
    shards, hot = model.shards, model.hot

    def run(table: pa.Table) -> pa.Table:
        rows, out = _arrays(table, "ask"), []
        number = table["shard"][0].as_py()
        asked = [(r["block"], np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u4").astype(np.int64),
                  np.frombuffer(r["c"], "<u4").astype(np.uint64) | np.frombuffer(r["d"], "<u2").astype(np.uint64) << np.uint64(32),
                  r["e"], r["f"]) for r in rows]
        if root is None:
            named = _arrays(table, "pairs")
            uri = named[0]["uri"] if named else None
        else:
            counts = np.concatenate([_unsmall(np.frombuffer(e, "u1"), np.frombuffer(f, "<u8")) for *_, e, f in asked])
            learnt = counts > 0  # pairs that only held-out documents hold are not in the model
            context = np.concatenate([np.repeat(c, n) for _, c, n, *_ in asked])[learnt]
            suffix, counts = np.concatenate([s for _, _, _, s, *_ in asked])[learnt], counts[learnt]
            order = np.lexsort((suffix, context))
            context, suffix, counts = context[order], suffix[order], counts[order]
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1]))) if len(order) else order
            counts = np.add.reduceat(counts, first) if len(first) else counts
            context, suffix = context[first], suffix[first]
            uri = PairShard.write(root, f"pairs-{number}", context, suffix, counts)
            out.append(_row("pairs", None, number, uri, [len(counts), *_counts_of_counts(counts)]))
            words, contexts = np.unique(suffix, return_counts=True)
            home = shard_of(words << np.uint64(64 - SUFFIX_BITS), shards)
            for k in np.unique(home).tolist():
                small, big = _small(contexts[home == k])
                out.append(_row("next", None, k, a=words[home == k], b=small, c=big))
        shard = PairShard(uri) if uri else None
        if root is not None:
            at, found = _search(hot[0], shard.contexts)
            out.append(_row("hot", None, number, a=at[found].astype("<i8"), b=shard.sums[:, found].T.astype("<i8")))
        for block, contexts, runs, suffix, *_ in asked:
            if shard is None:
                stats, found = np.zeros((4, len(contexts)), np.int64), np.zeros(len(suffix), np.int64)
            else:
                stats, found = shard.stats(contexts), shard.count(contexts, runs, suffix)
            small, big = _small(found)
            out.append(_row("pair", block, number, a=stats.astype("<u8").astype("<u4") if stats.max(initial=0) < 1 << 32 else stats.astype("<u8"), b=small, c=big, d=runs.astype("<u4")))
        return _table(out)

    return asks.groupBy("shard").applyInArrow(run, _KIND)


def _word_answers(rows: DataFrame, root: str | None) -> DataFrame:
    """Per shard: the file (made of rows "count" and "next", or named by a row "words"), the answers to the rows "ask"."""
    def run(table: pa.Table) -> pa.Table:
        number, out = table["shard"][0].as_py(), []
        if root is None:
            named = _arrays(table, "words")
            uri = named[0]["uri"] if named else None
        else:
            count, nexts = _arrays(table, "count"), _arrays(table, "next")
            words = np.frombuffer(count[0]["a"], "<u8") if count else np.zeros(0, "<u8")
            learnt = np.frombuffer(count[0]["b"], "<u8") if count else np.zeros(0, "<u8")
            keys = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r["a"], "<u8") for r in nexts)])
            parts = np.concatenate([np.zeros(0, np.int64), *(_unsmall(np.frombuffer(r["b"], "u1"), np.frombuffer(r["c"], "<u8")) for r in nexts)])
            known, inverse = np.unique(keys, return_inverse=True)
            totals = np.bincount(inverse, weights=parts, minlength=len(known)).astype(np.int64)
            at, found = _search(known, words >> np.uint64(64 - SUFFIX_BITS))
            contexts = np.where(found, totals[at], 0) if len(known) else np.zeros(len(words), np.int64)
            uri = _write(root, f"words-{number}", [words, learnt, contexts.astype("<u8")])
            classes = [int(contexts.sum()), int((contexts == 1).sum()), int((contexts == 2).sum()), int((contexts >= 3).sum())]
            out.append(_row("words", None, number, uri, [*classes, *_counts_of_counts(contexts)]))
        shard = WordShard(uri) if uri else None
        for r in _arrays(table, "ask"):
            words = np.frombuffer(r["a"], "<u8")
            counts, contexts = shard.answer(words) if shard else (np.zeros(len(words), "<u8"),) * 2
            (a, b), (c, d) = _small(counts), _small(contexts)
            out.append(_row("word", r["block"], number, a=a, b=b, c=c, d=d))
        return _table(out)

    return rows.groupBy("shard").applyInArrow(run, _KIND)


def _scores(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    model = replace(model, files=None)  # the tasks need its numbers

    def run(table: pa.Table) -> pa.Table:
        b = Block.of(_arrays(table, "block")[0])
        words = sorted(_arrays(table, "word"), key=lambda r: r["shard"])  # in the order of the vocabulary
        counts, contexts = (np.concatenate([_unsmall(np.frombuffer(r[x], "u1"), np.frombuffer(r[y], "<u8")) for r in words]) for x, y in ("ab", "cd"))
        q = model.unigram(contexts)
        base = np.log10((counts + PRIOR) / (model.tokens + PRIOR * (model.words + 1)))
        context, word, inverse = b.pairs()
        logs = np.empty(len(context))
        answer = {r["shard"]: r for r in _arrays(table, "pair")}
        for shard, chosen, hashes, _ in _dealt(b, context, word, model.shards, model.hot):
            r = answer[shard]
            runs = np.frombuffer(r["d"], "<u4").astype(np.int64)
            stats = np.frombuffer(r["a"], f"<u{len(r['a']) // max(1, 4 * len(runs))}").reshape(4, -1).astype(np.int64)
            at, found = _search(model.hot[0], hashes[np.cumsum(runs) - runs])
            if found.any():  # a split context: the sums over its shards
                stats = np.where(found, model.hot_stats[:, at], stats)
            logs[chosen] = np.log10(model.probability(_unsmall(np.frombuffer(r["b"], "u1"), np.frombuffer(r["c"], "<u8")), np.repeat(stats, runs, axis=1), q[word[chosen]]))
        first = np.cumsum(b.sizes) - b.sizes
        sums = [np.add.reduceat(x, first) for x in ((counts > 0)[b.index].astype(np.int64), base[b.index], logs[inverse])]
        held = b.state & 1 == 1
        return pa.Table.from_arrays([pa.array(b.doc_ids, mask=b.state >= 2), pa.array(held), pa.array(b.sizes), pa.array(sums[0]),
                                     pa.array(np.full(len(first), model.tokens)), pa.array(sums[1]), pa.array(sums[2])], schema=_ROW_SCHEMA)

    return blocks.unionByName(answers).groupBy("block").applyInArrow(run, _ROWS)


def _sum(df: DataFrame, kind: str, n: int) -> list[int]:
    """Sums of the first ``n`` numbers of the rows of a kind."""
    row = df.where(F.col("kind") == kind).agg(*(F.sum(F.col("nums")[k]) for k in range(n))).first()
    return [int(x or 0) for x in row]


def _learn(blocks: DataFrame):
    """(model, answers to the blocks)."""
    spark = blocks.sparkSession
    root = qualified(spark, staging_dir(spark, "ngram"))
    fs, local = open_fs(root)
    fs.create_dir(local, recursive=True)
    every, documents = _sum(blocks, "block", 2)
    shards, hot_from = max(1, -(-every // SHARD_TOKENS)), max(SHARD_TOKENS // 8, every // HOT_LIMIT)
    asks = _word_asks(blocks, shards)
    counts = _kept(_word_counts(asks, hot_from), "ngram-counts")
    tokens, words = _sum(counts, "count", 2)
    found = {BEGIN: documents} if documents >= hot_from else {}
    for r in counts.select("c", "d").where("length(c) > 0").collect():  # HOT_LIMIT words at most
        found.update(zip(np.frombuffer(r["c"], "<u8").tolist(), np.frombuffer(r["d"], "<u8").tolist()))
    found.pop(END, None)  # no context
    names = np.array(sorted(found), dtype=np.uint64)
    model = Model(counts, shards, tokens, words, (names, np.array([min(shards, -(-found[w] // hot_from)) for w in names.tolist()], dtype=np.int64)))
    pairs = _kept(_pair_answers(_pair_asks(blocks, shards, model.hot), model, root), "ngram-pairs")
    stats = np.zeros((4, len(names)), dtype=np.int64)

    def hot_rows(batches):
        for row in _rows_of(batches):
            at, sums = np.frombuffer(row["a"], "<i8"), np.frombuffer(row["b"], "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[:, k]) for k in range(4))], names=["at", "s0", "s1", "s2", "s3"])

    split = pairs.where("kind = 'hot' AND length(a) > 0").mapInArrow(hot_rows, "at long, s0 long, s1 long, s2 long, s3 long")
    for r in split.groupBy("at").agg(*(F.sum(f"s{k}") for k in range(4))).collect():
        stats[:, r[0]] = r[1:]
    model.hot_stats = stats
    model.pair_discounts = discounts(_sum(pairs, "pairs", 5)[1:])
    answered = _kept(_word_answers(counts.union(pairs.where("kind = 'next'")).unionByName(asks), root), "ngram-words")
    classes = _sum(answered, "words", 8)
    model.word_classes, model.word_discounts = tuple(classes[:4]), discounts(classes[4:])
    model.files = pairs.where("kind = 'pairs'").union(answered.where("kind = 'words'"))
    return model, pairs.where("kind = 'pair'").union(answered.where("kind = 'word'"))


def fit(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    ship(docs.sparkSession)
    return _learn(_kept(_blocks(docs), "ngram-blocks"))[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of any documents under a model: the columns of ``score_documents``."""
    ship(docs.sparkSession)
    blocks = _kept(_blocks(docs), "ngram-asking")
    pairs = _pair_answers(_pair_asks(blocks, model.shards, model.hot).unionByName(model.files.where("kind = 'pairs'")), model, None)
    words = _word_answers(_word_asks(blocks, model.shards).unionByName(model.files.where("kind = 'words'")), None)
    answers = _kept(pairs.where("kind = 'pair'").union(words.where("kind = 'word'")), "ngram-answers")
    return _scores(blocks, answers, model)


def perplexity(scores: DataFrame):
    """Perplexity of a corpus from its scores, as an aggregate column."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document, the
    model being that of the documents that are not held out."""
    ship(docs.sparkSession)
    blocks = _kept(_blocks(docs), "ngram-blocks")
    model, answers = _learn(blocks)
    return _scores(blocks, answers, model)
