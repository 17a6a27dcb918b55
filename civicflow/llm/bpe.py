"""Operator 7: byte-level BPE encoding and decoding with a contiguous rank array.

A pre-token's bytes are held as one array of part boundaries' ids and one of the ranks of
adjacent pairs. The loop scans the rank array for its minimum (the leftmost on ties),
deletes that boundary and refreshes the two neighbouring ranks. Scanning is quadratic in the
pre-token, which is best for the short words that text is made of; a pre-token of more than
``SHORT`` bytes (a page of base64, say) uses the same rule over a heap and a linked list.

The work is one narrow pass: no shuffle, whole texts, and memory bounded by one Arrow batch,
the vocabulary and a table of at most ``MEMO`` chunks already encoded.

Defined cases: null text is encoded as the empty text (no ids, decoded ''); the strings of
added tokens in a text become their ids, as the tokenizers library does; rows keep their
multiplicity, null doc_id included; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from civicflow.llm.common import ship

VOCABULARY = "byte_bpe_50k.json"
SHORT = 128
MEMO = 1_000_000
NONE = 1 << 60
#: Below this character Python and the pattern agree on what a letter is.
LATIN_END = "\u0250"
#: A space at either end or next to another blank: where a cut before it would not be safe.
BLANKS = re.compile(r"\s | \s|^ | $")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies are written in."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        shown = byte_alphabet()
        hidden = {c: b for b, c in shown.items()}
        self.first = [vocab[shown[b]] for b in range(256)]
        merges = spec["model"]["merges"]
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            self.ranks.setdefault((vocab[left], vocab[right]), rank)
        self.made = [vocab[left + right] for left, right in merges]
        self.bytes_of = {i: bytes(hidden[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.names = {i: str(i) for i in self.bytes_of}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.pre = regex.compile(public_tokenizers.PATTERN)
        self.memo: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.sizes: dict[str, int] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in piece]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NONE) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((new, ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], new), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank_of, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank_of((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def chunks(self, text: str) -> list[str]:
        """Cuts before every single space between two non-blank characters, where the
        pre-token pattern always cuts too; a chunk never depends on its neighbours."""
        parts = text.split(" ")
        if not BLANKS.search(text):
            parts[1:] = [" " + p for p in parts[1:]]
            return [p for p in parts if p]
        out, open_ = [], ""
        for k, part in enumerate(parts):
            open_ += part if k == 0 else " " + part
            after = parts[k + 1] if k + 1 < len(parts) else None
            if after is None or part and after and not part[-1].isspace() and not after[0].isspace():
                out.append(open_)
                open_ = ""
        return [p for p in out if p]

    def chunk(self, text: str) -> tuple[tuple[int, ...], str, bytes]:
        """(ids, their decimal text, decoded bytes) of one chunk."""
        known = self.memo.get(text)
        if known is not None:
            return known
        if text[-1] in ".," and text[1:-1].isalpha() and max(text) < LATIN_END:  # a word, likely known, and a mark
            (ids, shown, raw), (end, mark, tail) = self.chunk(text[:-1]), self.chunk(text[-1])
            return ids + end, f"{shown},{mark}", raw + tail
        ids, names = self.chunk_ids(text), self.names
        known = (tuple(ids), ",".join([names[i] for i in ids]), self.decode_bytes(ids))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(text) <= SHORT:
            self.memo[text] = known
        return known

    def chunk_ids(self, text: str) -> list[int]:
        if text[1:].isalpha() and max(text) < LATIN_END and (text[0] == " " or text[0].isalpha()):  # one pre-token
            return self.merge(text.encode("utf-8"))
        return [i for m in self.pre.finditer(text) for i in self.merge(m.group().encode("utf-8"))]

    def counts(self, chunks: list[str]) -> list[int]:
        """Number of ids of each chunk; added tokens count as one."""
        get = self.sizes.get
        out = [get(c) for c in chunks]
        if None in out:
            out = [self.size(c) if n is None else n for c, n in zip(chunks, out)]
        return out

    def size(self, chunk: str) -> int:
        known = self.sizes.get(chunk)
        if known is not None:
            return known
        if self.cut_added and self.cut_added.search(chunk):
            return len(self.encode(chunk))
        if chunk[-1:] in (".", ",") and chunk[1:-1].isalpha() and max(chunk) < LATIN_END:
            return self.size(chunk[:-1]) + self.size(chunk[-1])
        known = len(self.chunk_ids(chunk)) if chunk else 0
        if len(self.sizes) >= MEMO:
            self.sizes.clear()
        if len(chunk) <= SHORT:
            self.sizes[chunk] = known
        return known

    def encoded(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """The chunks of a whole text, encoded; added tokens stand by themselves."""
        out, known = [], self.memo.get
        for part in self.cut_added.split(text) if self.cut_added else [text]:
            if part in self.added:
                i = self.added[part]
                out.append(((i,), str(i), self.bytes_of[i]))
            elif part:
                out += [known(c) or self.chunk(c) for c in self.chunks(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in self.encoded(text) for i in c[0]]

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.bytes_of.get(i, b"") for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (see module docstring)."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        c = codec(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                parts = c.encoded(text or "")
                counts.append(sum([len(p[0]) for p in parts]))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts if p[1]]).encode()).hexdigest())
                whole = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(whole.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the token ids themselves, for writers and packers."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, ids array<int>")
