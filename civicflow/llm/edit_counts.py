"""Operator 10: token counts that follow edits.

Every document keeps a segment tree over its pre-tokens. A leaf is a run of pre-tokens
between two safe cuts (in prose one word with its leading space); inner nodes hold the sums
of characters and of tokens below. An edit finds its leaves by descending on the character
sums, re-encodes only these leaves and one leaf of context on either side (a cut depends on
no character beyond that), and updates the sums on the paths to the root: O(touched text +
log n) an edit, whatever the length of the document.

The work is one narrow pass: a document's tree lives only while its row is processed.

Defined cases: null text is the empty text; null or empty edits leave the counts; positions
are clamped to the text as it is when the edit comes, an end before its start counts as the
start, a null position as 0 (start) or the start (end), a null replacement as ''; rows keep
their multiplicity, null doc_id included.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.bpe import VOCABULARY, Codec, codec
from civicflow.llm.common import ship

EDITS = "array<struct<start:long,end:long,text:string>>"


class CountTree:
    """Token count of one text under edits."""

    def __init__(self, text: str, c: Codec):
        self.codec = c
        self.leaves = c.chunks(text)
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars = self.sums([len(leaf) for leaf in self.leaves])
        self.tokens = self.sums(c.counts(self.leaves))
        self.leaves += [""] * (self.size - len(self.leaves))
        self.encoded_chars = 0

    def sums(self, values: list[int]) -> list[int]:
        """Leaf values and, level by level, the sums above them; the root is at 1."""
        out = np.zeros(2 * self.size, dtype=np.int64)
        out[self.size : self.size + len(values)] = values
        level = self.size
        while level > 1:
            out[level // 2 : level] = out[level : 2 * level : 2] + out[level + 1 : 2 * level : 2]
            level //= 2
        return out.tolist()

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character ``at``, or the last one, its first character)."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def neighbour(self, leaf: int, step: int) -> int:
        """The nearest leaf with text on that side, or the leaf itself at the end."""
        node = leaf + self.size
        while node > 1:
            side = node + step
            if (node & 1 == 0) == (step > 0) and self.chars[side]:
                node = side
                while node < self.size:
                    near = 2 * node + (step < 0)
                    node = near if self.chars[near] else near ^ 1
                return node - self.size
            node //= 2
        return leaf

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, _ = self.find(max(start - 1, 0))
        last, _ = self.find(end)
        first, last = self.neighbour(first, -1), self.neighbour(last, 1)
        before = self.chars_before(first)
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - before] + replacement + old[end - before :]
        parts = self.codec.chunks(new)
        room = last - first + 1
        if len(parts) > room:  # the tree keeps its shape: the last leaf holds a longer run
            parts[room - 1 :] = ["".join(parts[room - 1 :])]
        parts += [""] * (room - len(parts))
        for i, part in enumerate(parts, first):
            self.leaves[i] = part
            self.chars[self.size + i] = len(part)
            self.tokens[self.size + i] = self.codec.size(part)
            self.encoded_chars += len(part)
        low, high = first + self.size, last + self.size
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def chars_before(self, leaf: int) -> int:
        node, total = leaf + self.size, 0
        while node > 1:
            if node & 1:
                total += self.chars[node - 1]
            node //= 2
        return total


def recount(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text, edits)`` -> doc_id, n_before, n_tokens (after all edits, in
    order), n_edits, n_chars (after), n_encoded (characters that were encoded again)."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "n_before", "n_tokens", "n_edits", "n_chars", "n_encoded"]

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text, edits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tree = CountTree(text or "", c)
                row = [doc_id, tree.total]
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                for to, value in zip(rows, [*row, tree.total, len(edits), tree.length, tree.encoded_chars]):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=names)

    return docs.select(F.expr("cast(doc_id as long) doc_id"), F.expr("cast(text as string) text"),
                       F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


#: What the revisions of ``revision_edits`` write; the empty one is a deletion.
PHRASES = ("", " corrected", ", see note 12.", "\n\n", " (revised 2024-05-01)", "-", " über", "The editors removed a sentence here. ")


def revision_edits(docs: DataFrame) -> DataFrame:
    """A revision of every document, as edits: one for each started 1,000 characters, at a
    place drawn from (doc_id, number). It replaces up to 40 characters by one of ``PHRASES``."""
    phrases = "array(" + ", ".join("'" + p.replace("\n", "\\n") + "'" for p in PHRASES) + ")"
    at = "pmod(xxhash64(doc_id, i), n + 1)"
    return docs.selectExpr("doc_id", "text", "cast(length(coalesce(text, '')) as long) n").selectExpr(
        "doc_id", "text",
        f"""transform(sequence(0L, n div 1000), i -> named_struct(
              'start', {at}, 'end', {at} + pmod(xxhash64(i, doc_id), 41),
              'text', element_at({phrases}, cast(1 + pmod(xxhash64(doc_id, i, 9), {len(PHRASES)}) as int)))) edits""")
