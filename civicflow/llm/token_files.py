"""Operator 6: token ids in binary files, compressed with one shared zstandard dictionary.

File format, one file per range of doc_id (little-endian throughout):

    8 bytes   magic ``CFTOKEN1``
    32 bytes  sha256 of the dictionary the frames need
    frames    one zstandard frame per document: its ids as unsigned 32-bit integers
    index     for each document: doc_id int64, has_id uint8, offset uint64, n_tokens uint64
              (four arrays, one after the other)
    16 bytes  offset of the index uint64, number of documents uint64

A reader of one short document reads the index, then the bytes of one frame. The dictionary
is trained once, on the id arrays of about ``SAMPLE_DOCS`` documents chosen by a hash of the
id, each cut to ``SAMPLE_BYTES`` (a bounded sample for the compression model only; every
document is written whole), and is stored beside the files under its hash.

Rows are range-partitioned and sorted by (doc_id, hash of the text), so files follow each
other in doc_id order and equal or missing ids can still be spread over files. A task writes
its file under a name of its own and reports it; only reported files are in the manifest, so
a repeated or speculative task leaves no duplicate.

Defined cases: null text is the empty text (only the end id); rows with equal doc_id are all
written, ordered by the hash of their text; a null doc_id sorts first and reads back as null;
an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicflow.llm.common import ship, staging_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
MAGIC = b"CFTOKEN1"
MEMO = 1_000_000


class WordEncoder:
    """The library's ids of whole texts. The vocabulary's rules lower-case letters, drop white
    space and never look across it, so texts are cut at ASCII white space and each distinct
    piece is encoded by the library once, many new pieces in one call with an added token
    between them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.between = "<|endoftext|>"
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.memo: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        raw = [t.encode("utf-8") for t in texts]
        words = [(r if b"<|" in r else r.lower()).split() for r in raw]  # bytes.lower: A-Z alone
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = set().union(*words).difference(memo) if words else set()
        marked = {}
        for w in [w for w in new if w[-1] in b".,"]:
            stem = w[:-1].decode("utf-8")
            # Latin letters and a mark are two pieces; not so where a letter's lower case is a letter and a mark
            if stem.isalpha() and max(stem) < "\u0250" and len(stem.lower()) == len(stem):
                marked[w] = w[:-1], w[-1:]
                new.discard(w)
                new.update(x for x in marked[w] if x not in memo)
        plain = [w for w in new if b"<|" not in w]
        for a in range(0, len(plain), 1024):
            part = plain[a : a + 1024]
            joined = f" {self.between} ".join([w.decode("utf-8") for w in part])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.between_id)
            all_ids, first = ids.tobytes(), 0
            for w, cut in zip(part, [*cuts.tolist(), len(ids)]):
                memo[w] = all_ids[4 * first : 4 * cut]
                first = cut + 1
        for w in new:
            if b"<|" in w:
                memo[w] = np.array(self.tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        for w, (stem, mark) in marked.items():
            memo[w] = memo[stem] + memo[mark]
        get = memo.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def open_fs(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample of documents (module docstring)."""
    n = max(1, docs.count())
    share = min(1.0, SAMPLE_DOCS / n)
    sample = docs.where(F.expr(f"pmod(xxhash64(doc_id, text), 1073741824) < {int(share * (1 << 30))}"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [(i + struct.pack("<I", end_id))[:SAMPLE_BYTES] for i in enc.encode_many([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    arrays = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").limit(4 * SAMPLE_DOCS).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself is the dictionary
        return b"".join(arrays)[: DICTIONARY_BYTES]


def write_token_files(docs: DataFrame, out_dir: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` under ``out_dir``; returns the manifest
    (file, part, n_docs, n_tokens), one row per file."""
    spark = docs.sparkSession
    ship(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    root = qualified(spark, out_dir)
    fs, local = open_fs(root)
    fs.create_dir(local, recursive=True)
    with fs.open_output_stream(f"{local}/{digest.hex()}.dict") as f:
        f.write(dictionary)

    def run(batches):
        enc, out_fs, name = encoder(path), None, None
        comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        end = struct.pack("<I", end_id)
        ids, has, offsets, counts, at = [], [], [], [], 0
        f = None
        for batch in batches:
            for doc_id, encoded in _encoded(enc, batch):
                if f is None:
                    out_fs, base = open_fs(root)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
                    f = out_fs.open_output_stream(f"{base}/{name}")
                    f.write(MAGIC + digest)
                    at = len(MAGIC) + len(digest)
                raw = encoded + end
                frame = comp.compress(raw)
                f.write(frame)
                ids.append(doc_id or 0)
                has.append(doc_id is not None)
                offsets.append(at)
                counts.append(len(raw) // 4)
                at += len(frame)
        if f is None:
            return
        for values, kind in ((ids, "<i8"), (has, "u1"), (offsets, "<u8"), (counts, "<u8")):
            f.write(np.array(values, dtype=kind).tobytes())
        f.write(struct.pack("<QQ", at, len(ids)))
        f.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "part": TaskContext.get().partitionId(), "n_docs": len(ids), "n_tokens": sum(counts)}],
                                         schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    order = ["doc_id", F.xxhash64("text")]
    written = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "file string, part long, n_docs long, n_tokens long").collect()  # one row per file
    starts, total = [], 0
    for r in sorted(written, key=lambda r: r["part"]):
        starts.append((f"{root}/{r['file']}", r["part"], r["n_docs"], r["n_tokens"], total))
        total += r["n_tokens"]
    return spark.createDataFrame(starts, "file string, part long, n_docs long, n_tokens long, start long")


def _encoded(enc: WordEncoder, batch, step: int = 256):
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield from zip(part.column(0).to_pylist(), enc.encode_many([t or "" for t in part.column(1).to_pylist()]))


class TokenFile:
    """Random access to one file: ``len``, ``doc_ids``, ``ids(k)``."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        head = self.f.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.dictionary_hash = head[8:]
        self.index_at, self.n = struct.unpack("<QQ", self.f.read_at(16, size - 16))
        index = self.f.read_at(size - 16 - self.index_at, self.index_at)
        self.doc_ids = np.frombuffer(index, "<i8", self.n)
        self.has_id = np.frombuffer(index, "u1", self.n, 8 * self.n)
        self.offsets = np.frombuffer(index, "<u8", self.n, 9 * self.n)
        self.counts = np.frombuffer(index, "<u8", self.n, 17 * self.n)
        with fs.open_input_file(f"{path.rpartition('/')[0]}/{self.dictionary_hash.hex()}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.dictionary_hash:
            raise ValueError("the dictionary is not the one the file was written with")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return self.n

    def raw(self, k: int) -> bytes:
        end = int(self.offsets[k + 1]) if k + 1 < self.n else self.index_at
        frame = self.f.read_at(end - int(self.offsets[k]), int(self.offsets[k]))
        return self.decompressor.decompress(frame, max_output_size=4 * int(self.counts[k]))

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), "<u4")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = TokenFile(uri)
                for a in range(0, len(t), 1024):
                    part = range(a, min(a + 1024, len(t)))
                    counts = t.counts[a:part.stop].astype("i8")
                    crc = [zlib.crc32(t.raw(k)) for k in part]
                    ids = pa.array(t.doc_ids[a:part.stop], mask=t.has_id[a:part.stop] == 0)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)
                    start += int(counts.sum())

    files = manifest.select("file", "start")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents, then read every one back from the files."""
    spark = docs.sparkSession
    return read_token_files(write_token_files(docs, staging_dir(spark, "tokens"), path))
