"""Operators 6, 7 and 10 against the tokenizers library and full re-encoding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from civicflow.llm import bpe, edit_counts, token_files
from tests.conftest import SF_SMALL

ODD = [None, "", " ", "  two  spaces ", "a\n\n b\t c", "word<|endoftext|>more <|endoftext|> x", "x" * 700, "naïve café ß Ωμέγα 北京 🙂",
       "it's we'll I'M 'sup", "a b   c\x1cd\x85e \x1d f", "1 23 456 ... --- ?!", "ab " * 5000, "́ é \ń", "ΣΑΣ Σ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD)] + [(None, "no id", "extra"), (3, ODD[3], "extra")]
    small = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang n_tokens")
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").union(small)


def test_bpe_equals_library(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, bpe.encode_digests(docs).collect()), key=str)
    want = []
    for doc_id, text, _ in docs.collect():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_rank_array_and_heap_agree():
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"aaabtheing \xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert c.merge(piece) == c._merge_long([c.first[b] for b in piece])


def test_bpe_empty_table(spark, docs):
    assert bpe.encode_digests(docs.limit(0)).count() == 0


def test_token_files_equal_library(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.token_files_digest(docs).collect()
    want, start = [], 0
    rows = sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text, _ in rows:  # the repeated row has the same text, so its order is free
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_files_random_access(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path / "out"))
    enc = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in docs.collect()}
    for row in manifest.collect():
        f = token_files.TokenFile(row["file"])
        for k in range(0, len(f), 7):
            if f.has_id[k]:
                assert f.raw(k) == enc.encode(texts[int(f.doc_ids[k])] or "") + b"\x02\0\0\0"
    assert token_files.token_files_digest(docs.limit(0)).count() == 0


def brute_edit(text, edits):
    for e in edits or []:
        start = min(max(e["start"] or 0, 0), len(text))
        end = min(max(start if e["end"] is None else e["end"], start), len(text))
        text = text[:start] + (e["text"] or "") + text[end:]
    return text


def test_recount_equals_full_encoding(docs):
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    revised = edit_counts.revision_edits(docs.select("doc_id", "text"))
    want = []
    for r in revised.collect():
        after = brute_edit(r["text"] or "", r["edits"])
        want.append((r["doc_id"], len(c.encode(r["text"] or "")), len(c.encode(after)), len(r["edits"]), len(after)))
    got = edit_counts.recount(revised).drop("n_encoded").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_recount_random_edits_and_locality():
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for text in [t or "" for t in ODD] + ["the quick brown fox " * 500]:
        tree, now = edit_counts.CountTree(text, c), text
        for _ in range(40):
            start = rng.randint(0, len(now) + 1)
            e = {"start": start, "end": start + rng.randint(0, 9), "text": rng.choice(["", " ", "  ", "x", " new words here", "\n", "<|endoftext|>", "<|endof"])}
            tree.edit(e["start"], e["end"], e["text"])
            now = brute_edit(now, [e])
            assert tree.text() == now and tree.total == len(c.encode(now))
    tree = edit_counts.CountTree("the quick brown fox " * 5000, c)
    tree.edit(50_000, 50_003, "red")
    assert tree.encoded_chars < 60


def test_recount_null_edits(spark):
    df = spark.sql("select 1L doc_id, 'a b c' text, cast(null as array<struct<start:long,end:long,text:string>>) edits "
                   "union all select 2L, null, array(named_struct('start', null, 'end', null, 'text', null))")
    assert sorted(map(tuple, edit_counts.recount(df).select("doc_id", "n_before", "n_tokens").collect())) == [(1, 3, 3), (2, 0, 0)]


def test_letters_before_a_mark_equal_library():
    path = public_tokenizers.path(token_files.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_files.encoder(path)
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = ["İ.", "İ,", "aİ.", "İstanbul,", "ŉ,"] + ["".join(rng.choices(letters, k=rng.randint(1, 6))) + rng.choice(".,") for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
