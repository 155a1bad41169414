"""Operators 1 and 9 against the tokenizers library, text by text."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelattice.llm import bpe, token_output

HARD = ["", " ", "a  b", "a \n b\n\n c \t\td", "  x  y", "don't 'tis it's'S 're x're", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "1234567 89a b2", "　　中文 字 текст", "é́a ñ", "x\u0085 y", "trail  ", "\n\n",
        "a,b.c!! ''s -'s ,'s", "a" * 300 + " " + "ab" * 300, "🙂🙃 a🙂b", "tab\tword\r\nx", "=====   ====", "foo\u00a0bar \u00a0 baz \u2003 q", "\x1c a\x1fb", "İstanbul ΣΑΣ", "ﬁ ½ ²", "<|startoftext|>x", "<|endoftext", "O'Neil's", None]


def documents(spark, texts, more=()):
    rows = [(k * 3 % 101, t, "x") for k, t in enumerate(texts)] + list(more)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def real(n):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.001/documents.parquet' limit {n}").fetchall()]


def test_word_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = HARD + real(60)
    got = token_output.token_files(documents(spark, texts), path, seq_len=64).orderBy("doc_id").collect()
    start = 0
    assert len(got) == len(texts)
    for row, (_, text) in zip(got, sorted((k * 3 % 101, x or "") for k, x in enumerate(texts)), strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_give_any_sequence_without_a_copy(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    m = token_output.write(documents(spark, real(40)), str(tmp_path), path, seq_len=32, rows=4).collect()
    for r in m:
        batches = token_output.open_shard(r.path)
        assert sum(b.num_rows for b in batches) == r.n_sequences and {b.num_rows for b in batches[:-1]} <= {4}
        ids, mask = token_output.sequence(batches, r.n_sequences - 1)
        assert len(ids) == len(mask) == 32 and not ids.flags.owndata and mask[0].as_py()
        assert sum(pa.compute.sum(token_output.sequence(batches, k)[1]).as_py() for k in range(r.n_sequences)) == r.n_ids


def test_repeated_ids_and_empty_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    twice = spark.createDataFrame([(5, "one two"), (5, "three"), (5, "one two"), (None, "x"), (1, "y")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.token_files(twice, path).collect())
    assert [g[1] for g in got][:2] == [None, 1] and sum(g[2] for g in got) == got[-1][0] + got[-1][2]
    assert token_output.token_files(twice.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))


def test_bytes(spark, coder):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = HARD + real(60)
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[k * 3 % 101]
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_verification_finds_what_merging_changes(coder):
    words = [w.encode() for w in " ".join(real(20)).split()] + [b"aaaaaa", b"ababab", b"theththe"]
    exact = [coder.exact(w) for w in words]
    greedy = [coder.greedy(w) for w in words]
    for w, g, e in zip(words, greedy, exact, strict=True):
        a = np.array(g)
        assert bool(coder.compatible(a[:-1], a[1:]).all()) == (g == e), w
    assert coder.encode_pretokens(words) == exact and greedy != exact


def test_bytes_that_are_no_text(coder):
    assert list(coder.decode(np.array([coder.byte_id[0xE4], coder.byte_id[0x41]]), np.array([2]))) == ["\ufffdA"]


def test_segments_that_share_a_hash_are_told_apart(coder, monkeypatch):
    from pagelattice.llm import flat

    texts = pa.array(real(40) + [x or "" for x in HARD])
    want = bpe.ByteBPE.encode(coder, texts)
    plain = flat.hash_spans
    monkeypatch.setattr(flat, "hash_spans", lambda data, s, e, *a, **k: [x % np.uint64(5) for x in plain(data, s, e, *a, **k)])
    coder.memo.clear()
    for _ in range(2):
        got = bpe.ByteBPE.encode(coder, texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    words = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = words(texts)
    monkeypatch.undo()
    plain_ = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))(texts)
    assert np.array_equal(got[0], plain_[0]) and np.array_equal(got[1], plain_[1])
    coder.memo.clear()


def test_repeated_rows_empty_tables_and_other_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(5, "one two", 1), (5, "one two", 1), (None, "x", 2), (6, None, 3)], "doc_id long, text string, n_tokens long").withColumns({c: F.lit(c) for c in ("ids", "ids_sha256", "decoded_sha256")})
    got = bpe.digests(df, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (5, 2), (5, 2), (6, 0)]
    assert bpe.digests(df.limit(0), path).count() == 0
    files = token_output.token_files(df.withColumns({c: F.lit(c) for c in ("_tie", "start", "shard", "path")}), public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in files.collect()) == [(0, 2), (5, 3), (5, 3), (6, 1)]
