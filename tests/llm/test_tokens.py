"""Operators 7 and 10: round trips against the tokenizers library itself."""

import zlib

import numpy as np
import pytest

from inference_ledger.llm import packing, queries, token_files
from inference_ledger.llm.encode import encoder, public_tokenizer

from .conftest import SF

ODD = [None, "", " ", "a", "a  b \n c", " x", "x ", "hi\n\nthere  \t x", "İstanbul ΣΑΣ  Σ", "<|endoftext|> a",
       "a'll b c d", "é ́x é", "word " * 3000, "ANSTIN!! IS.!!", "x y  z"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(documents, name):
    enc = encoder(public_tokenizer(name))
    for text in ODD + [t for _, t in documents[:60]] + [t for _, t in documents[:60]]:
        want = enc.lib.encode(text or "", add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want


ADDED = ["<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b", "a  <|endoftext|>  b c <|startoftext|><|endoftext|>\n",
         "<|ENDOFTEXT|> x", "é́ <|endoftext|>Σ ΑΣ<|startoftext|> d", "<|endoftext <|endoftext|>|>", " <|startoftext|> "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_a_text_equal_a_fresh_library(name):
    from tokenizers import Tokenizer
    path = public_tokenizer(name)
    enc, lib = encoder(path), Tokenizer.from_file(path)
    for text in ADDED + ADDED + [t for t in ODD if t]:
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, text
    end = lib.token_to_id("<|endoftext|>")
    assert enc.encode("a<|endoftext|>b").tolist().count(end) == 1


def test_added_token_of_another_kind_goes_to_the_library(tmp_path):
    from tokenizers import AddedToken, Tokenizer
    lib = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    lib.add_tokens([AddedToken("Mark", lstrip=True, normalized=True)])
    path = str(tmp_path / "own.json")
    lib.save(path)
    enc, lib = encoder(path), Tokenizer.from_file(path)
    for text in ADDED + ["a  MARK b", "mark", "x Mark<|endoftext|>"]:
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_op7_and_op10_with_added_tokens(spark):
    from tokenizers import Tokenizer
    rows = [(k, t) for k, t in enumerate(["a b", "x <|endoftext|> y", "c <|startoftext|>", "d e f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        lib = Tokenizer.from_file(public_tokenizer(name))
        ids = [np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
        start = np.cumsum([0, *map(len, ids)])
        got = token_files.token_digest(spark, df, public_tokenizer(name), 1).collect()
        assert sorted(tuple(r) for r in got) == [(d, int(s), len(x), zlib.crc32(x)) for (d, _), s, x in zip(rows, start, ids)]
        packed = packing.pack_digest(packing.pack_documents(spark, df, public_tokenizer(name), 1, 64)).collect()
        assert sorted((p.doc_id, p.offset, p.ids_crc32) for p in packed) == [
            (d, int(s), zlib.crc32(x)) for (d, _), s, x in zip(rows, start, ids)]


@pytest.mark.parametrize("high", [1, 2, 3, 300, 50_000, 1 << 20, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 5, 240, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype("<u4")
    ids[rng.random(n) < 0.3] = 0
    first, words, escapes = token_files.pack(ids)
    assert (token_files.unpack(first, words, escapes, n) == ids).all()
    if n >= 240 and high == 1:
        assert len(words) <= -(-n // 100)


@pytest.mark.parametrize("block_ids", [1, 7, 64, 1 << 16])
def test_documents_that_go_on_in_the_next_block(spark, monkeypatch, tmp_path, block_ids):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block_ids)
    lengths = [1, 3, 200, 1, 7, 14, 64, 65]
    at = np.append(0, np.cumsum(lengths))
    ids = np.arange(at[-1], dtype="<u4") * 997
    blocks = list(token_files.write_blocks(5, 100, [None, *range(1, 8)], ids, at))
    assert all(len(b[5]) <= block_ids for b in token_files.read_blocks(b"".join(blocks)))
    (tmp_path / "part-0").write_bytes(b"".join(blocks))
    got = sorted(token_files.read_token_files(spark, f"file://{tmp_path}").collect(), key=lambda r: r.local_start)
    assert [(r.part, r.local_start, r.doc_id, r.n_tokens) for r in got] == [
        (5, 100 + int(a), k or None, n) for k, (a, n) in enumerate(zip(at, lengths))]
    assert b"".join(bytes(r.ids) for r in got) == ids.tobytes()


def test_damaged_block_is_refused():
    block = token_files.write_block(0, 0, [1], np.arange(50, dtype="<u4"), np.array([50]))
    with pytest.raises(ValueError):
        list(token_files.read_blocks(block[:-1] + b"xx"))
    with pytest.raises(ValueError):
        list(token_files.read_blocks(b"X" * len(block) + b"\n"))


def expected(docs, name, end):
    lib = encoder(public_tokenizer(name)).lib
    return [np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4") for _, t in docs]


def test_op7_on_table(spark, documents):
    docs = sorted(documents)
    ids = expected(docs, "byte_bpe_50k.json", 2)
    got = sorted(tuple(r) for r in queries.op7_token_files(spark, SF).collect())
    start = np.cumsum([0, *map(len, ids)])
    assert got == [(d, int(s), len(x), zlib.crc32(x)) for (d, _), s, x in zip(docs, start, ids)]


def test_op7_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (3, "other"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ids")
    got = token_files.token_digest(spark, df, public_tokenizer("byte_bpe_50k.json"), 2).collect()
    want = sorted((d is not None, d or 0, len(x), zlib.crc32(x)) for (d, _), x in
                  zip(rows, expected(rows, "byte_bpe_50k.json", 2)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    assert [r.doc_id is not None and r.doc_id for r in ordered] == sorted(
        r.doc_id is not None and r.doc_id for r in got)
    assert token_files.token_digest(spark, df.limit(0), public_tokenizer("byte_bpe_50k.json"), 2).count() == 0


def check_packing(rows, pieces, size):
    by_id = {}
    for (d, _), x in zip(rows, expected(rows, "word_bpe_49k.json", 1)):
        by_id.setdefault(d, []).append(x)
    assert sum(p.length for p in pieces) == sum(len(x) for xs in by_id.values() for x in xs)
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start:p.start + p.length]) == p.ids_crc32
                   for x in by_id[p.doc_id])
    place = sorted((p.sequence_id * size + p.offset, p.length) for p in pieces)
    assert [a for a, _ in place] == np.cumsum([0, *[n for _, n in place]])[:-1].tolist()
    assert all(p.offset + p.length <= size for p in pieces)


def test_op10_on_table(spark, documents):
    check_packing(documents, queries.op10_pack(spark, SF).collect(), 2048)


def test_op10_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS start")
    for size in (1, 7, 64):
        pieces = packing.pack_digest(packing.pack_documents(
            spark, df, public_tokenizer("word_bpe_49k.json"), 1, size)).collect()
        check_packing(rows, pieces, size)
    assert packing.pack_documents(spark, df.limit(0), public_tokenizer("word_bpe_49k.json"), 1).count() == 0
