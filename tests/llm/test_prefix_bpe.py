"""Operator 13 against the tokenizers library, and the cutting into pre-tokens that operators 7, 10 and 13 share."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inference_ledger.llm import encode, prefix_bpe, pretokens, queries
from inference_ledger.llm.encode import Encoder, public_tokenizer

from .conftest import SF
from .test_tokens import ADDED, ODD

PATH = public_tokenizer("byte_bpe_50k.json")
BITS = ["a", "b", "s", "t", "re", "ll", "ve", "'", "'s", " ", "  ", "\n", "\t", "\xa0", "　", "\x85", "1", "23", "½",
        "É", "é", "ß", "Σ", "大", "ا", "!", "?!", "-", "_", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x1c",
        "\x00", "İ", "🙂", "X", "'RE", "​", "×", "Þ", "ÿ", "Ÿ", "ö", "the", " and"]
LONG = ["a" * n for n in (1, 2, 3, 255, 256, 257, 1000)] + ["ab" * 500, "the" * 400, "大坝" * 300, "!?" * 600, " " * 700, "\n" * 300]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + LONG + ADDED


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", Encoder), ("word_bpe_49k.json", Encoder),
                                       ("byte_bpe_50k.json", prefix_bpe.PrefixEncoder)])
def test_a_column_equals_the_library(name, kind):
    texts = odd_texts(4000)
    enc, lib = kind(public_tokenizer(name)), Tokenizer.from_file(public_tokenizer(name))
    for _ in range(2):                       # met for the first time, and from the dictionary
        ids, at = enc.encode_column(pa.array([*texts, None, ""]))
        assert len(at) == len(texts) + 3 and at[-1] == at[-2] == at[-3] == len(ids)
        for k, want in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[k]:at[k + 1]].tolist() == want.ids, texts[k]


def test_every_code_point_is_cut_as_the_library_cuts_it():
    lib = Tokenizer.from_file(PATH).pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 1 << 14):
        text = "".join(f"a{chr(c)}1 " for c in points[k:k + (1 << 14)])
        flat = np.frombuffer(text.encode(), np.uint8)
        start = pretokens.byte_level(flat, np.array([0]))
        _, where = pretokens.code_points(flat)
        chars = start if where is None else np.searchsorted(where, start)
        assert chars.tolist() == [a for _, (a, _) in lib.pre_tokenize_str(text)]


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    text = " ".join(odd_texts(300, seed=3))
    enc = Encoder(PATH)
    monkeypatch.setattr(encode, "SLICE", 200)
    ids, at = enc.encode_column(pa.array(["x y", text, "", text[::-1]]))
    for k, t in enumerate(["x y", text, "", text[::-1]]):
        assert ids[at[k]:at[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_each_token_is_its_own_encoding_and_pairs_agree_with_the_library():
    coder, lib = prefix_bpe.prefix_encoder(PATH).coder, Tokenizer.from_file(PATH)
    v = coder.vocab
    some = list(range(0, v.size, 7))
    got = coder.encode([v.bytes[k] for k in some], "<u4")
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[int(v.ids[k])] for k in some]
    rng = np.random.default_rng(0)
    words = [k for k in range(v.size) if v.bytes[k].isalpha()]
    a, b = rng.choice(words, 3000), rng.choice(words, 3000)
    for x, y, ok in zip(a, b, v.compatible(a, b)):
        ids = lib.encode((v.bytes[x] + v.bytes[y]).decode(), add_special_tokens=False).ids
        assert ok == (ids == [v.ids[x], v.ids[y]])


def want(rows):
    lib = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        out.append((doc_id is not None, doc_id or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def test_op13_on_table(spark, documents):
    assert rows_of(queries.op13_bpe(spark, SF)) == want(documents)


def test_op13_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD + ADDED)] + [(3, "a"), (3, "a"), (None, "nobody"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    assert rows_of(prefix_bpe.encoding_digest(df, PATH)) == want(rows)
    assert prefix_bpe.encoding_digest(df.limit(0), PATH).count() == 0
    whole = prefix_bpe.encode_documents(df, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    assert sorted((r.decoded, r.ids) for r in whole) == sorted(
        (lib.decode(i, skip_special_tokens=False), i) for i in (lib.encode(t or "", add_special_tokens=False).ids for _, t in rows))


def test_invalid_bytes_are_replaced_as_the_library_does():
    enc, lib = prefix_bpe.prefix_encoder(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    for _ in range(300):
        ids = rng.integers(0, 50_257, 6)
        out, at = enc.decode(ids, np.array([0, 6]))
        assert prefix_bpe.lossy(out[at[0]:at[1]].tobytes()).decode() == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError):
        prefix_bpe.encoding_digest(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), public_tokenizer("word_bpe_49k.json"))
