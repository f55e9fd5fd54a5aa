"""Operator 9 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inference_ledger.llm import queries, repeats

from .conftest import SF


def brute(texts, width=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i:i + width] for x in data for i in range(len(x) - width + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if count[x[i:i + width]] > 1:
                gone[i:i + width] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op9_on_table(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_repeats(spark, SF).collect()}
    assert got == {d: b for (d, _), b in zip(documents, brute([t for _, t in documents]))}


def odd_rows():
    rng = random.Random(3)

    def junk(n):
        return "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    p = "".join(rng.choice("abcdé ") for _ in range(230))
    hot = junk(150)
    texts = [None, "", "x", "ab" * 300, "z" * 199, "z" * 200, "y" * 201, p + junk(500), junk(100) + p,
             p[:199] + junk(9), junk(300) + p[3:210] + junk(50) + p[:205]]
    rows = list(enumerate(texts)) + [(1, "hot"), (None, p + "1"), (None, p + "1"), (20, junk(50) + p + junk(80)),
                                     (21, "same row " * 40), (21, "same row " * 40)]
    rows += [(30 + i, junk(80) + hot + junk(80)) for i in range(40)]
    return rows + [(100, hot + "Q" * 60), (101, "W" * 60 + hot + "Q" * 60)]


@pytest.mark.parametrize("hot_pieces", [4096, 8])
def test_odd_rows(spark, monkeypatch, hot_pieces):
    monkeypatch.setattr(repeats, "HOT_PIECES", hot_pieces)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.repeat_digest(spark, df).collect())
    assert got == Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows])))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_that_share_a_32_bit_hash_stay_apart(spark, doc_id):
    passage = "".join(random.Random(9).choice("abcdefghij klmno") for _ in range(230))
    pair = (spark.range(300_000).selectExpr(
        f"concat_ws('', transform(sequence(1, 4 + id % 5), k -> sha2(concat(id, '/', k), 256)), '{passage}') AS text")
        .selectExpr("text", "hash(text) AS h").groupBy("h").agg(F.collect_list("text").alias("texts"))
        .filter("array_max(transform(texts, t -> length(t))) > array_min(transform(texts, t -> length(t)))").first())
    rows = [(doc_id, t) for t in pair.texts] + [(doc_id, "x" * 50 + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeats.repeat_digest(spark, df).collect())
    assert got == Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows])))


def test_merge_equals_one_sort():
    rng = random.Random(5)
    stem = "".join(rng.choice("ab") for _ in range(260))
    pieces = [(stem[:i] + stem[i + 1:] + "c")[rng.randrange(4):][:250].encode() for i in range(0, 240, 3)]
    count = Counter(p[i:i + 200] for p in pieces for i in range(len(p) - 199))
    want = [sum(1 << i for i in range(len(p) - 199) if count[p[i:i + 200]] > 1) for p in pieces]
    for shard in (7, 64, 1 << 14):
        repeats.SHARD_WINDOWS, before = shard, repeats.SHARD_WINDOWS
        try:
            got = repeats.repeated_windows(pieces, [1] * len(pieces))
        finally:
            repeats.SHARD_WINDOWS = before
        assert [g & (2**64 - 1) for g in got] == want


def test_long_text_is_cut_into_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    offsets = np.array([0, 0, 2600, 2600, 5000])

    def found():
        return sorted((int(r), int(k), int(p), int(s), int(w)) for row, key, piece, start, windows in
                      repeats.document_pieces(data, offsets)
                      for r, k, p, s, w in zip(row, key, piece, start, windows))
    whole = found()
    assert sum(x[4] for x in whole) == 2600 - 199 + 2400 - 199
    monkeypatch.setattr(repeats, "CHUNK", 512)
    parts = found()
    assert sum(x[4] for x in parts) == sum(x[4] for x in whole)
    assert {x[1] for x in parts} == {x[1] for x in whole}       # the same cores, wherever chunks end


def test_empty_and_columns(spark):
    rows = [(1, "é" * 500, 500, "a"), (2, "é" * 500 + "q", 501, "b"), (3, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string") \
        .selectExpr("*", "1 AS did", "2 AS list", "3 AS kept")
    out = repeats.without_repeats(spark, df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, "", 0), (2, "q", 1), (3, None, None)]
    assert repeats.repeat_digest(spark, df.limit(0)).count() == 0


def copies_of(n):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghij klmno") for _ in range(900))
    other = "".join(rng.choice("abcdefghij klmno") for _ in range(600))
    return [(i, text) for i in range(n)] + [(1000, other), (1001, text[:300] + other), (1002, None)]


def test_pieces_bring_their_weight(spark):
    """How often a piece occurs comes with its mask; candidates are not read and counted again for it."""
    df = spark.createDataFrame(copies_of(300), "doc_id long, text string")
    candidates, heavy, total = repeats.candidate_pieces(spark, df)
    found = repeats.repeated_pieces(candidates, heavy, repeats._keyed(df).repartition("id1", "id2"), 1)
    got = {(r.key, r.piece): r.weight for r in found.filter("mask != 0").collect()}
    count = {(r.key, r.piece): r["count"] for r in candidates.groupBy("key", "piece").count().collect()}
    assert max(got.values()) >= 300 and {k for k, n in count.items() if n > 1} <= set(got)
    assert all(count[k] == n for k, n in got.items())
    plan = repeats.remove_repeats(spark, df)._jdf.queryExecution().optimizedPlan().toString()
    semi = [x for x in plan.split("Join LeftSemi")[1:]]
    assert all("start#" not in x.split("Join")[0] for x in semi)        # on tables of keys alone


def test_pieces_bring_how_often_their_core_occurs(spark):
    """No candidate is joined again to find out whether its core has other pieces."""
    df = spark.createDataFrame(copies_of(300), "doc_id long, text string")
    candidates, heavy, _ = repeats.candidate_pieces(spark, df)
    count = {r.key: r["count"] for r in candidates.groupBy("key").count().collect()}
    assert max(count.values()) >= 300
    assert all(count[r.key] == r.n for r in candidates.select("key", "n").distinct().collect())
    found = repeats.repeated_pieces(candidates, heavy, repeats._keyed(df).repartition("id1", "id2"), 1)
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_pieces_of_a_frequent_core(spark, monkeypatch):
    """Cores that occur more than HOT_PIECES times, some of them with fewer distinct pieces than that."""
    monkeypatch.setattr(repeats, "HOT_PIECES", 8)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(240))
    rows = copies_of(30) + [(2000 + i, "%03d" % i * 30 + passage + "%03d" % i * 30) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = repeats.candidate_pieces(spark, df)[0].groupBy("key").agg(F.countDistinct("piece").alias("v"), F.max("n").alias("n"))
    kinds = {(min(r.v, 9), r.n > 8) for r in pieces.collect()}
    assert {(1, True), (9, True)} <= kinds and any(1 < v <= 8 and many for v, many in kinds)
    got = Counter(tuple(r) for r in repeats.repeat_digest(spark, df).collect())
    assert got == Counter((d, *b) for (d, _), b in zip(rows, brute([t for _, t in rows])))


def test_one_python_process_a_task(spark):
    df = spark.createDataFrame(copies_of(3), "doc_id long, text string")
    out = repeats.without_repeats(spark, df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text) for r in out.collect())[:2] == [(0, ""), (1, "")]
