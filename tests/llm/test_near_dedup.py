"""Operator 6 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from inference_ledger.llm import near_dedup, queries
from inference_ledger.llm.columns import xxh64
from inference_ledger.llm.components import components

from .conftest import SF


def simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def least_reachable(fps, ids):
    distinct = sorted(set(fps))
    up = {x: x for x in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    a = np.array(distinct, np.uint64)
    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3):
            up[root(distinct[i + 1 + j])] = root(x)
    least = {}
    for d, x in sorted((p for p in zip(ids, fps) if p[0] is not None)):
        least.setdefault(root(x), d)
    return [least.get(root(x)) for x in fps]


def test_xxh64_of_ranges():
    random.seed(0)
    strings = [random.randbytes(n) for n in range(140)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    n = np.array([len(x) for x in strings])
    assert xxh64(data, np.cumsum(n) - n, n, 42).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in strings]


def test_fingerprints(documents):
    texts = [t for _, t in documents[:80]] + [None, "", "  \n", " A", "a b", "É a b  c\n\nd E f ", "x", None]
    column = pa.array(texts)
    assert near_dedup.fingerprints(column).tolist() == [simhash(t) for t in texts]
    assert near_dedup.fingerprints(column.slice(50)).tolist() == [simhash(t) for t in texts[50:]]


def test_op6_on_table(spark, documents):
    got = {r.doc_id: r for r in queries.op6_near_dedup(spark, SF).collect()}
    fps = [simhash(t) for _, t in documents]
    want = least_reachable(fps, [d for d, _ in documents])
    assert [(got[d].fingerprint, got[d].component_id) for d, _ in documents] == \
        [(f"{f:016x}", c) for f, c in zip(fps, want)]


def test_dense_cluster_in_several_trees(spark):
    rng = np.random.default_rng(1)
    base, values = int(rng.integers(2**63)), set()
    for _ in range(1500):
        v = base
        for b in rng.integers(0, 64, int(rng.integers(0, 7))):
            v ^= 1 << int(b)
        values.add(v)
    values = [*values, *(int(x) for x in rng.integers(0, 2**63, 200))]
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in components(spark, near_dedup.near_links(df, 3, tree_nodes=128)).collect()}
    want = least_reachable(values, list(range(len(values))))
    pairs = {(roots.get(s, s), w) for s, w in zip(signed, want)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (4, " \n"), (None, "one two three four"), (9, "ONE two\tthree  four"),
            (9, "ONE two\tthree  four"), (11, "something else entirely here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS root")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_dedup.near_duplicates(spark, df).collect())
    assert got == [(-1, 9), (4, 4), (5, 4), (6, 4), (9, 9), (9, 9), (11, 11)]
    assert near_dedup.near_duplicates(spark, df.limit(0)).count() == 0
    kept = near_dedup.one_per_group(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 9, 11]
