"""Operator 8: recall and ties against brute force."""

import math

import numpy as np

from inference_ledger.llm import neighbours, queries

from .conftest import SF


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got, hit, total = {}, 0, 0
    for r in queries.op8_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 50 == 0}
    at = {i: k for k, i in enumerate(ids)}
    for q, found in got.items():
        cosine = unit @ unit[at[q]]
        best = sorted((-cosine[k], i) for k, i in enumerate(ids) if i != q)[:5]
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert [x[1] for x in found] == [x[1] for x in sorted(found, key=lambda x: (-x[2], x[1]))]
        assert all(math.isclose(s, cosine[at[i]], abs_tol=1e-12) for _, i, s in found)
        hit += len({i for _, i in best} & {i for _, i, _ in found})
        total += 5
    assert hit >= 0.9 * total


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1., 0.]), (50, [1., 0.]), (100, [2., 0.]), (1, [0., 1.]), (2, None), (150, [0., 0.]), (200, [nan, 1.]),
            (250, [inf, 1.]), (300, [None, 1.]), (350, []), (400, [1., 2., 3.]), (3, [1., 0.]), (4, [1., 0.]), (5, [1., 0.]),
            (6, [1., 0.]), (7, [1., 0.]), (0, [1., 0.]), (None, [1., 0.]), (450, [1e-200, 0.])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS h1", "2 AS score")
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [i for _, i, _ in sorted(x)] for q, x in got.items()} == {
        0: [3, 4, 5, 6, 7], 50: [0, 3, 4, 5, 6], 100: [0, 3, 4, 5, 6], 450: [0, 3, 4, 5, 6]}
    assert all(s == 1.0 for x in got.values() for _, _, s in x)
    few = df.filter("vec_id IN (0, 1)")
    assert sorted(r.vec_id for r in neighbours.search(few, few, 5).collect()) == [0, 1]
    assert neighbours.search(df.limit(0), df.limit(0), 5).count() == 0
