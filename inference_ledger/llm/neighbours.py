"""Operator 8: approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long hash string (signs of ``BITS`` random projections) and
keeps the strings in a sorted array. A query descends each tree to its longest matching
prefixes, then all trees ascend together, one bit at a time, until the vectors that
share the prefix in any tree number ``SHARE`` of the shard's (``LEAST`` at least, or all). Those are ranked by their
exact cosine.

Equal vectors are one class with its ``k + 1`` smallest ids, which is all a result can use. Classes are
dealt to shards of about ``SHARD`` by hash; a shard's task builds its forest, and the distinct
query vectors stream past it, so a task holds one shard and one Arrow batch. The shards' best
are merged per query vector, and queries pick from their vector's list.

Cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with null
vec_id, take no part. Repeated rows (vec_id and vector) count once. Vectors meet only those of
their own length. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, SHARE, LEAST = 64, 32, 0.5, 64
SHARD = 8192
SEED = 20


def unit_rows(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    odd = ~np.isfinite(n) | (n < 1e-150)          # squares over- or underflow: scale first
    if odd.any():
        scaled = v / np.abs(v).max(axis=1, keepdims=True)
        v = np.where(odd, scaled, v)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / n


class Forest:
    """Sorted hash strings of one shard's vectors, per tree."""

    def __init__(self, vectors: np.ndarray):
        self.unit = unit_rows(vectors)
        planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], TREES * BITS))
        self.planes = planes.astype(np.float32)
        h = self.strings(self.unit)
        self.order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=0)
        self.wanted = min(len(vectors), max(LEAST, int(np.ceil(SHARE * len(vectors)))))

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """Hash strings [vector, tree], the first bit highest."""
        bits = (unit.astype(np.float32) @ self.planes > 0).reshape(len(unit), TREES, BITS)
        return np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.int64)

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, the sorted places that share the first ``depth`` bits."""
        low = (strings >> (BITS - depth)) << (BITS - depth)
        lo, hi = np.empty_like(low), np.empty_like(low)
        for t in range(TREES):
            lo[:, t] = np.searchsorted(self.sorted[:, t], low[:, t], "left")
            hi[:, t] = np.searchsorted(self.sorted[:, t], low[:, t] + (1 << (BITS - depth)) - 1, "right")
        return lo, hi

    def candidates(self, unit: np.ndarray) -> np.ndarray:
        """Mask [query, vector] of what the trees reach together."""
        strings = self.strings(unit)
        found = np.zeros((len(unit), len(self.unit)), bool)
        open_ = np.arange(len(unit))
        before = None
        for depth in range(BITS, -1, -1):
            lo, hi = self.ranges(strings[open_], depth)
            for row, q in enumerate(open_):
                mine = found[q]
                for t in range(TREES):
                    a, b = lo[row, t], hi[row, t]
                    if before is not None:      # only what this bit adds
                        x, y = before[0][row, t], before[1][row, t]
                        if a < x:
                            mine[self.order[a:x, t]] = True
                        if y < b:
                            mine[self.order[y:b, t]] = True
                    elif a < b:
                        mine[self.order[a:b, t]] = True
            more = found[open_].sum(axis=1) < self.wanted
            open_, before = open_[more], (lo[more], hi[more])
            if not len(open_):
                break
        return found


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of every row of ``queries`` (a part of ``rows``;
    both vec_id, embedding) against all of ``rows``."""

    def keyed(df):
        ok = """vec_id IS NOT NULL AND embedding IS NOT NULL AND exists(embedding, x -> x <> 0)
            AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"""
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
                .filter(ok).withColumn("h1", F.xxhash64("embedding"))
                .withColumn("h2", F.xxhash64(F.lit("second"), "embedding")))

    vectors = keyed(rows).dropDuplicates(["vec_id", "h1", "h2"])
    asked = keyed(queries).dropDuplicates(["vec_id", "h1", "h2"])
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    classes = (vectors.withColumn("k", first).filter(f"k <= {k + 1}").groupBy("h1", "h2")
               .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    n_shards = max(1, -(-rows.count() // SHARD))
    index = classes.select(F.size("embedding").alias("dim"), F.expr(f"pmod(h1, {n_shards})").alias("shard"),
                           F.lit(False).alias("asks"), "h1", "h2", "ids", "embedding")
    probes = asked.dropDuplicates(["h1", "h2"]).select(
        F.size("embedding").alias("dim"), F.explode(F.expr(f"sequence(0L, {n_shards - 1}L)")).alias("shard"),
        F.lit(True).alias("asks"), "h1", "h2", F.expr("CAST(NULL AS array<long>)").alias("ids"), "embedding")

    def look(batches):
        shard, forest, held = None, None, []
        for batch in batches:
            column = batch.column("embedding")
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            place = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(),
                             batch.column("asks").to_pylist()))
            cuts = [0, *[i for i in range(1, len(place)) if place[i] != place[i - 1]], len(place)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                dim, which, asks = place[lo]
                if (dim, which) != shard:
                    shard, forest, held = (dim, which), None, []
                part = batch.slice(lo, hi - lo)
                v = flat[at[lo]:at[hi]].reshape(hi - lo, dim)
                if not asks:
                    held.append((v, part.select(["h1", "h2", "ids"])))
                    continue
                if not held:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate([x for x, _ in held]))
                    names = pa.Table.from_batches([x for _, x in held]).to_pylist()
                for a in range(0, len(v), 256):
                    yield _best(forest, names, v[a:a + 256], part.slice(a, 256), k)

    found = (index.union(probes).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
             .mapInArrow(look, "h1 long, h2 long, c1 long, c2 long, vec_id long, score double"))
    best = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id", "c1", "c2"))
    lists = found.withColumn("k", best).filter(f"k <= {k + 1}").drop("k")
    # every query takes its vector's list without itself
    own = (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")) & (F.col("vec_id") == F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id", "c1", "c2"))
    return (asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"]).filter(~own)
            .withColumn("rank", place).filter(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _best(forest: Forest, names: list[dict], v: np.ndarray, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The ``k + 1`` best (id, cosine) of each query among its candidates, ties to the smaller id."""
    unit = unit_rows(v)
    reach = forest.candidates(unit)
    score = np.where(reach, unit @ forest.unit.T, -np.inf)
    out = []
    for q, (h1, h2) in enumerate(zip(part.column("h1").to_pylist(), part.column("h2").to_pylist())):
        s = score[q]
        have = int(reach[q].sum())
        edge = np.partition(s, len(s) - min(k + 1, have))[len(s) - min(k + 1, have)] if have else np.inf
        near = np.flatnonzero(reach[q] & (s >= edge - 1e-9))
        exact = (unit[q] * forest.unit[near]).sum(axis=1)      # one order of summation for all shards
        entries = [(-float(x), i, names[c]["h1"], names[c]["h2"]) for x, c in zip(exact, near) for i in names[c]["ids"]]
        out += [(h1, h2, c1, c2, i, -x) for x, i, c1, c2 in sorted(entries)[:k + 1]]
    columns = list(zip(*out)) if out else [()] * 6
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                      names=["h1", "h2", "c1", "c2", "vec_id", "score"])
