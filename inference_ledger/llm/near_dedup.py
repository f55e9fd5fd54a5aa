"""Operator 6: SimHash near duplicates found with BK-trees.

A 64-bit fingerprint per document; fingerprints that differ in at most ``radius``
bits link. Distinct fingerprints are dealt to shards by the value of one of
``radius + 1`` equal blocks of bits: two fingerprints within the radius agree in one
block at least, so no link is lost. Each shard is a BK-tree (children keyed by the
integer distance to their parent) and a search follows only edges within the radius.
A block value that many fingerprints share is cut into several trees, and each of its
fingerprints is searched in all of them. Trees go to the tasks by the shuffle:
their number grows with the data, so none is broadcast.

Cases: a null or empty text, or one of white space only, has fingerprint zero and
links like any other. Rows with null doc_id get a component like the others; a component of such rows alone has
id null. Repeated rows are one fingerprint. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.heavy import heavy_join, heavy_keys
from ..session import scratch_path
from .columns import flat_bytes, lower_ascii, ranges_within, slices, word_bounds, xxh64
from .components import components
from .worker import release

SHINGLE, SEED, RADIUS = 3, 42, 3
TREE_NODES = 2048
_ONES = np.uint64(0x0101010101010101)


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of every text: a bit is set if over half of the shingle hashes set it."""
    data, offsets = flat_bytes(column)
    data = lower_ascii(data)
    starts, ends, words = word_bounds((data != 32) & ((data < 9) | (data > 13)), offsets)
    length = ends - starts
    # the words again, with one blank after each
    to = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    inside = ranges_within(length)
    joined[np.repeat(to, length) + inside] = data[np.repeat(starts, length) + inside]
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first_word = np.cumsum(words) - words
    row = np.repeat(np.arange(len(words)), count)
    w = first_word[row] + ranges_within(count)
    z = np.minimum(w + shingle - 1, first_word[row] + words[row] - 1)
    h = xxh64(joined, to[w], to[z] + length[z] - to[w], seed)
    fp = np.zeros(len(words), np.uint64)
    rows = np.flatnonzero(count)
    if not len(rows):
        return fp
    # per-byte counters of at most 255 shingles, then sums of those
    parts = -(-count[rows] // 255)
    at = np.repeat(np.cumsum(count[rows]) - count[rows], parts) + 255 * ranges_within(parts)
    part_of_row = np.cumsum(parts) - parts
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _ONES, at)
        totals = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_of_row, axis=0)
        for byte in range(8):
            on = 2 * totals[:, byte] > count[rows]
            fp[rows] |= on.astype(np.uint64) << np.uint64(8 * byte + bit)
    return fp


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and a long column ``name`` with the fingerprint of ``text``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def add(batches):
        release()
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column(part.schema.get_field_index("text")), shingle)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))],
                                                 names=[*part.schema.names, name])
    return docs.mapInArrow(add, schema)


class BKTree:
    """Nodes in insertion order; ``children[node]`` maps a distance to the child node."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{}]
        plain = [int(v) for v in values]
        for i, v in enumerate(plain[1:], 1):
            node = 0
            while True:
                d = (plain[node] ^ v).bit_count()
                nxt = self.children[node].get(d)
                if nxt is None:
                    break
                node = nxt
            self.children[node][d] = i
            self.children.append({})

    def hits(self, queries: np.ndarray, radius: int):
        """(node, indices of the queries within the radius of it) for every node that a search visits."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            d = np.bitwise_count(self.values[node] ^ queries[q])
            near = d <= radius
            if near.any():
                yield node, q[near]
            for k, child in self.children[node].items():
                on = (d >= k - radius) & (d <= k + radius)
                if on.any():
                    todo.append((child, q[on]))


class _Shard:
    """One tree and the components of its nodes; gives links that span them."""

    def __init__(self, values: np.ndarray, radius: int):
        self.tree, self.radius = BKTree(values), radius
        self.up = np.arange(len(values))

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def _join(self, node: int, others: np.ndarray, out: list) -> None:
        top = self._root(node)
        for other in np.unique(others):
            other = self._root(int(other))
            if other != top:
                self.up[other] = top
                out.append((int(self.tree.values[other]), int(self.tree.values[top])))

    def inner(self) -> list[tuple[int, int]]:
        out: list = []
        for node, q in self.tree.hits(self.tree.values, self.radius):
            self._join(node, q, out)
        return out

    def outer(self, queries: np.ndarray) -> list[tuple[int, int]]:
        out: list = []
        met = np.full(len(queries), -1)
        for node, q in self.tree.hits(queries, self.radius):
            new = q[met[q] < 0]
            out.extend((int(x), int(self.tree.values[node])) for x in queries[new])
            met[new] = node
            self._join(node, met[q], out)
        return out


def _pairs_small(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A shard of a few nodes: each is searched in the tree of those before it, then added."""
    out, children = [], [{}]
    for i, v in enumerate(values):
        if i:
            todo = [0]
            while todo:
                node = todo.pop()
                d = (values[node] ^ v).bit_count()
                if d <= radius:
                    out.append((v, values[node]))
                todo.extend(c for k, c in children[node].items() if d - radius <= k <= d + radius)
            node = 0
            while (d := (values[node] ^ v).bit_count()) in children[node]:
                node = children[node][d]
            children[node][d] = i
            children.append({})
    return out


def near_links(fps: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, distinct) that give the
    same components as all pairs within the radius."""
    n_blocks = radius + 1
    cuts = [64 * k // n_blocks for k in range(n_blocks + 1)]
    keys = [f"struct({k} AS block, shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L AS value)"
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    dealt = fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")) \
        .select("key.block", "key.value", "fp")
    sizes = (dealt.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
             .withColumn("trees", F.expr(f"CAST(ceil(n / {tree_nodes}) AS INT)")))
    heavy = heavy_keys(sizes.select("block", "value", "n"), n_blocks * fps.count())
    rows = (heavy_join(dealt, sizes, ["block", "value"], heavy, ["fp"])
            .withColumn("own", F.expr("CAST(pmod(xxhash64(fp), trees) AS INT)"))
            .withColumn("tree", F.explode(F.expr("sequence(own, trees - 1)")))   # each pair of trees meets once
            .select("block", "value", "tree", "fp", (F.col("own") != F.col("tree")).alias("guest")))

    def links(batches):
        last, shard, members, out = None, None, [], []

        def close():
            if shard is None and len(members) > 1:
                if len(members) <= 32:
                    out.extend(_pairs_small([int(v) for v in members], radius))
                else:
                    out.extend(_Shard(np.array(members, np.uint64), radius).inner())

        for batch in batches:
            value = batch.column("value").to_numpy()
            group = np.stack([batch.column("block").to_numpy().astype(np.int64), value,
                              batch.column("tree").to_numpy().astype(np.int64)])
            guest = np.asarray(batch.column("guest").to_pylist(), bool)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, len(fp)]):
                if hi == lo:
                    continue
                this = tuple(group[:, lo])
                if this != last:
                    close()
                    last, shard, members = this, None, []
                mine = fp[lo:hi][~guest[lo:hi]]
                members.extend(mine.tolist())
                theirs = fp[lo:hi][guest[lo:hi]]
                if len(theirs) and members:
                    if shard is None:       # members come first, so the tree is complete
                        shard = _Shard(np.array(members, np.uint64), radius)
                        out.extend(shard.inner())
                    out.extend(shard.outer(theirs))
            if len(out) > 50_000:
                yield _links(out)
                out = []
        close()
        yield _links(out)

    return (rows.repartition("block", "value", "tree").sortWithinPartitions("block", "value", "tree", "guest")
            .mapInArrow(links, "a long, b long"))


def _links(pairs: list) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_groups(spark: SparkSession, prints: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(fp, root, component_id) per distinct fingerprint of ``prints`` (doc_id, fp; a
    written table: it is read three times), and the fingerprints (fp) that very many rows share."""
    folder = scratch_path(spark, "fingerprint-classes")
    prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).write.parquet(folder)
    classes = spark.read.parquet(folder)
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = components(spark, near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    groups = heavy_join(rooted.select("fp", "root"), least.drop("n"), ["root"],
                        heavy_keys(least.select("root", "n"), n_classes), ["fp"])
    folder = scratch_path(spark, "fingerprint-groups")
    groups.write.parquet(folder)
    return spark.read.parquet(folder), heavy_keys(classes.select("fp", "n"), n_rows)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    folder = scratch_path(spark, "fingerprints")
    with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.col("text").cast("string").alias("text"))) \
        .select("doc_id", "fp").write.parquet(folder)
    prints = spark.read.parquet(folder)
    groups, heavy = near_groups(spark, prints)
    return (heavy_join(prints, groups, ["fp"], heavy, ["doc_id"])
            .select("doc_id", F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id"))


def one_per_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that have their group's smallest doc_id (one row
    per group: a null doc_id counts as larger than any other, ties go to the smaller text hash)."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    keys = [did.alias("did"), F.xxhash64(F.col("text").cast("string")).alias("th")]
    folder = scratch_path(spark, "fingerprints")
    (with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                                  *keys)).select("doc_id", "did", "th", "fp").write.parquet(folder))
    prints = spark.read.parquet(folder)
    groups, heavy = near_groups(spark, prints)
    kept = (heavy_join(prints, groups.select("fp", "root"), ["fp"], heavy, ["did", "th"])
            .groupBy("root").agg(F.min(F.struct("did", "th")).alias("first")).select("first.*"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys)
    return rows.join(kept, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select("row.*")
