"""Operator 12: source divergence audit over a frequent-pattern tree of term rows.

Every language keeps the terms of at least three of its documents. A group (language, source) and a
language give each kept term p = 1 + floor(10^9 (count + 1) / (N + V)). The distance of a group from q is
the sum of floor((p - q)^2 / q) over all kept terms, zero counts included; q is another source's p.

Most terms have no count in most sources, so that the sum over all terms starts from what a pair of
zero counts gives, V times, and corrects it: once for every count that a source has (with the
other's zero), and once for every two counts of one term. The counts of a term, in order of source, are its
row. Equal rows are counted, sorted and inserted into a prefix tree: a node is a (source, count) under the counts
before it, its multiplicity the terms below it. Each node meets each of its ancestors once,
whatever the number of terms that share the path.

Spark's shape: words are counted per slice before the first shuffle, counts per (language, term) collect
one entry per source. Rows are dealt by range, so that shared prefixes meet in one part; a part holds
the current path and a bounded number of partial sums. Nothing grows with one source's or one term's
frequency. Counts are exact up to 2^63, the quotients decimal.

Cases: null text, lang and source count as ''. A group without terms, and a language that keeps none, have
pairs of value 0. Repeated documents count as documents each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import measured_broadcast, scratch_path
from .columns import flat_bytes, lower_ascii, slices, word_bounds

LEAST_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP = 200
SLICE = 4 << 20
SUMS_KEPT = 1 << 20          # partial sums of a task; beyond, they are handed on
BATCH = 1 << 15              # nodes whose ancestors are met at once


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term. Words are counted per
    slice in Python, then by Spark."""

    def count(batches):
        for batch in (part for b in batches for part in slices(b, "text", SLICE)):
            data, offsets = flat_bytes(batch.column(2))
            is_word = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | (data >= 128)
            starts, ends, per_row = word_bounds(is_word, offsets)
            if not len(starts):
                continue
            at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(starts), [
                None, pa.py_buffer(at), pa.py_buffer(lower_ascii(data)[is_word])]).dictionary_encode()
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
            names, group = np.unique([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in groups.to_pylist()], return_inverse=True)
            some = np.zeros(len(names), np.int64)
            some[group] = np.arange(len(group))               # a row of each group
            word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(per_row)), per_row)
            size = len(words.dictionary)
            pairs, n = np.unique(row * size + word, return_counts=True)
            key = group[pairs // size] * size + pairs % size
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            row_of = pa.array(some[key[first] // size])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row_of), batch.column(1).take(row_of),
                words.dictionary.take(pa.array(key[first] % size)).cast(pa.string()),
                pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(key))))],
                names=["lang", "source", "term", "n", "docs"])

    return (_slim(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, counts): the terms of at least ``least`` documents of a language, with an entry
    (source, n) for every source that has them, in order of source."""
    return (term_counts(docs).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .filter(F.col("docs") >= least).drop("docs"))


def probability(count: str, total: str, terms: str) -> str:
    """SQL of p = 1 + floor(10^9 (count + 1) / (N + V)), exact for counts of any size."""
    return (f"1 + CAST((CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div "
            f"CAST({total} + {terms} AS DECIMAL(20, 0)) AS BIGINT)")


def distance(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q); p and q are at most 10^9 + 1, so that the square fits a BIGINT."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


# ------------------------------------------------------------------ the tree

def quotient(p, q):
    d = p - q
    return d * d // q


class PrefixSums:
    """Sums of a task by (language, source, other source)."""

    def __init__(self):
        self.keys, self.values, self.held = [], [], 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(key)
        self.values.append(value)
        self.held += len(key)
        if self.held > 4 * SUMS_KEPT:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(self.values))
        self.keys, self.values, self.held = [key], [total], len(key)
        return key, total


def tree_corrections(batches):
    """Sorted rows (lang, sources, ps, zeros, terms) to sums (lang, source, other, value). Rows of one language that share a
    prefix follow each other; the path of the last row is the part of the tree that is still open. A node is
    closed when a row leaves it, with all its terms counted, and meets its ancestors then.

    ``sources`` are the sources' numbers in their language, ``ps`` the p of their counts, ``zeros`` the p that
    a count of zero has there."""
    lang, path, closed, sums = None, [], [], PrefixSums()
    # path: [source, p, zero, terms]; closed: (node, its ancestors)

    def meet():
        """All closed nodes with all their ancestors."""
        if not closed:
            return
        depth = np.array([len(above) for _, above in closed], np.int64)
        node = np.repeat(np.array([n for n, _ in closed], np.int64), depth, axis=0)
        above = np.array([a for _, many in closed for a in many], np.int64).reshape(-1, 3)
        closed.clear()
        if not len(above):
            return
        s, p, p0, terms = node.T
        o, q, q0 = above.T
        # (p, q) takes the place of (p, 0) + (0, q) - (0, 0), seen from either side
        there = terms * (quotient(p, q) - quotient(p, q0) - quotient(p0, q) + quotient(p0, q0))
        back = terms * (quotient(q, p) - quotient(q, p0) - quotient(q0, p) + quotient(q0, p0))
        sums.add(s << 32 | o, there)
        sums.add(o << 32 | s, back)

    def leave(depth: int):
        while len(path) > depth:
            s, p, p0, terms = path.pop()
            closed.append(((s, p, p0, terms), [x[:3] for x in path]))
            if path:
                path[-1][3] += terms
            if len(closed) >= BATCH:
                meet()

    def hand_on():
        meet()
        key, value = sums.fold()
        sums.__init__()
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(key), pa.string()), pa.array((key >> 32).astype(np.int32)),
            pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(value)], names=["lang", "sid", "oid", "value"])

    for batch in batches:
        for its, sources, ps, zeros, terms in zip(*(c.to_pylist() for c in batch.columns)):
            if its != lang:
                leave(0)
                if lang is not None:
                    yield hand_on()
                lang = its
            same = 0
            while same < len(path) and same < len(sources) and path[same][0] == sources[same] and path[same][1] == ps[same]:
                same += 1
            leave(same)
            path += [[s, p, z, 0] for s, p, z in zip(sources[same:], ps[same:], zeros[same:])]
            path[-1][3] += terms
        if sums.held > SUMS_KEPT:
            yield hand_on()
    if lang is not None:
        leave(0)
        yield hand_on()


# ------------------------------------------------------------------ the audit

def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "divergence-terms")
    kept_terms(docs, least).write.parquet(folder)
    terms = spark.read.parquet(folder)

    # one row per group: its number in its language, N, and the language's N and V
    found = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(
        F.sum("c.n").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.expr("sum(aggregate(counts, 0L, (x, c) -> x + c.n))").alias("lang_n"))
    every = _slim(docs).select("lang", "source").distinct()
    by_lang = Window.partitionBy("lang")
    groups = (every.join(found, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
                      F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
                      (F.row_number().over(by_lang.orderBy("source")) - 1).alias("sid")))
    folder = scratch_path(spark, "divergence-groups")
    groups.selectExpr("*", f"IF(v = 0, 0, {probability('0', 'n', 'v')}) AS zero").write.parquet(folder)
    groups = spark.read.parquet(folder)
    small = measured_broadcast(groups)

    counts = (terms.select("lang", "term", F.expr("aggregate(counts, 0L, (x, c) -> x + c.n)").alias("lang_count"), F.explode("counts").alias("c"))
              .select("lang", "term", "lang_count", F.col("c.source").alias("source"), F.col("c.n").alias("c"))
              .join(small, ["lang", "source"])
              .selectExpr("lang", "source", "term", "sid", "zero", f"{probability('c', 'n', 'v')} AS p",
                          f"{probability('lang_count', 'lang_n', 'v')} AS q"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = (counts.filter("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", f"{distance('p', 'q')} AS value")
               .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))

    # every pair of zero counts, for all terms
    other = groups.selectExpr("lang", "source AS item", "sid AS oid", "zero AS q0")
    pairs = groups.join(other, "lang").filter("sid <> oid")
    # a count against the other's zero, for each count that a source has
    seen = counts.groupBy("lang", "sid", "zero", "p").agg(F.count("*").alias("terms"))
    folder = scratch_path(spark, "divergence-counts")
    seen.write.parquet(folder)
    seen = spark.read.parquet(folder)
    against = measured_broadcast(groups.selectExpr("lang", "sid AS oid", "zero AS q0"))
    single = seen.join(against, "lang").filter("sid <> oid").selectExpr(
        "lang", "sid", "oid", f"terms * ({distance('p', 'q0')} - {distance('zero', 'q0')}) AS there",
        f"terms * ({distance('q0', 'p')} - {distance('q0', 'zero')}) AS back")
    single = single.select("lang", F.explode(F.expr(
        "array(struct(sid AS sid, oid AS oid, there AS value), struct(oid AS sid, sid AS oid, back AS value))")).alias("x")).select("lang", "x.*")
    # two counts of one term, through the tree
    rows = (counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "zero"))).alias("row"))
            .groupBy("lang", "row").agg(F.count("*").alias("terms")))
    rows = rows.repartitionByRange(parts, "lang", "row").sortWithinPartitions("lang", "row")
    double = rows.select("lang", "row.sid", "row.p", "row.zero", "terms").mapInArrow(
        tree_corrections, "lang string, sid int, oid int, value long")
    corrections = single.unionByName(double).groupBy("lang", "sid", "oid").agg(F.sum("value").alias("more"))
    by_pair = (pairs.join(corrections, ["lang", "sid", "oid"], "left")
               .selectExpr("lang", "source", "'pair' AS part", "item",
                           f"IF(v = 0, 0, v * {distance('zero', 'q0')}) + coalesce(more, 0) AS value")
               .withColumn("rank", F.row_number().over(ranked)))
    return by_pair.unionByName(by_term)
