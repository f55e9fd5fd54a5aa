"""Operator 9: removal of repeated substrings by merging Burrows-Wheeler transforms.

Every byte covered by a 200-byte string that also starts anywhere else is removed.

1. *Pieces.* Each 200-byte window is named by an anchor, the place of its least hashed
   32-gram, so equal windows have equal anchors. Windows that share an anchor and stand at
   offsets of one 64-byte cell before it form a piece: at most 64 windows that all
   cover the same core of 137 bytes. Windows can only be equal if their cores are.
2. *Candidates.* Pieces whose core occurs once are dropped (a count with map-side sums, then
   a join that spreads the pieces of a core which very many share). Equal pieces are kept once, with their number.
3. *Transforms.* Where a core has several distinct pieces, their text goes to the task of the
   core. Shards of pieces get a Burrows-Wheeler transform over 8-byte symbols; the shards
   are merged by refining their interleave one symbol at a time, never by sorting their
   suffixes again. Boundaries that no refinement has drawn after 25 symbols hold common
   prefixes of 200 bytes: such intervals with two or more windows are repeated. A core with
   one distinct piece is such an interval as it stands. A core with more distinct pieces
   than a task should hold is cut finer, to single windows, which are counted by content.
4. *Removal.* Repeated windows go back to their documents, and covered bytes go.

The text is scanned for 1 and 2, and shuffled once for 3 and 4.

Cases: null text counts as empty. Rows with equal doc_id are documents of their own; equal rows are too, and so
repeat each other. Texts under 200 bytes keep all. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.heavy import heavy_join, heavy_keys
from ..session import drop_finished_shuffles, scratch_path
from .columns import SLICE_BYTES, flat_bytes, ranges_within
from .worker import release

WINDOW = 200
GRAM = 32                        # bytes hashed to choose an anchor
CELL = 64                        # offsets before the anchor that share a piece
CORE = WINDOW - CELL + 1
SYMBOL = 8                       # bytes per symbol of the transforms
CHUNK = 1 << 20                  # bytes worked on at a time
SHARD_WINDOWS = 1 << 14          # windows per shard of the transforms
MERGE_WINDOWS = 1 << 17          # windows after which a merge closes at the next core
HOT_PIECES = 4096                # distinct pieces of a core beyond which it is cut to single windows
LEVELS = WINDOW // SYMBOL

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(x: int) -> np.ndarray:
    """1, x, x*x, ... modulo 2**64."""
    out = np.full(CHUNK + WINDOW + 1, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[:len(x) - (width - have)], x[width - have:])
    return x


def pieces_of(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, piece hash, first window, windows) of the pieces of at most CHUNK + WINDOW
    bytes; ``valid`` marks the window starts that count."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWER[:n])])

        def of(lo, hi):
            return (sums[hi] - sums[lo]) * _INVERSE[lo]

        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _INVERSE[:n - GRAM + 1])
        grams = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_least(grams, WINDOW - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        at = np.flatnonzero(valid)
        anchor = anchor[at]
        cell = (anchor - at) // CELL
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0) | (np.diff(cell) != 0)
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(at)))
        core = anchor[first] - cell[first] * CELL
        key = _mix(of(core, core + CORE) + cell[first].astype(np.uint64))
        piece = _mix(of(at[first], at[first] + windows + WINDOW - 1) ^ np.uint64(_BASE))
    return key, piece, at[first], windows


def document_pieces(data: np.ndarray, offsets: np.ndarray):
    """(row, key, piece hash, start in the row, windows) arrays over all rows, a chunk at a time."""
    last = offsets[1:] - WINDOW                   # last window start of each row
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        rows = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left"))
        starts, ends = np.maximum(offsets[rows], lo), np.minimum(last[rows] + 1, hi)
        keep = ends > starts
        if not keep.any():
            continue
        rows, starts, ends = rows[keep], starts[keep], ends[keep]
        part = data[lo:hi + WINDOW - 1]
        edges = np.zeros(len(part) + 1, np.int8)
        np.add.at(edges, starts - lo, 1)
        np.add.at(edges, ends - lo, -1)
        valid = np.cumsum(edges[:-1], dtype=np.int8) > 0
        # two rows' windows never touch: WINDOW - 1 starts between them are not valid
        key, piece, first, windows = pieces_of(part, valid)
        row = rows[np.searchsorted(starts - lo, first, "right") - 1]
        yield row, key, piece, first + lo - offsets[row], windows


class ShardTransform:
    """Burrows-Wheeler columns of one shard's windows. ``columns[h]`` holds, in the order of
    the suffixes that start ``h`` symbols before a window's end, the symbol before each;
    ``order`` is the windows' order by all their symbols."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """``text`` gives the 8-byte symbol at every byte position; ``ends`` the windows' ends."""
        self.order = np.arange(len(ends))
        self.columns = []
        for h in range(1, LEVELS + 1):
            column = text[ends[self.order] - SYMBOL * h]
            self.columns.append(column)
            self.order = self.order[np.argsort(column, kind="stable")]


def merge(shards: list[ShardTransform]) -> tuple[np.ndarray, np.ndarray]:
    """(windows in merged order, numbered through the shards; interval of each).

    Level by level, the shards' columns are read through the interleave, and one stable pass
    by symbol gives the interleave of the next level: the order inside a shard is never
    looked at. A boundary is drawn where the symbol or the interval before changes."""
    sizes = [len(s.order) for s in shards]
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    interval = np.zeros(len(interleave), np.int64)
    for h in range(LEVELS):
        symbols = np.empty(len(interleave), np.uint64)
        symbols[np.argsort(interleave, kind="stable")] = np.concatenate([s.columns[h] for s in shards])
        step = np.argsort(symbols, kind="stable")
        interleave, symbols, interval = interleave[step], symbols[step], interval[step]
        edge = np.ones(len(step), bool)
        edge[1:] = (np.diff(interval) != 0) | (symbols[1:] != symbols[:-1])
        interval = np.cumsum(edge) - 1
    windows = np.empty(len(interleave), np.int64)
    base = np.cumsum([0, *sizes[:-1]])
    windows[np.argsort(interleave, kind="stable")] = np.concatenate([s.order + b for s, b in zip(shards, base)])
    return windows, interval


def repeated_windows(pieces: list[bytes], weights: list[int]) -> list[int]:
    """For each piece, the bit mask of its windows that start twice or more among all pieces
    (a piece counts as often as its weight says)."""
    length = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces) + bytes(SYMBOL), np.uint8)
    text = np.ndarray(len(data) - SYMBOL + 1, ">u8", data, strides=(1,))
    at = np.cumsum(length) - length
    windows = length - WINDOW + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    inside = ranges_within(windows)
    ends = at[piece] + inside + WINDOW
    shards = [ShardTransform(text, ends[lo:lo + SHARD_WINDOWS]) for lo in range(0, len(ends), SHARD_WINDOWS)]
    order, interval = merge(shards)
    total = np.bincount(interval, np.array(weights)[piece[order]])
    found = order[total[interval] >= 2]
    masks = np.zeros(len(pieces), np.uint64)
    np.bitwise_or.at(masks, piece[found], np.uint64(1) << inside[found].astype(np.uint64))
    return masks.view(np.int64).tolist()


# --------------------------------------------------------------------- Spark steps

_PIECE = "id1 long, id2 long, key long, piece long, start int, windows int"


def _keyed(docs: DataFrame) -> DataFrame:
    """id1, id2 (identity of a row: two independent 64-bit hashes of its doc_id and text, so that
    only repeated rows share it), row (all columns of ``docs``)."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    return docs.select(
        F.xxhash64(doc_id.isNull(), doc_id, text).alias("id1"),
        F.xxhash64(F.sha2(text, 256), doc_id.isNull(), doc_id).alias("id2"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _row_slices(batch: pa.RecordBatch, text_at: int):
    """Row ranges of a batch of about SLICE_BYTES of text, with the text column of each."""
    rows = batch.column(batch.schema.get_field_index("row"))
    _, offsets = flat_bytes(rows.field(text_at))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo), rows.field(text_at).slice(lo, hi - lo)
        lo = hi


def candidate_pieces(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Pieces (id1, id2, key, piece, start, windows, n) whose core occurs twice or more (``n`` times), written
    to the shared folder; the cores (key) that very many of them share; their number."""

    def pieces(batches):
        release()
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            for row, key, piece, start, windows in document_pieces(data, offsets):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id1").take(take), batch.column("id2").take(take),
                    pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)),
                    pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=["id1", "id2", "key", "piece", "start", "windows"])

    found = _keyed(docs.select("doc_id", "text")).select("id1", "id2", "row.text").mapInArrow(pieces, _PIECE)
    folder = scratch_path(spark, "repeat-cores")
    found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").write.parquet(folder)
    drop_finished_shuffles(spark)
    twice = spark.read.parquet(folder)
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = heavy_keys(twice, total)
    folder = scratch_path(spark, "repeat-candidates")
    heavy_join(found, twice, ["key"], heavy, ["id1", "id2", "start"], hint="shuffle_hash").select(
        "id1", "id2", "key", "piece", "start", "windows", "n").write.parquet(folder)
    drop_finished_shuffles(spark)
    return spark.read.parquet(folder), heavy, total


def _grouped(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with the set of its rows (at most a document's own pieces; equal rows of the
    table, which share an identity, add nothing)."""
    return rows.groupBy("id1", "id2").agg(F.collect_set(F.struct(*columns)).alias("list"))


def repeated_pieces(candidates: DataFrame, heavy: DataFrame, text: DataFrame, text_at: int) -> DataFrame:
    """(key, piece, weight, mask): which windows of every distinct candidate piece are repeated, and how often the
    piece occurs. ``heavy`` are the cores that very many candidates share."""
    distinct = candidates.groupBy("key", "piece", "n").agg(
        F.count("*").alias("weight"), F.min(F.struct("id1", "id2", "start", "windows")).alias("at"))
    # a piece that occurs as often as its core is the core's only one
    whole = distinct.filter("weight = n").select("key", "piece", "weight", F.lit(-1).cast("long").alias("mask"))
    several = distinct.filter("weight < n")
    # only a core that occurs more than HOT_PIECES times can have more distinct pieces
    often = several.filter(f"n > {HOT_PIECES}")
    variety = often.groupBy("key").agg(F.count("*").alias("variety"))
    often = heavy_join(often, variety, ["key"], heavy, ["piece"])

    def cut_out(batches):
        release()
        for batch in batches:
            for part, column in _row_slices(batch, text_at):
                data, offsets = flat_bytes(column)
                data = data.tobytes()
                out = {"key": [], "piece": [], "weight": [], "bytes": []}
                for at, wanted in zip(offsets, part.column("list").to_pylist()):
                    for w in wanted:
                        lo = int(at) + w["start"]
                        for name in ("key", "piece", "weight"):
                            out[name].append(w[name])
                        out["bytes"].append(data[lo:lo + w["windows"] + WINDOW - 1])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("key", pa.int64()), ("piece", pa.int64()), ("weight", pa.int64()), ("bytes", pa.binary())]))

    def cut(pieces):
        wanted = _grouped(pieces.select("at.*", "key", "piece", "weight"),
                          "key", "piece", "weight", "start", "windows")
        # rows that share an identity share their text, so each is cut from one of them
        return (text.join(wanted.hint("shuffle_hash"), ["id1", "id2"]).select("row", "list")
                .mapInArrow(cut_out, "key long, piece long, weight long, bytes binary"))

    def transforms(batches):
        release()
        held, windows, last = {}, 0, None

        def close():
            if held:
                (keys, pieces), (texts, weights) = zip(*held), zip(*held.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(pieces, pa.int64()), pa.array(weights, pa.int64()),
                     pa.array(repeated_windows(list(texts), list(weights)), pa.int64())],
                    names=["key", "piece", "weight", "mask"])

        for batch in batches:
            for key, piece, weight, text in zip(*(batch.column(k).to_pylist()
                                                  for k in ("key", "piece", "weight", "bytes"))):
                if key != last and windows >= MERGE_WINDOWS:
                    yield from close()
                    held, windows = {}, 0
                last = key
                held[key, piece] = (text, weight)
                windows += len(text) - WINDOW + 1
        yield from close()

    merged = (cut(several.filter(f"n <= {HOT_PIECES}").unionByName(
                  often.filter(f"variety <= {HOT_PIECES}").drop("variety")))
              .repartition("key").sortWithinPartitions("key")
              .mapInArrow(transforms, "key long, piece long, weight long, mask long"))

    # windows of a core with very many distinct pieces, each by its own content
    single = (cut(often.filter(f"variety > {HOT_PIECES}"))
              .select("key", "piece", "weight", "bytes",
                      F.explode(F.expr(f"sequence(0, length(bytes) - {WINDOW})")).alias("k"))
              .withColumn("window", F.expr(f"sha2(substring(bytes, k + 1, {WINDOW}), 256)"))
              .select("key", "piece", "weight", "k", "window").dropDuplicates(["key", "piece", "k"]))
    twice = single.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select("window")
    hot = (single.join(twice, "window").groupBy("key", "piece", "weight")
           .agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask")))
    return whole.union(merged).union(hot)


def remove_repeats(spark: SparkSession, docs: DataFrame, finish: Callable | None = None, schema=None) -> DataFrame:
    """``row`` (all columns of ``docs``), kept (binary), n_bytes, n_removed, n_spans per document; or the columns of
    ``schema`` that ``finish`` makes of a batch of these, in the same Python process."""
    candidates, heavy, total = candidate_pieces(spark, docs)
    text_at = docs.columns.index("text")
    text = _keyed(docs).repartition("id1", "id2")
    folder = scratch_path(spark, "repeat-masks")
    repeated_pieces(candidates, heavy, text, text_at).filter("mask != 0").write.parquet(folder)
    drop_finished_shuffles(spark)
    found = spark.read.parquet(folder)
    # a piece that occurs twice or more is repeated, so that all that occur often are found
    often = heavy_keys(found.select("key", "piece", "weight"), total, "weight")
    marks = _grouped(heavy_join(candidates, found.select("key", "piece", "mask"), ["key", "piece"], often,
                                ["id1", "id2", "start"]), "start", "windows", "mask")
    row_type = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema[0]
    marked = T.StructType([row_type, *(T.StructField(n, t) for n, t in (
        ("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()),
        ("n_spans", T.LongType())))])

    def remove(batches):
        release()
        for batch in batches:
            for part, column in _row_slices(batch, text_at):
                data, offsets = flat_bytes(column)
                lists = part.column("list")
                flat = lists.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(np.concatenate(
                    [[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])))
                start = flat.field(0).to_numpy().astype(np.int64) + offsets[row]
                count = flat.field(1).to_numpy().astype(np.int64)
                mask = flat.field(2).to_numpy().view(np.uint64)
                first = np.repeat(start, count) + ranges_within(count)
                on = (np.repeat(mask, count) >> ranges_within(count).astype(np.uint64)) & np.uint64(1) > 0
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, first[on], 1)
                np.add.at(edges, first[on] + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept_data = data[~gone].tobytes()
                removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                at = offsets[:-1][offsets[:-1] < len(data)]
                begins[at] = gone[at]                       # spans end with their document
                spans = np.concatenate([[0], np.cumsum(begins)])[offsets]
                cut = offsets - removed
                batch = pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array([kept_data[x:y] for x, y in zip(cut, cut[1:])], pa.binary()),
                    pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans))],
                    names=["row", "kept", "n_bytes", "n_removed", "n_spans"])
                yield finish(batch) if finish else batch

    return text.join(marks.hint("shuffle_hash"), ["id1", "id2"], "left").select("row", "list").mapInArrow(remove, schema if finish else marked)


def repeat_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return remove_repeats(spark, docs.select("doc_id", "text")).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, with all columns, the text less its repeated bytes (and less the parts of
    characters that a cut leaves), and n_chars, if there is such a column, that text's length."""
    text_at = docs.columns.index("text")
    names = docs.columns
    sizes_at = names.index("n_chars") if "n_chars" in names else None

    def decode(batch):
        row, kept = batch.column(0), batch.column(1)
        columns = [row.field(i) for i in range(row.type.num_fields)]
        was_null = columns[text_at].is_null().to_pylist()
        text = [None if null else x.as_buffer().to_pybytes().decode("utf-8", "ignore")
                for null, x in zip(was_null, kept)]
        columns[text_at] = pa.array(text, pa.string())
        if sizes_at is not None:
            columns[sizes_at] = pa.array([None if t is None else len(t) for t in text], columns[sizes_at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return remove_repeats(spark, docs, decode, docs.schema)
