"""Operator 7: token-id files in Simple-8b words.

File format (``S8B``): a file is a sequence of blocks, each ended by a line
feed. A block holds documents in ascending order, 65,536 ids at most; a document of more
ids goes on in the next block. A file takes 256 blocks, so that its size is bounded::

    4s magic 'S8B2' | i4 part | i8 first id of the block in its part
    i8 ids of the first document in earlier blocks | u4 whether the last document goes on
    u4 documents | u4 ids | u4 words | u4 escapes
    i8[documents] doc_id | u1[documents] doc_id is null | u4[documents] ids of the document here
    u4[ceil(ids / 1024)] first word of every run of 1024 ids (so runs decode side by side)
    u8[words] Simple-8b words | u4[escapes] ids that did not fit, in order

A word is a 4-bit selector and as many ids as fit into 60 bits at the selector's
width. Ids of 20 bits or more (and the value of twenty ones) are escaped: the
field is all ones and the id stands in the escape list.

Cases: null and empty texts hold the end id alone. Rows with equal doc_id follow
each other, ordered by the hash of the text; a null doc_id comes first. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .encode import encoded, encoder, id_lists
from .pretokens import class_runs

# fixed values: ids per word and bits per id of each selector
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3], np.int32)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20], np.int32)
RUN = 1024                      # ids between two stored word offsets
ESCAPE = (1 << 20) - 1
#: for every value, the least selector (from 1: a lone zero has no use for 0) wide enough for it
_LEAST = (1 + np.searchsorted(1 << BITS[1:], np.arange(ESCAPE + 1), side="right")).astype(np.uint8)
HEAD = struct.Struct("<4siqqIIIII")
BLOCK_IDS = 1 << 16             # most ids of a block
BLOCKS_PER_FILE = 256


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each run, words, escapes) of uint32 ids. Each word
    takes the selector that holds the most of the next ids."""
    n = len(ids)
    runs = -(-n // RUN)
    if not runs:
        return np.empty(0, "<u4"), np.empty(0, "<u8"), np.empty(0, "<u4")
    v = np.zeros(n + RUN, np.uint64)
    v[:n] = np.minimum(ids, ESCAPE)
    run_end = np.minimum((np.arange(n, dtype=np.int32) // RUN + 1) * RUN, n)
    # least selector each id fits, run by run; beyond a run's end all fit, so its last word may be part empty
    widest = int(COUNTS[0])
    least = np.zeros((runs, RUN + widest), np.uint8)
    flat = np.zeros(runs * RUN, np.uint8)
    flat[:n] = _LEAST[v[:n].astype(np.int32)]
    least[:, :RUN] = flat.reshape(runs, RUN)
    need = {1: least}                             # width -> largest of the next so many
    best = np.full((runs, RUN), len(COUNTS) - 1, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):      # from few wide ids to many narrow ones
        c = int(COUNTS[s])
        half = max(w for w in need if w <= c)
        while half < c:
            w = min(2 * half, c)
            m = need[half]
            need[w] = np.maximum(m[:, :m.shape[1] - (w - half)], m[:, w - half:])
            half = w
        best[need[c][:, :RUN] <= max(s, 1)] = s
    best = best.ravel()[:n]
    at, picked = np.arange(runs) * RUN, []
    ends = np.minimum(at + RUN, n)
    while len(at):                                # all runs advance side by side
        picked.append(at)
        at = at + COUNTS[best[at]]
        more = at < ends
        at, ends = at[more], ends[more]
    start = np.sort(np.concatenate(picked))
    selector = best[start].astype(np.int64)
    taken = np.minimum(COUNTS[selector], run_end[start] - start)
    word = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        rows, b = np.flatnonzero(selector == s), int(BITS[s])
        if b:
            k = np.arange(int(COUNTS[s]))
            fields = v[start[rows][:, None] + k]
            fields[k >= taken[rows][:, None]] = 0
            word[rows] |= np.bitwise_or.reduce(fields << (k * b).astype(np.uint64), axis=1)
    first = np.searchsorted(start, np.arange(runs) * RUN)
    return first.astype("<u4"), word.astype("<u8"), ids[ids >= ESCAPE].astype("<u4")


def unpack(first: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """Ids from ``pack``'s result, all words at once."""
    if not n:
        return np.empty(0, "<u4")
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector].astype(np.int64)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    ends = np.cumsum(count)
    begin_of_run = (ends - count)[first]
    before = ends - count - begin_of_run[run]              # ids of the run before this word
    count = np.minimum(count, np.minimum(RUN, n - RUN * run) - before)
    total = int(count.sum())
    if total != n:
        raise ValueError(f"block holds {total} ids, its header says {n}")
    within = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    bits = np.repeat(BITS[selector], count)
    ids = (np.repeat(words, count) >> (within * bits).astype(np.uint64)) & \
        ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))
    ids = ids.astype("<u4")
    escaped = np.flatnonzero((ids == ESCAPE) & (bits == 20))
    if len(escaped) != len(escapes):
        raise ValueError("escape list does not match the block")
    ids[escaped] = escapes
    return ids


def write_block(part: int, first_id: int, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray,
                before: int = 0, more: bool = False) -> bytes:
    first, words, escapes = pack(ids)
    return b"".join([
        HEAD.pack(b"S8B2", part, first_id, before, more, len(doc_ids), len(ids), len(words), len(escapes)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        lengths.astype("<u4").tobytes(),
        first.tobytes(), words.tobytes(), escapes.tobytes(), b"\n"])


def write_blocks(part: int, written: int, doc_ids: list[int | None], ids: np.ndarray, offsets: np.ndarray):
    """Blocks of some documents' ids: whole documents where they fit, else the next ``BLOCK_IDS`` ids of one."""
    at, total = 0, len(ids)
    while at < total:
        a = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, at + BLOCK_IDS, "right")) - 1      # documents that end here
        to = int(offsets[last]) if offsets[last] > at else min(at + BLOCK_IDS, total)
        b = int(np.searchsorted(offsets, to, "left"))
        edges = np.clip(offsets[a:b + 1], at, to)
        yield write_block(part, written + at, doc_ids[a:b], ids[at:to], np.diff(edges),
                          at - int(offsets[a]), bool(offsets[b] > to))
        at = to


def read_blocks(data):
    """(part, first id, ids of the first document in earlier blocks, whether the last goes on, doc ids, ids,
    offsets of the documents' ids) of every block of a file's bytes."""
    data, at = memoryview(data), 0
    while at < len(data):
        magic, part, first_id, before, more, n_docs, n, n_words, n_escapes = HEAD.unpack_from(data, at)
        if magic != b"S8B2":
            raise ValueError("not a token file block")
        at += HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got
        ids, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        first, words, escapes = take("<u4", -(-n // RUN)), take("<u8", n_words), take("<u4", n_escapes)
        if bytes(data[at:at + 1]) != b"\n":
            raise ValueError("a block does not end where its header says")
        at += 1
        yield part, first_id, before, bool(more), [None if z else i for i, z in zip(ids.tolist(), null.tolist())], \
            unpack(first, words, escapes, n), np.append(0, np.cumsum(lengths, dtype=np.int64))


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Write the ids of every document, in ascending doc_id order, to ``folder``
    through Spark's own committer (a lost executor's unfinished files never count)."""

    classes = class_runs()

    def blocks(batches):
        part, written = TaskContext.get().partitionId(), 0
        for batch, ids, offsets in encoded(batches, encoder(tokenizer_path, classes), end_id):
            for block in write_blocks(part, written, batch.column(0).to_pylist(), ids, offsets):
                yield pa.RecordBatch.from_pydict({"block": [block[:-1]]})     # the text writer ends it
            written += len(ids)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "text"))
    (ordered.mapInArrow(blocks, "block binary")
     .select(F.col("block").cast("string").alias("value"))      # raw bytes; the line feed ends a block
     .write.option("maxRecordsPerFile", BLOCKS_PER_FILE).mode("overwrite").text(folder))


PIECE = "part int, local_start long, doc_id long, n_tokens long, before long, whole boolean, ids binary"


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and block: part, local_start (ids of the part before the document), doc_id, n_tokens (here),
    before (ids of the document in earlier blocks), whole, ids (binary, little-endian uint32)."""

    def pieces(batches):
        for batch in batches:
            for data in batch.column(0):
                for part, first, before, more, doc_ids, ids, offsets in read_blocks(data.as_buffer()):
                    n = len(doc_ids)
                    start, earlier, whole = first + offsets[:-1], np.zeros(n, np.int64), np.ones(n, bool)
                    start[0] -= before
                    earlier[0] = before
                    whole[0] &= before == 0
                    whole[-1] &= not more
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, part, np.int32)), pa.array(start), pa.array(doc_ids, pa.int64()),
                        pa.array(np.diff(offsets)), pa.array(earlier), pa.array(whole), id_lists(ids, offsets)],
                        names=["part", "local_start", "doc_id", "n_tokens", "before", "whole", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(pieces, PIECE)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Documents from their pieces; only those of more than one block are grouped."""
    parts = F.array_sort(F.collect_list(F.struct("before", "ids")))
    return pieces.filter("NOT whole").groupBy("part", "local_start", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.aggregate(parts, F.expr("X''"), lambda x, p: F.concat(x, p["ids"])).alias("ids"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: part, local_start (ids of the part before it), doc_id, n_tokens,
    ids (binary, little-endian uint32)."""
    pieces = read_pieces(spark, folder)
    columns = ["part", "local_start", "doc_id", "n_tokens", "ids"]
    return pieces.filter("whole").select(columns).unionByName(joined_pieces(pieces).select(columns))


def with_starts(rows: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Second pass: ``start`` = ids of all parts before + ids of the part before.
    The window runs over one row per part."""
    from pyspark.sql import Window
    totals = rows.groupBy("part").agg(F.sum(size).alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start"))


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and digest every document's ids."""
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)

    def crc(batches):
        for batch in batches:
            whole, ids = batch.column(5).to_pylist(), batch.column(6)
            got = [zlib.crc32(x.as_buffer()) if w else None for x, w in zip(ids, whole)]
            rest = [None if w else x.as_py() for x, w in zip(ids, whole)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rest, pa.binary()), pa.array(got, pa.int64())],
                names=[*batch.schema.names, "ids_crc32"])

    slim = scratch_path(spark, "token-digest")
    read_pieces(spark, folder).mapInArrow(crc, PIECE + ", ids_crc32 long").write.parquet(slim)
    rows = spark.read.parquet(slim)
    columns = ["part", "local_start", "doc_id", "n_tokens", "ids_crc32"]
    rows = rows.filter("whole").select(columns).unionByName(
        joined_pieces(rows).withColumn("ids_crc32", F.crc32("ids")).select(columns))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
