"""Operator 10: concatenate and cut.

All documents, in ascending doc_id order, form one stream of ids that is cut every
``size`` ids. Pass one writes each document's ids with its place in its part;
prefix sums over the parts' totals give global offsets; pass two cuts at the
multiples of ``size``. Only the last sequence is not full.

Cases: null and empty texts hold the end id alone. Rows with equal doc_id follow
each other, ordered by the hash of the text; null doc_ids come first. Repeated rows
are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import ranges_within, slices
from .encode import encoded, encoder
from .pretokens import class_runs
from .token_files import with_starts
from .worker import release

SIZE = 2048


def encode_in_order(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pass one: part, local_start, doc_id, n_tokens, wide, ids
    (little-endian bytes of 16 bits an id, or of 32 where wide)."""

    classes = class_runs()

    def in_order(batches):
        part, written = TaskContext.get().partitionId(), 0
        for batch, ids, offsets in encoded(batches, encoder(tokenizer_path, classes), end_id):
            n = np.diff(offsets)
            wide = np.maximum.reduceat(ids, offsets[:-1]) > 0xFFFF     # a document has one id at least
            at = zip(offsets[:-1].tolist(), offsets[1:].tolist(), wide.tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part, np.int32)), pa.array(written + offsets[:-1]),
                batch.column(0), pa.array(n), pa.array(wide),
                pa.array([ids[a:b].astype("<u4" if w else "<u2").tobytes() for a, b, w in at], pa.binary())],
                names=["part", "local_start", "doc_id", "n_tokens", "wide", "ids"])
            written += len(ids)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "text"))
    return ordered.mapInArrow(in_order, "part int, local_start long, doc_id long, n_tokens long, wide boolean, ids binary")


def cut_pieces(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Pass two over ``encode_in_order``'s written rows: one row per piece, with its ids."""

    def pieces(batches):
        release()            # the first pass's dictionary
        for batch in (part for b in batches for part in slices(b, "ids")):
            begin = batch.column("start").to_numpy()
            n = batch.column("n_tokens").to_numpy()
            count = (begin + n - 1) // size - begin // size + 1       # a document has one id at least
            row = np.repeat(np.arange(len(n)), count)
            k = ranges_within(count)
            sequence = begin[row] // size + k
            a = np.maximum(begin[row], sequence * size)
            b = np.minimum(begin[row] + n[row], (sequence + 1) * size)
            all_ids = [np.frombuffer(x.as_buffer(), "<u4" if w.as_py() else "<u2").astype("<u4")
                       for x, w in zip(batch.column("ids"), batch.column("wide"))]
            ids = [all_ids[r][x:y].tobytes() for r, x, y in zip(row, a - begin[row], b - begin[row])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(a - begin[row]), pa.array(b - a),
                pa.array(n[row]), pa.array(sequence), pa.array(a - sequence * size),
                pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = with_starts(rows).select("doc_id", "start", "n_tokens", "wide", "ids")
    return placed.mapInArrow(
        pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int,
                   size: int = SIZE) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary,
    little-endian uint32)."""
    folder = scratch_path(spark, "pack-ids")
    encode_in_order(docs, tokenizer_path, end_id).write.parquet(folder)
    return cut_pieces(spark.read.parquet(folder), size)


def pack_digest(pieces: DataFrame) -> DataFrame:
    """Replace each piece's ids by their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
