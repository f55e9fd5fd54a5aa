"""Structured Streaming twins of the batch operators: T-S1 .. T-S6.

Every job reads a file stream with a declared schema. Its checkpoint stands beside its
sink (``<sink>-checkpoint``, or where the caller says), so a second start on the same
sink goes on where the first ended, and the batch ids of the sink never start again.
Sinks are idempotent: Spark's file sink, or ``foreachBatch`` into the folder of its batch
id. What a batch contributes is algebraic (counts, sums, the first and last by sequence number):
parts go to a ``PartLog``, which merges them level by level, and are added up on read. No result
depends on the order in which files arrive, and no row is ever late.

``run_available_now`` drives a query with ``trigger(availableNow=True)`` and
waits for it: the tests and the registered queries use that to compare the
streaming result with the batch operator on the same data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefmt import bucket_label
from ..operators import routing, sse, stats
from ..schemas import LOG_COLUMNS, LOG_WITH_DT, SYSTEM_LOG
from ..sources.ids import IdClaims, with_dense_ids
from ..sources.logstore import split_records
from .partlog import FANOUT, PartLog


def checkpoint_beside(sink: str) -> str:
    return sink.rstrip("/") + "-checkpoint"


def run_available_now(writer, checkpoint: str) -> None:
    """Start with ``trigger(availableNow=True)`` and wait."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise RuntimeError(str(q.exception()))


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


def _tag_batches(path: str, partition_by: list[str] | None = None) -> Callable:
    """foreachBatch body: write the batch's rows under ``batch_id=<id>``,
    overwriting that folder, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/batch_id={batch_id}")
    return write


# ------------------------------------------------------------------ T-S2

def append_log_stream(spark: SparkSession, source: str, sink: str, max_files: int | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """T-S2: continuous append of finished requests into the partitioned log."""
    s = file_stream(spark, source, LOG_WITH_DT, max_files)
    w = s.writeStream.format("parquet").partitionBy("dt").outputMode("append").option("path", sink)
    run_available_now(w, checkpoint or checkpoint_beside(sink))
    return spark.read.schema(LOG_WITH_DT).parquet(sink)


# ------------------------------------------------------------------ T-S3

def live_totals(spark: SparkSession, source: str, sink: str, max_files: int | None = None,
                checkpoint: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """T-S3: every batch writes one row of counts and sums; the totals are their sums on read."""
    s = file_stream(spark, source, LOG_WITH_DT, max_files)
    schema = stats.total_parts(spark.createDataFrame([], LOG_WITH_DT)).schema

    def merge(parts: DataFrame) -> DataFrame:
        return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])

    log = PartLog(spark, sink, schema, merge, fanout=fanout)
    run_available_now(s.writeStream.foreachBatch(lambda batch, k: log.add(k, stats.total_parts(batch))),
                      checkpoint or checkpoint_beside(sink))
    return stats.totals_of_parts(log.read())


# ------------------------------------------------------------------ T-S4

def live_recent(spark: SparkSession, source: str, sink: str, k: int = 50, max_files: int | None = None,
                schema=LOG_WITH_DT, columns: list[str] | None = None, source_format: str = "parquet",
                checkpoint: str | None = None) -> DataFrame:
    """T-S4: a bounded top-k (newest first) table maintained per batch: the
    previous version (k rows) union the batch, reduced to k rows, written as a
    new version folder. Never more than k + batch rows are handled. Works for
    the request log and the system log (``schema``/``columns``)."""
    cols = columns or LOG_COLUMNS
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    s = r.format(source_format).load(source)
    order = [F.desc("timestamp"), F.desc("id")]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        cur = batch.select(*cols)
        prev = [v for v in _versions(spark_, sink) if v < batch_id]
        if prev:
            cur = cur.unionByName(spark_.read.parquet(f"{sink}/v={max(prev)}").select(*cols))
        cur.orderBy(*order).limit(k).write.mode("overwrite").parquet(f"{sink}/v={batch_id}")

    run_available_now(s.writeStream.foreachBatch(merge), checkpoint or checkpoint_beside(sink))
    last = max(_versions(spark, sink), default=None)
    if last is None:                                 # nothing has arrived yet
        return spark.createDataFrame([], schema).select(*cols)
    return spark.read.parquet(f"{sink}/v={last}")


def ingest_system_log_stream(spark: SparkSession, source: str, sink: str, max_files: int | None = None,
                             checkpoint: str | None = None, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """S3 as a stream: application log records arriving as JSON lines. A batch goes to two sinks under its
    batch id: records, with the next ids where they bring none, and lines that are no record, as they are. A batch that is
    replayed finds what it has stored, or its claim on ids, and stores nothing twice. Returns
    (records, quarantine)."""
    records = PartLog(spark, f"{sink}/records", SYSTEM_LOG, lambda df: df, fanout=fanout)
    quarantine = PartLog(spark, f"{sink}/quarantine", "value string", lambda df: df, fanout=fanout)
    claims = IdClaims(spark, f"{sink}/ids")

    def step(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_records(batch.filter("trim(value) <> ''"))
        if not records.has(batch_id):
            numbered = with_dense_ids(good, claims, f"batch {batch_id}")
            records.add(batch_id, numbered.select(*[f.name for f in SYSTEM_LOG.fields]))
        quarantine.add(batch_id, bad)

    r = spark.readStream
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    run_available_now(r.text(source).writeStream.foreachBatch(step), checkpoint or checkpoint_beside(sink))
    return records.read(), quarantine.read()


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return out


# ------------------------------------------------------------------ T-S5

SERIES_PART = "label string, requests long, tokens long, cached_tokens long"


def live_series(spark: SparkSession, source: str, sink: str, period: str = "hour", max_files: int | None = None,
                checkpoint: str | None = None, time_zone: str = "UTC", fanout: int = FANOUT) -> DataFrame:
    """T-S5: requests, tokens and cached tokens per hour, day or month. Every batch writes
    its own sums per bucket; a bucket is their sum on read, however late a row came.
    There is no state and no watermark. ``None`` sums (no usage at all) stay NULL."""
    def part(batch: DataFrame) -> DataFrame:
        return batch.groupBy(bucket_label(F.col("timestamp"), period, time_zone).alias("label")).agg(
            F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"),
            F.sum(stats.cached_tokens()).alias("cached_tokens"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("requests", "tokens", "cached_tokens")])

    log = PartLog(spark, sink, SERIES_PART, merge, fanout=fanout)
    s = file_stream(spark, source, LOG_WITH_DT, max_files)
    run_available_now(s.writeStream.foreachBatch(lambda batch, k: log.add(k, part(batch))),
                      checkpoint or checkpoint_beside(sink))
    return merge(log.read())


# ------------------------------------------------------------------ T-S1

def _fold_schema(spark: SparkSession, schema):
    return sse.fold_partials(sse.parse_lines(spark.createDataFrame([], schema))).schema


def live_sse_fold(spark: SparkSession, source: str, sink: str, schema, max_files: int | None = None,
                  checkpoint: str | None = None, fanout: int = FANOUT, part_lines: int = sse.BUCKET_ROWS) -> DataFrame:
    """T-S1: every batch folds its lines per (request, seq bucket) and writes these parts;
    a request is the merge of its parts on read (``sse.stitch``, ``sse.text_parts``). Lines may arrive in any order and
    in any batch: every part is keyed by ``seq``, and a line that comes again changes nothing."""
    log = PartLog(spark, sink, _fold_schema(spark, schema), sse.merge_partials, fanout=fanout)
    s = file_stream(spark, source, schema, max_files)
    run_available_now(
        s.writeStream.foreachBatch(lambda batch, k: log.add(k, sse.fold_partials(sse.parse_lines(batch), part_lines))),
        checkpoint or checkpoint_beside(sink))
    return sse.merge_partials(log.read())


SSE_SHARDS = 64


def newest(revisions: DataFrame) -> DataFrame:
    """The newest revision of every request."""
    rest = [c for c in revisions.columns if c not in ("request_id", "protocol")]
    return revisions.groupBy("request_id", "protocol").agg(
        F.expr(f"max_by(struct({', '.join(rest)}), revision) AS _r")).select("request_id", "protocol", "_r.*")


def live_finished(spark: SparkSession, source: str, sink: str, schema, max_files: int | None = None,
                  checkpoint: str | None = None, fanout: int = FANOUT,
                  part_lines: int = sse.BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """T-S1, emission at the end of a stream (its dialect's last event, ``[DONE]`` or an error). Every batch
    emits a row (request, revision = batch id) for each request that it touched and whose end is known,
    folded from the parts of all batches so far: the first when the end comes, a corrected one when
    lines come after it. Reading takes the newest revision, so that files may come in any order.

    Parts are dealt to folders by a hash of the request; a batch reads the folders that its requests lie in, at most
    ``SSE_SHARDS`` numbers on the driver, and of these only its own requests go on. Returns (``sse.stitch`` and
    ``revision`` of the finished requests, their ``sse.text_parts``)."""
    shard = F.expr(f"CAST(pmod(xxhash64(request_id), {SSE_SHARDS}) AS INT)").alias("shard")
    fold = _fold_schema(spark, schema)
    parts = PartLog(spark, f"{sink}/parts", fold.add("shard", T.IntegerType()), lambda df: sse.merge_partials(df).select("*", shard).repartition("shard"),
                    ["shard"], fanout)
    emitted = sse.stitch(spark.createDataFrame([], _fold_schema(spark, schema))).schema.add("revision", T.LongType())
    done = PartLog(spark, f"{sink}/finished", emitted, newest, fanout=fanout)

    def step(batch: DataFrame, batch_id: int) -> None:
        parts.add(batch_id, sse.fold_partials(sse.parse_lines(batch), part_lines).select("*", shard).repartition("shard"))
        if done.has(batch_id):
            return
        touched = batch.select("request_id", shard).distinct()
        where = [r.shard for r in touched.select("shard").distinct().collect()]
        mine = parts.read().filter(F.col("shard").isin(where)).join(touched, ["shard", "request_id"], "left_semi")
        whole = sse.stitch(sse.merge_partials(mine.drop("shard"))).filter("saw_end")
        done.add(batch_id, whole.withColumn("revision", F.lit(batch_id).cast("long")))

    s = file_stream(spark, source, schema, max_files)
    run_available_now(s.writeStream.foreachBatch(step), checkpoint or checkpoint_beside(sink))
    finished = newest(done.read())
    lines_of = parts.read().drop("shard").join(finished.select("request_id", "protocol"), ["request_id", "protocol"], "left_semi")
    return finished, sse.text_parts(sse.merge_partials(lines_of))


# ------------------------------------------------------------------ T-S6

def live_route(spark: SparkSession, source: str, sink: str, schema, mappings: DataFrame, limits: DataFrame,
               default_model_id: str | None, default_embedding_model_id: str | None,
               prepare: Callable[[DataFrame], DataFrame], max_files: int | None = None,
               checkpoint: str | None = None) -> DataFrame:
    """T-S6: arriving requests are validated, estimated (``prepare``), routed
    with stream-static joins against the (size-checked, broadcast) dimensions,
    limit-checked, and split into accepted / rejected outputs."""
    s = prepare(file_stream(spark, source, schema, max_files))
    routed = routing.check_limit(routing.route(s, mappings, limits, default_model_id, default_embedding_model_id))
    out = routed.select(
        "request_id", "protocol", "resolved_model", "backend_id", "limit_status",
        F.when(F.col("limit_status") == 200, F.lit("accepted")).otherwise(F.lit("rejected")).alias("outcome"))

    run_available_now(out.writeStream.foreachBatch(_tag_batches(sink, ["outcome"])),
                      checkpoint or checkpoint_beside(sink))
    return spark.read.parquet(sink).drop("batch_id")
