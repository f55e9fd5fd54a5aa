"""Operator 3: WARC archives of Zstandard frames with a leading dictionary.

An archive is a sequence of Zstandard frames. The first is a skippable frame (magic
0x184D2A5D) that holds the dictionary, itself compressed or not; then each WARC record is one frame
that uses it. Empty skippable frames between records separate the rows that
Spark's writer puts out; any Zstandard reader passes over them. Spark's committer
writes the archives to the shared folder, so files of lost tasks never count.

The reader takes whole archives (the writer bounds their size), loads the dictionary,
decodes frame by frame, and checks version line, mandatory fields, field syntax, content length and
digests. A record that fails is a row with ``error`` set, or ends the read.

Cases: a null payload is written as an empty one. Rows with equal page_id and payload are equal records: all are responses, or
revisit the same page. A null page_id is smaller than any other; such a page can be a response,
and is written without the page field. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import slices

# fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"      # an empty skippable frame
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 16 << 10, 1 << 20, 3
ARCHIVE_BYTES = 16 << 20                             # payload bytes per archive, on average
DATE = "1970-01-01T00:00:00Z"                        # the table has no fetch time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def build_record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit has no block, but the digest and length of its payload."""
    name = digest(payload)
    block = b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, name)),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{name}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split()) or "urn:none"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, name)),
                   ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record's bytes; ValueError if it is not a valid record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the header")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header field: {line[:60]!r}")
        fields[name] = value.strip()
    for name in MANDATORY:
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["Content-Length"].isdecimal():
        raise ValueError("Content-Length is not a number")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length says {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    for name, needed in (("WARC-Block-Digest", True), ("WARC-Payload-Digest", fields["WARC-Type"] == "response")):
        if needed and name in fields and fields[name] != f"sha1:{digest(block)}":
            raise ValueError(f"{name} does not match")
    return fields, block


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its block headers (fixed by the format)."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = data[at:at + 3]
        if len(head) < 3:
            raise ValueError("archive ends inside a frame")
        head = int.from_bytes(head, "little")
        last = bool(head & 1)
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)      # a run-length block has one byte
    return at + 4 * (flags >> 2 & 1)


def frames(data: bytes):
    """(dictionary frame's bytes or None, then each record frame's decoded bytes)."""
    import zstandard
    at, decoder, first = 0, None, True
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            magic, size = struct.unpack_from("<II", data, at)
            body = data[at + 8:at + 8 + size]
            if len(body) < size:
                raise ValueError("archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and first:
                if body[:4] == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif data[at:at + 4] == FRAME_MAGIC:
            end = frame_end(data, at)
            if end > len(data):
                raise ValueError("archive ends inside a frame")
            yield (decoder or zstandard.ZstdDecompressor()).decompressobj().decompress(data[at:end])
            at = end
        else:
            raise ValueError("not a Zstandard frame")
        first = False


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, object]:
    """(leading skippable frame, dictionary) trained on samples; nothing if they are too few."""
    import zstandard
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return b"", None
    body = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, trained


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record per row (page_id, url, html). Of equal payloads of at least ``min_bytes``
    bytes, the largest page_id is the response and the others revisit it."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    named = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    # who answers for a payload: slim rows only, summed before the shuffle
    answer = (named.filter(f"size >= {min_bytes}").groupBy("sha", "size")
              .agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    folder_answers = scratch_path(spark, "payload-answers")
    slim = named.select("page_id", "sha", "size").distinct()
    (slim.join(answer, ["sha", "size"]).select("page_id", "sha", "answer")
     .filter("page_id IS NULL OR page_id < answer").filter("answer IS NOT NULL").write.parquet(folder_answers))
    revisits = spark.read.parquet(folder_answers)
    total = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    n = max(1, -(-total // ARCHIVE_BYTES))
    keyed = named.withColumn("key", F.coalesce("page_id", F.lit(0))).withColumn("no_id", F.col("page_id").isNull())
    marks = revisits.select(F.coalesce("page_id", F.lit(0)).alias("key"), F.col("page_id").isNull().alias("no_id"),
                            "sha", "answer")
    dealt = (keyed.repartition(n, "key", "no_id", "sha")
             .join(marks.hint("shuffle_hash"), ["key", "no_id", "sha"], "left")
             .select("page_id", "url", "payload", "answer"))

    def archive(batches):
        import zstandard
        compressor, held, size = None, [], 0

        def start():
            frame, trained = dictionary_frame(held)
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained) if trained else \
                zstandard.ZstdCompressor(level=LEVEL)
            return frame, made

        def rows_of(records, lead=b""):
            packed = [compressor.compress(r) for r in records]
            packed[0] = lead + packed[0]
            return pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["frame"])

        for batch in (p for b in batches for p in slices(b, "payload")):
            records = [build_record(page, url, payload, answer, answer is not None)
                       for page, url, payload, answer in zip(*(c.to_pylist() for c in batch.columns))]
            if compressor is None:            # the first records train the archive's dictionary
                held += records
                size += sum(map(len, records))
                if size < SAMPLE_BYTES:
                    continue
                frame, compressor = start()
                records, held = held, []
                yield rows_of(records, frame)
                continue
            yield rows_of(records)
        if held:
            frame, compressor = start()
            yield rows_of(held, frame)

    (dealt.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode("latin-1")).mode("overwrite").text(folder))


def read_archives(spark: SparkSession, folder: str, keep_errors: bool = False) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload (null for revisits), error."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                source = frames(data.as_buffer().to_pybytes())
                while True:
                    try:
                        raw = next(source, None)
                        if raw is None:
                            break
                        out.append(_row(*parse_record(raw)))
                    except ValueError as e:
                        if not keep_errors:
                            raise
                        out.append({"error": str(e)})
                    size += len(out[-1].get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(read, """page_id long, url string, record_type string, refers_to long,
        payload_bytes long, payload_digest string, payload binary, error string""")


def _row(fields: dict[str, str], block: bytes) -> dict:
    revisit = fields["WARC-Type"] == "revisit"
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length")}
    return {"page_id": number["X-Page-ID"], "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": number["X-Refers-To-Page-ID"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": number["X-Payload-Length"] if revisit else len(block),
            "payload": None if revisit else block, "error": None}


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("payload", pa.binary()), ("error", pa.string())])


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(spark, "archives")
    write_archives(pages, folder)
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
