"""Packing's second pass: checksums need no Python process."""

import zlib

from inference_ledger.llm import packing


def test_piece_checksums_are_native(spark):
    ids = [b"", b"\x01\x00\x00\x00", bytes(range(256)) * 32]
    df = spark.createDataFrame([(k, 0, 1, 1, 0, 0, bytearray(x)) for k, x in enumerate(ids)],
                               "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    out = packing.pack_digest(df)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.ids_crc32 for r in out.collect()} == {k: zlib.crc32(x) for k, x in enumerate(ids)}
