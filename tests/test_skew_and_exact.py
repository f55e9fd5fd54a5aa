"""A hot request spread over many fold buckets."""

import datetime as dt

from inference_ledger.operators import sse

T0 = dt.datetime(2024, 1, 1)


def test_hot_request_is_split_into_buckets(spark):
    words = [f"w{i}" for i in range(5000)]
    rows = [(7, "chat", 10 + i, T0 + dt.timedelta(milliseconds=i),
             'data: {"choices":[{"delta":{"content":"%s"}}]}' % ((" " if i else "") + w))
            for i, w in enumerate(words)]
    rows.append((7, "chat", 10_000_000, T0 + dt.timedelta(seconds=10), "data: [DONE]"))
    df = spark.createDataFrame(rows, "request_id long, protocol string, seq long, arrival_ts timestamp_ntz, line string")
    parts = sse.fold_partials(sse.parse_lines(df), bucket_rows=128)
    assert parts.count() > 30                          # the hot request is spread over many groups
    out = sse.stitch(parts).collect()[0]
    assert out.text == " ".join(words) and out.saw_done
    # shuffled arrival order gives the same text (lines are keyed by seq)
    shuffled = spark.createDataFrame(list(reversed(rows)), df.schema).repartition(7)
    assert sse.fold(shuffled, bucket_rows=128).collect()[0].text == out.text
