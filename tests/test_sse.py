"""Stream folds on own transcripts: every dialect, every way to end, repeated and shuffled lines."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inference_ledger.functions.tokens import estimate_tokens, merged_segments, segment_tokens, text_segment
from inference_ledger.operators import finalize, sse

START = dt.datetime(2031, 5, 4, 3, 2, 1)
SCHEMA = "request_id long, protocol string, seq long, arrival_ts timestamp_ntz, line string"


def lines(protocol, *parts, request=77, step=25):
    out = []
    for i, p in enumerate(parts):
        text = p if isinstance(p, str) else "data: " + json.dumps(p)
        out.append((request, protocol, 3 * i + 5, START + dt.timedelta(milliseconds=step * (i + 1)), text))
    return out


def fold(spark, rows, estimate=11, request=77, bucket_rows=4):
    df = spark.createDataFrame(rows, SCHEMA)
    req = spark.createDataFrame([(request, START, estimate)], "request_id long, started_at timestamp_ntz, prompt_tokens long")
    parts = sse.fold_partials(sse.parse_lines(df), bucket_rows)
    rows = sse.with_text(sse.finalize_streams(sse.stitch(parts), req), sse.text_parts(parts)).orderBy("part").collect()
    return Row(**{**rows[0].asDict(), "part": len(rows), "text": "".join(r.text for r in rows)})


def delta(text):
    return {"choices": [{"index": 0, "delta": {"content": text}}]}


def said(text):
    return {"type": "response.output_text.delta", "delta": text}


def block(text):
    return {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": text}}


def counts(r):
    return r.prompt_tokens, r.completion_tokens, r.total_tokens


def test_reported_usage_is_taken_over_the_count(spark):
    usage = {"choices": [], "usage": {"prompt_tokens": 131, "completion_tokens": 17, "total_tokens": 150}}
    r = fold(spark, lines("chat", delta("seven "), delta("green"), delta(" kettles"), usage, "data: [DONE]"))
    assert r.text == "seven green kettles" and counts(r) == (131, 17, 150)
    assert r.ttft_ms == 25.0 and r.duration_ms == 125.0
    assert r.tokens_per_second == pytest.approx(17 / 0.1)


@pytest.mark.parametrize("protocol,parts", [
    ("chat", [delta("grey mare"), "data: [DONE]"]),
    ("chat", [delta("grey "), delta("mare")]),
    ("responses", [said("grey"), said(" mare"), {"type": "response.completed", "response": {}}]),
    ("messages", [block("grey mare"), {"type": "message_stop"}]),
])
def test_text_is_counted_however_a_clean_stream_ends(spark, protocol, parts):
    r = fold(spark, lines(protocol, *parts))
    assert r.text == "grey mare" and counts(r) == (11, 2, 13)


@pytest.mark.parametrize("protocol", ["chat", "responses", "messages"])
def test_text_of_a_failed_stream_is_not_counted(spark, protocol):
    part = {"chat": delta, "responses": said, "messages": block}[protocol]("half a li")
    r = fold(spark, lines(protocol, part, {"error": {"message": "tank is empty", "type": "api_error"}}))
    assert r.completion_tokens == 0 and r.error_message == "tank is empty"


def test_noise_between_the_data(spark):
    r = fold(spark, lines("chat", ": keep-alive", "data: {{{", "data:{\"choices\":[{\"delta\":{\"content\":\"lost\"}}]}",
                          "data:   " + json.dumps(delta("kept")) + " \t", "data: 12", "data: ", "event: ping"))
    assert r.text == "kept" and r.ttft_ms == 100.0


def test_items_of_a_response(spark):
    r = fold(spark, lines("responses", {"output": [{"type": "text", "text": "one, "}, {"type": "image"}]},
                          {"output": [{"type": "message", "message": {"content": "two"}}]}, said("."),
                          {"type": "response.completed", "response": {"usage": {"input_tokens": 61, "output_tokens": 8}}}))
    assert r.text == "one, two." and counts(r) == (61, 8, 69)


def test_fields_of_message_usage_add_up_over_events(spark):
    first = {"type": "message_start", "message": {"usage": {
        "input_tokens": 340, "output_tokens": 1, "cache_read_input_tokens": 96, "cache_creation_input_tokens": 12}}}
    r = fold(spark, lines("messages", first, block("ten"), {"type": "message_delta", "usage": {"output_tokens": 55}},
                          {"type": "message_delta", "usage": {"output_tokens": 71}}, {"type": "message_stop"}))
    assert counts(r) == (340, 71, 411) and (r.cache_read_input_tokens, r.cache_creation_input_tokens) == (96, 12)


def test_repeated_and_shuffled_lines_change_nothing(spark):
    rows = lines("chat", *[delta(c) for c in "a long string of letters"], "data: [DONE]")
    want = fold(spark, rows).asDict()
    assert fold(spark, list(reversed(rows)) + rows[3:9] + rows).asDict() == want


def test_request_without_lines_keeps_its_row(spark):
    r = fold(spark, lines("chat", delta("x"), request=1), request=2)
    assert r.text == "" and counts(r) == (11, 0, 11) and r.ttft_ms is None and r.duration_ms is None


def test_parts_of_several_batches_merge(spark):
    rows = lines("messages", *[block(c) for c in "merge me please"], {"type": "message_stop"})
    parts = [sse.fold_partials(sse.parse_lines(spark.createDataFrame(x, SCHEMA)), 4)
             for x in (rows[::2], rows[1::2], rows[2:7])]
    merged = sse.merge_partials(parts[0].union(parts[1]).union(parts[2]))
    assert "".join(r.text for r in sse.text_parts(merged).orderBy("part").collect()) == "merge me please"
    assert [r.text_tokens for r in sse.stitch(merged).collect()] == [3]


@pytest.mark.parametrize("text", ["<|endoftext|>abc 1234567 x!?", "大坝由谁负责大坝。由谁", "aaaaaaaaaaaa", "<|<|a_1|>|>!<|b|>", "  \n 1 2 "])
def test_a_token_cut_across_parts_counts_once(spark, text):
    want = spark.createDataFrame([(text,)], "t string").select(estimate_tokens(F.col("t")).alias("n")).first().n
    r = fold(spark, lines("chat", *[delta(c) for c in text], "data: [DONE]"), bucket_rows=5)
    assert r.text == text and r.part > 1 and r.completion_tokens == want


def test_segments_merge_to_the_count_of_the_whole(spark):
    rng = random.Random(4)
    bits = ["a", "bc", "1", "4567", "<|", "|>", "_", "<", "|", ">", " ", "\n", "!", "?.", "é", "大坝", "½", "٣", "<|x|>", "😀", "\xa0"]
    rows = []
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        cuts = sorted(rng.randint(0, len(t)) for _ in range(rng.randint(0, 4)))
        rows.append((t, [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]))
    df = spark.createDataFrame(rows, "t string, parts array<string>")
    got = df.select("t", estimate_tokens(F.col("t")).alias("want"), segment_tokens(merged_segments(
        F.transform("parts", text_segment))).alias("got")).collect()
    assert [r.t for r in got if r.want != r.got] == []


def test_status_of_a_failed_stream(spark):
    rows = [(429, "Backend HTTP 503: x", 429, None), (None, "Backend HTTP 503: x", 503, None), (None, "Connection error (ReadTimeout): y", 502, "ReadTimeout"),
            (7, "Internal proxy stream error (ValueError): z", 500, "ValueError"), (None, None, 500, None)]
    df = spark.createDataFrame(rows, "code int, text string, want int, class string")
    for r in df.select("*", finalize.failure_status(F.col("code"), F.col("text")).alias("got"), finalize.failure_class(F.col("text")).alias("c")).collect():
        assert (r.got, r.c) == (r.want, r["class"])
    failed = fold(spark, lines("chat", delta("x"), {"error": {"message": "too many", "type": "t", "code": 429}}))
    assert failed.error_code == 429 and failed.error_message == "too many"
