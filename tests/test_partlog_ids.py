"""The log of batch parts (levels, manifests, a job that dies), ids by claims, and the two streams that use them."""

import datetime as dt
import math
import threading

import pytest
from pyspark.sql import functions as F

from inference_ledger.operators import sse
from inference_ledger.sources import logstore
from inference_ledger.sources.ids import IdClaims, with_dense_ids
from inference_ledger.streaming import jobs
from inference_ledger.streaming.partlog import PartLog

T0 = dt.datetime(2031, 5, 4)
LINES = "request_id long, protocol string, seq long, arrival_ts timestamp_ntz, line string"
PIECE = 'data: {"choices":[{"delta":{"content":"%s"}}]}'


def sums(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def part(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, n long")


def total(log):
    return {r.k: r.n for r in sums(log.read()).collect()}


def test_levels_keep_few_folders(spark, tmp_path):
    log = PartLog(spark, f"file://{tmp_path}/log", "k long, n long", sums, fanout=3)
    assert log.read().count() == 0
    for b in range(40):
        log.add(b, part(spark, (b % 2, 1), (7, b)))
        assert len(log.entries()) <= 2 * (1 + math.floor(math.log(b + 1, 3)))
    assert total(log) == {0: 20, 1: 20, 7: sum(range(40))}
    log.add(39, part(spark, (0, 1000)))                       # a replayed batch
    log.add(3, part(spark, (0, 1000)))                        # ... that has been merged long ago
    assert total(log) == {0: 20, 1: 20, 7: sum(range(40))}
    folders = [p.name for p in (tmp_path / "log").iterdir() if p.name.startswith("part-")]
    assert len(folders) <= len(log.entries()) + 3             # what the manifest before names too


def test_a_job_that_dies_between_folder_and_manifest(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/log"
    log = PartLog(spark, root, "k long, n long", sums, fanout=3)
    for b in range(2):
        log.add(b, part(spark, (b, 10)))
    switch = PartLog._switch

    def dies(self, entries):
        raise KeyboardInterrupt
    monkeypatch.setattr(PartLog, "_switch", dies)
    with pytest.raises(KeyboardInterrupt):                    # the batch's folder is there, its manifest is not
        log.add(2, part(spark, (2, 10)))
    assert total(PartLog(spark, root, "k long, n long", sums, fanout=3)) == {0: 10, 1: 10}
    calls = []

    def dies_merging(self, entries):
        calls.append(1)
        if len(calls) == 2:                                   # the merged folder is there, its manifest is not
            raise KeyboardInterrupt
        switch(self, entries)
    monkeypatch.setattr(PartLog, "_switch", dies_merging)
    with pytest.raises(KeyboardInterrupt):
        log.add(2, part(spark, (2, 10)))
    monkeypatch.setattr(PartLog, "_switch", switch)
    after = PartLog(spark, root, "k long, n long", sums, fanout=3)
    assert total(after) == {0: 10, 1: 10, 2: 10} and len(after.entries()) == 3
    after.add(2, part(spark, (2, 10)))                        # Spark replays the batch
    after.add(3, part(spark, (3, 10)))
    assert total(after) == {0: 10, 1: 10, 2: 10, 3: 10} and len(after.entries()) == 2


def test_dense_ids_are_the_same_when_read_again(spark, tmp_path):
    claims = IdClaims(spark, f"file://{tmp_path}/ids")
    rows = spark.range(1000).selectExpr("id AS x").repartition(7)
    first = with_dense_ids(rows, claims)
    got = {r.x: r.id for r in first.collect()}
    assert sorted(got.values()) == list(range(1, 1001)) and {r.x: r.id for r in first.collect()} == got
    mixed = spark.createDataFrame([(5000, 1), (None, 2), (None, 3)], "id long, x long")
    assert sorted(r.id for r in with_dense_ids(mixed, claims).collect()) == [5000, 5001, 5002]
    assert with_dense_ids(rows.limit(0), claims).count() == 0


def test_claims_at_once_never_overlap(spark, tmp_path):
    starts, lock = [], threading.Lock()

    def work():
        mine = IdClaims(spark, f"file://{tmp_path}/ids")
        for n in (3, 5, 2):
            start = mine.claim(n)
            with lock:
                starts.append((start, start + n))
    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    starts.sort()
    assert starts[0][0] == 1 and all(a[1] == b[0] for a, b in zip(starts, starts[1:])) and starts[-1][1] == 41
    claims = IdClaims(spark, f"file://{tmp_path}/ids")
    assert claims.claim(4, "batch 9") == 41 and claims.claim(1) == 45 and claims.claim(4, "batch 9") == 41
    with pytest.raises(RuntimeError):
        claims.claim(5, "batch 9")


def test_append_log_gives_ids_after_those_of_an_older_table(spark, tmp_path):
    from conftest import log_rows
    from test_stats import GOLDEN
    root = f"file://{tmp_path}/store"
    log = log_rows(spark, GOLDEN)
    logstore.append_log(log, root)                            # ids 1, 2, 3 come with the rows
    for _ in range(2):
        logstore.append_log(log.drop("id"), root)
    assert sorted(r.id for r in logstore.read_log(spark, root).collect()) == list(range(1, 10))


def test_a_stream_that_ended_is_corrected_by_later_lines(spark, tmp_path):
    src, sink = f"{tmp_path}/src", f"{tmp_path}/sink"
    schema = spark.createDataFrame([], LINES).schema
    everything = []

    def batch(*rows):
        rows = [(q, "chat", n, T0, x) for q, n, x in rows]
        everything.extend(rows)
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(src)
        done, texts = jobs.live_finished(spark, src, sink, schema, max_files=1, fanout=2, part_lines=2)
        text = {}
        for r in texts.orderBy("request_id", "part").collect():
            text[r.request_id] = text.get(r.request_id, "") + r.text
        return {r.request_id: (text.get(r.request_id, ""), r.text_tokens, r.revision) for r in done.collect()}
    assert batch((1, 9, "data: [DONE]"), (2, 1, PIECE % "open")) == {1: ("", 0, 0)}
    assert batch((1, 2, PIECE % "cd"), (2, 2, PIECE % " too")) == {1: ("cd", 1, 1)}
    assert batch((1, 1, PIECE % "ab"), (2, 3, "data: [DONE]")) == {1: ("abcd", 1, 2), 2: ("open too", 2, 2)}
    assert batch((3, 1, PIECE % "x")) == {1: ("abcd", 1, 2), 2: ("open too", 2, 2)}
    assert batch((1, 1, PIECE % "ab")) == {1: ("abcd", 1, 4), 2: ("open too", 2, 2)}       # a line that comes again
    whole = {r.request_id: r.text_tokens for r in sse.fold(spark.createDataFrame(everything, LINES)).filter("saw_end").collect()}
    assert whole == {1: 1, 2: 2}


def test_system_log_stream_keeps_every_line_once(spark, tmp_path, monkeypatch):
    src, sink = f"{tmp_path}/src", f"{tmp_path}/sink"
    good = '{"timestamp": %d, "level": "INFO", "name": "n", "message": "m%d"}'

    def arrive(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)

    def run():
        records, bad = jobs.ingest_system_log_stream(spark, src, sink, max_files=1)
        return sorted((r.id, r.message) for r in records.collect()), sorted(r.value for r in bad.collect())
    arrive(good % (1, 1), "no record", good % (2, 2), "  ")
    assert run() == ([(1, "m1"), (2, "m2")], ["no record"])
    arrive(good % (3, 3), '{"timestamp": 4, "name": "n", "message": "lost"}')
    add = PartLog.add

    def dies(self, batch_id, rows):
        if "quarantine" in self.root:
            raise RuntimeError("killed between the two sinks")
        add(self, batch_id, rows)
    monkeypatch.setattr(PartLog, "add", dies)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(PartLog, "add", add)
    want = [(1, "m1"), (2, "m2"), (3, "m3")], ["no record", '{"timestamp": 4, "name": "n", "message": "lost"}']
    assert run() == (want[0], sorted(want[1]))
    assert run() == (want[0], sorted(want[1]))
