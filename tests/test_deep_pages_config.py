"""Deep pages of a stored log, catalogue files, the second native embedding path."""

import datetime
import json
import random

from pyspark.sql import functions as F

from inference_ledger.operators import routing, views
from inference_ledger.schemas import LOG_WITH_DT
from inference_ledger.sources import config, logstore


def _log(spark, n=400):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        ts = None if k % 50 == 0 else 1704067200.0 + rng.randrange(9) * 86400 + rng.randrange(40) * 2000.0
        dt = None if ts is None else datetime.datetime.fromtimestamp(ts, datetime.timezone.utc).date()
        rows.append({"id": k, "timestamp": ts, "dt": dt, "model_id": f"m{k % 3}"})
    return spark.createDataFrame([tuple(r.get(f.name) for f in LOG_WITH_DT.fields) for r in rows],
                                 "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in LOG_WITH_DT.fields) + ">")


def test_deep_pages_equal_plain_pages(spark, tmp_path):
    path = str(tmp_path / "log")
    _log(spark).write.partitionBy("dt").parquet(path)
    log = spark.read.schema(LOG_WITH_DT).parquet(path)
    counts = logstore.rows_per_date(log)
    assert sum(n for _, n in counts) == 400 and counts[-1][0] is None
    for limit, offset in [(10, 0), (10, 37), (50, 200), (25, 380), (10, 395), (10, 400), (0, 3), (-1, 150), (None, 0),
                          (400, 0), (7, -4)]:
        page = logstore.stored_page(log, limit, offset, counts)
        want = views.recent_logs(log, limit, offset)
        assert [r.id for r in page.collect()] == [r.id for r in want.collect()], (limit, offset)


def test_a_deep_page_opens_two_dates_at_most(spark, tmp_path):
    path = str(tmp_path / "log")
    _log(spark).write.partitionBy("dt").parquet(path)
    log = spark.read.schema(LOG_WITH_DT).parquet(path)
    page = logstore.stored_page(log, 10, 250)
    assert page.select("dt").distinct().count() <= 2
    dates = page._jdf.queryExecution().optimizedPlan().toString()
    assert "dt#" in dates
    read = [f for f in page.inputFiles()]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and read


def test_catalogue_records(spark, tmp_path):
    lines = [
        {"kind": "backend", "pos": 1, "id": "a", "url": "http://a", "context_size": 5, "api_key": "k"},
        {"kind": "backend", "pos": 2, "id": "b", "url": "http://b", "context_size": None},
        {"kind": "backend", "pos": 3, "id": "c", "url": "http://c", "context_size": "9"},
        {"kind": "backend", "pos": 4, "id": "d"},
        {"kind": "mapping", "pos": 5, "model_id": "m", "backend_ids": ["a", "zz"]},
        {"kind": "mapping", "pos": 6, "model_id": "n", "backend_ids": []},
        {"kind": "mapping", "pos": 7, "model_id": "o", "backend_ids": "a"},
        {"kind": "mapping", "pos": 8, "backend_ids": ["a"]},
        {"kind": "mapping", "model_id": "p", "backend_ids": ["a"]},
        {"kind": "other", "pos": 9}]
    path = tmp_path / "lines.json"
    path.write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    b, m, bad = config.read_records(spark, str(path))
    assert sorted(map(tuple, b.collect())) == [(1, "a", "http://a", 5), (2, "b", "http://b", None)]
    assert sorted(map(tuple, m.collect())) == [(5, "m", ["a", "zz"]), (6, "n", [])]
    assert sorted(r.reason for r in bad.collect()) == sorted([
        "context size no integer", "id or url missing", "backend ids no list", "model id missing",
        "no record", "no record", "no record"])
    assert "api_key" not in b.columns
    assert [r.id for r in routing.model_list(m, routing.backend_limits(b)).collect()] == ["m", "n"]


def test_native_embedding_paths(spark):
    cfg = {"backends": [{"id": "e", "url": "http://e:1/", "context_size": 1}],
           "model_mappings": [{"model_id": "v", "backend_ids": ["e"]}]}
    req = spark.createDataFrame([(1, "embed_native", "v", 9), (2, "embeddings_native", "v", 9), (3, "embeddings_native", "w", 9)],
                                "request_id long, protocol string, requested_model string, prompt_tokens long")
    r = routing.check_limit(routing.route(req, config.mappings_df(spark, cfg),
                                          routing.backend_limits(config.backends_df(spark, cfg)), None, "v"))
    got = {x.request_id: (x.target_url, x.limit_status, x.logged_model) for x in r.collect()}
    assert got == {1: ("http://e:1/api/embed", 200, "v"), 2: ("http://e:1/api/embeddings", 200, "v"),
                   3: ("http://e:1/api/embeddings", 200, "v")}


def test_lookup_of_literal_dims_writes_nothing(spark, tmp_path, monkeypatch):
    def never(*a, **k):
        raise AssertionError("literal dimensions are not written")
    monkeypatch.setattr(routing, "measured_broadcast", never)
    limits = routing.backend_limits(config.backends_df(spark, config.DEMO_CONFIG))
    req = spark.createDataFrame([(1, "chat", "chat-large")], "request_id long, protocol string, requested_model string")
    out = routing.route(req, config.mappings_df(spark, config.DEMO_CONFIG), limits, None, None)
    assert out.select(F.col("backend_id").isNotNull()).first()[0]
