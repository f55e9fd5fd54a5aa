"""Plan properties that matter at scale."""

from pyspark.sql import functions as F

from inference_ledger.operators import routing, stats
from inference_ledger.plans.registry import all_queries
from inference_ledger.session import checked_broadcast, is_small
from inference_ledger.sources import config, derive

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    p = _plan(stats.totals(derive.request_log(spark, SF)))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double,props:string>" in p or \
        "user_id" not in p.split("ReadSchema")[1].split("\n")[0]


def test_stored_log_prunes_partitions(spark, tmp_path):
    from inference_ledger.sources import logstore
    root = str(tmp_path)
    logstore.append_log(derive.request_log(spark, SF), root)
    df = stats.totals(logstore.read_log(spark, root), 24, 1706659200.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan


def test_no_python_in_native_queries(spark):
    qs = all_queries()
    for name in ("totals_all", "model_rollup", "series_hour", "route_requests", "limit_check", "sse_chat",
                 "usage_chat", "log_build", "token_estimate", "model_browser"):
        p = _plan(qs[name](spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_broadcast_is_size_checked(spark):
    from inference_ledger.functions.sqltext import rows_relation
    from inference_ledger.session import literal_bytes, measured_broadcast
    schema = config.backends_df(spark, config.DEMO_CONFIG).schema
    def backends(n):
        return rows_relation(spark, [(i, f"b{i}", f"http://b{i}", 4096) for i in range(n)], schema)
    sizes = [literal_bytes(backends(n)) for n in (0, 6, 50, 2000)]
    assert sizes == sorted(sizes) and sizes[3] > 300 * sizes[1]
    assert is_small(backends(6)) and not is_small(backends(2000), sizes[2])
    small = rows_relation(spark, [(i,) for i in range(10)], spark.range(1).schema)
    # what an explode or a range makes is never believed
    exploded = small.select(F.explode(F.sequence(F.lit(0), F.lit(10**6))).alias("id"))
    for df in (exploded, spark.range(10_000_000)):
        assert not is_small(df) and "ResolvedHint" not in checked_broadcast(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in measured_broadcast(spark.range(6))._jdf.queryExecution().analyzed().toString()
    large = measured_broadcast(spark.range(100_000))
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString() and large.count() == 100_000
    j = spark.range(5).join(checked_broadcast(small), "id")
    assert "BroadcastHashJoin" in _plan(j) or "BroadcastExchange" in _plan(j)


def test_routing_joins_are_broadcast(spark):
    req = spark.createDataFrame([(1, "chat", "chat-large")], "request_id long, protocol string, requested_model string")
    limits = routing.backend_limits(config.backends_df(spark, config.DEMO_CONFIG))
    r = routing.route(req, config.mappings_df(spark, config.DEMO_CONFIG), limits, "chat-large", None)
    assert "BroadcastHashJoin" in _plan(r)


def test_sse_fold_no_python_and_two_phase(spark):
    p = _plan(all_queries()["sse_chat"](spark, SF))
    assert p.count("HashAggregate") + p.count("ObjectHashAggregate") + p.count("SortAggregate") >= 4
    _ = F


def test_spread_only_when_splits_are_few(spark):
    from inference_ledger.session import spread
    many = spark.range(0, 1000, numPartitions=64)
    assert spread(many) is many                                   # enough splits: untouched, no shuffle
    few = spark.range(0, 1000, numPartitions=1)
    spread_few = spread(few, key="id")
    assert spread_few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_checkpoint_dir_comes_from_the_session(spark):
    from inference_ledger.session import checkpoint_dir, scratch_path
    root = checkpoint_dir(spark)
    assert root and root == spark.sparkContext.getCheckpointDir().rstrip("/")
    assert scratch_path(spark, "x").startswith(root + "/x-")


def test_time_bounds_reach_the_scan(spark, tmp_path):
    assert "GreaterThanOrEqual(ts" in _plan(all_queries()["totals_day"](spark, SF))
    from inference_ledger.operators import views
    from inference_ledger.sources import logstore
    logstore.append_log(derive.request_log(spark, SF), str(tmp_path))
    page = views.logs_before(logstore.read_log(spark, str(tmp_path)), 1706659200.0, 5, 10)
    assert "PartitionFilters: [isnotnull(dt" in _plan(page)


def test_ids_and_quarantine(spark, tmp_path):
    from inference_ledger.sources import logstore
    (tmp_path / "in.json").write_text(
        '{"timestamp":1.5,"level":"INFO","name":"a","message":"m"}\nnot json\n\n{"timestamp":2.5,"level":"INFO"}\n'
        '{"id":7,"timestamp":3.5,"level":"WARNING","name":"b","message":"n","traceback":"t"}\n')
    root = str(tmp_path / "store")
    logstore.create_tables(spark, root)
    for _ in range(2):
        logstore.ingest_system_log_json(spark, str(tmp_path / "in.json"), root)
    ids = [r.id for r in logstore.read_system_log(spark, root).collect()]
    assert len(ids) == 4 and None not in ids and len({i for i in ids if i != 7}) == 2
    assert logstore.read_quarantine(spark, root).count() == 4


def test_one_file_per_date(spark, tmp_path):
    from inference_ledger.sources import logstore
    logstore.append_log(derive.request_log(spark, SF).repartition(6), str(tmp_path))
    log = logstore.read_log(spark, str(tmp_path))
    assert len(log.inputFiles()) == log.select("dt").distinct().count()
