"""Joins that spread heavy keys give what a plain join gives, and leave no task with a key's rows."""

import time

import pytest
from pyspark.sql import functions as F

from inference_ledger.operators.heavy import HEAVY, heavy_join, heavy_keys, light_salt
from inference_ledger.session import drop_finished_shuffles


@pytest.fixture(scope="module")
def rows(spark):
    # half of all rows on key 0, a tenth without a key, the rest over 400 keys; 7 is heavy but not in the table
    return spark.range(20_000).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 0L WHEN id % 10 = 1 THEN NULL WHEN id % 10 = 3 THEN 7L ELSE id % 400 END AS k")


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(200).filter("id <> 7").selectExpr("id AS k", "id * 3 AS v", "CAST(NULL AS STRING) AS w")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hint", [None, "shuffle_hash"])
def test_equals_a_plain_join(rows, table, how, hint):
    counts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counts, 20_000)
    assert 2 <= heavy.count() <= HEAVY
    got = heavy_join(rows, table, ["k"], heavy, ["id"], how, hint)
    want = rows.join(table, "k", how).select("id", "k", "v", "w")
    assert got.columns == want.columns
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)


def test_no_heavy_keys_and_empty_sides(spark, rows, table):
    none = heavy_keys(spark.createDataFrame([], "k long, n long"), 0)
    assert heavy_join(rows, table, ["k"], none, ["id"]).count() == rows.join(table, "k").count()
    assert heavy_join(rows.limit(0), table, ["k"], none, ["id"], "left").count() == 0
    assert heavy_join(rows, table.limit(0), ["k"], none, ["id"], "left").count() == 20_000


def test_rows_of_a_heavy_key_are_dealt(spark, rows, table):
    heavy = heavy_keys(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k IS NOT NULL"), 20_000)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = heavy_join(rows, table, ["k"], heavy, ["id"], "left", "shuffle_hash")
        dealt = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert max(dealt) < 2 * sorted(dealt)[len(dealt) // 2]


def test_table_is_cut_to_heavy_keys_after_it_is_made(rows):
    """The heavy keys' rows are taken from the table, at most HEAVY of them, not from all rows that it is counted from."""
    counts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    out = heavy_join(rows, counts, ["k"], heavy_keys(counts, 20_000), ["id"])
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = rows.join(counts, "k").select("id", "k", "n")
    assert sorted(out.collect()) == sorted(want.collect())


def test_salt_of_light_keys_is_narrow(rows):
    assert rows.select(light_salt(["k"]).alias("s")).distinct().count() == 2


def test_shuffle_files_of_finished_queries_go(spark, rows):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    rows.repartition(5, "id").write.format("noop").mode("overwrite").save()
    mine = files() - before
    assert mine
    drop_finished_shuffles(spark)
    for _ in range(100):
        if not mine & files():
            break
        time.sleep(0.2)
    assert not mine & files()
