"""The streams' source files follow the cores, so that every batch is read by all of them."""

import tempfile

from inference_ledger.plans import q_streaming as q


def test_a_batch_has_a_file_for_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    src = tempfile.mkdtemp(prefix="ledger-files-") + "/src"
    seen = []
    q._twice(spark.range(5000).toDF("id"), src, lambda: seen.append(len(spark.read.parquet(src).inputFiles())))
    assert q.per_batch(spark) >= cores
    assert seen == [q.files_of(spark), 2 * q.files_of(spark)] and seen[0] == 2 * q.per_batch(spark)
    assert spark.read.parquet(src).distinct().count() == 5000


def test_files_of_a_wave(spark):
    cores = spark.sparkContext.defaultParallelism
    assert q.wave_files(spark, 0) == 1 and q.wave_files(spark, 10 ** 9) == cores
