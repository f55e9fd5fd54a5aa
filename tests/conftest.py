import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from inference_ledger.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app_name="ledger-tests")
    yield s
    s.stop()


def log_rows(spark, rows):
    """Build a request log from dicts (missing keys are NULL)."""
    from inference_ledger.schemas import LOG
    from inference_ledger.functions.timefmt import epoch_date
    from pyspark.sql import functions as F
    full = []
    for i, r in enumerate(rows):
        d = {f.name: None for f in LOG.fields}
        d.update({"id": i + 1, "timestamp": 1_700_000_000.0 + i, "backend_url": "http://b"})
        d.update(r)
        full.append(tuple(d[f.name] for f in LOG.fields))
    df = spark.createDataFrame(full, LOG)
    return df.withColumn("dt", epoch_date(F.col("timestamp")))
