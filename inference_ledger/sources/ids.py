"""Ids that a log gives itself: dense ranges, claimed once per append.

Rows without an id are staged with the number of their part and their place in it. The parts' counts are
summed up before them, so that a row's id is a claimed start plus the rows of earlier parts plus its place: three
stored numbers, the same whenever a task runs again. No row moves and nothing is sorted.

A claim is a file ``<k>`` (``start end owner``) beside the table; the next one is written aside and renamed to
``<k + 1>``, which fails if another append was faster, and is then tried again. This asks for a
file system whose rename does not overwrite. An owner (a streaming batch) that comes again gets its range back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


class IdClaims:
    """Claims in ``folder``; ids begin with 1, or after ``taken()`` when nothing has been claimed yet."""

    def __init__(self, spark: SparkSession, folder: str, taken=None):
        self.folder, self.taken = folder.rstrip("/"), taken
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path("")
        self._fs = path.getFileSystem(self._conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(path).toUri(), self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _read(self, k: int) -> tuple[int, int, str]:
        stream = self._fs.open(self._path(str(k)))
        try:
            start, end, owner = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split(" ", 2)
        finally:
            stream.close()
        return int(start), int(end), owner

    def _known(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(int(n) for n in (f.getPath().getName() for f in self._fs.listStatus(self._path(""))) if n.isdigit())

    def claim(self, n: int, owner: str | None = None, at_least: int = 1) -> int:
        """First of ``n`` ids that nobody else gets, none below ``at_least``."""
        mine = owner or uuid.uuid4().hex
        none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            known = self._known()
            for k in reversed(known) if owner else ():
                start, end, by = self._read(k)
                if by == owner:
                    if end - start != n:
                        raise RuntimeError(f"{owner} came with {end - start} rows before, and with {n} now")
                    return start
            last = self._read(known[-1])[1] if known else (self.taken() if self.taken else 0) + 1
            start = max(last, at_least)
            beside = self._path(f"_{uuid.uuid4().hex}")
            out = self._fs.create(beside, False)
            out.write(bytearray(f"{start} {start + n} {mine}".encode()))
            out.close()
            try:
                self._files.rename(beside, self._path(str(known[-1] + 1 if known else 0)), none)
                return start
            except Exception as e:      # noqa: BLE001  (py4j wraps the JVM's exception)
                self._fs.delete(beside, False)
                if "FileAlreadyExists" not in str(e):
                    raise


def with_dense_ids(df: DataFrame, claims: IdClaims, owner: str | None = None) -> DataFrame:
    """``df`` with an ``id`` in every row: ids that are there stay, other rows get a dense range above
    all claimed and given ones."""
    spark = df.sparkSession
    given = None
    if "id" in df.columns:
        df = df.withColumn("id", F.col("id").cast("long"))
        given, df = df.filter("id IS NOT NULL"), df.filter("id IS NULL").drop("id")
    folder = scratch_path(spark, "rows-without-id")
    place = F.monotonically_increasing_id()      # part number and place, as Spark numbers them
    df.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")).write.parquet(folder)
    staged = spark.read.parquet(folder)
    counts = staged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = staged.count()
    highest = (given.agg(F.max("id")).first()[0] or 0) if given is not None else 0
    start = claims.claim(n, owner, highest + 1) if n or highest else 0
    fresh = staged.join(before, "_part").withColumn("id", F.lit(start) + F.col("_before") + F.col("_place")).drop(
        "_part", "_place", "_before")
    return fresh if given is None else given.unionByName(fresh)
