"""A log of batch parts that stays short: levels, merged, behind a manifest.

Every micro-batch adds one folder of parts (counts, sums, folds: rows that a ``merge`` function can add
up). Readers see the folders that the newest manifest names. When a level has ``fanout`` folders they are
merged into one of the next level, so that n batches leave at most ``(fanout - 1) * levels`` folders, with
levels = log n to the base fanout, and each row is written once a level.

A manifest is a small text file, written beside its place and renamed to it; it is complete or absent. A
job that dies after writing a folder and before its manifest leaves a folder that nobody reads; the next start writes
it again or merges again under a new name. A batch that is replayed after its manifest was written
changes nothing. Folders that neither the newest nor the manifest before it names are removed, so that a
reader that has just listed the older one can finish.

One job writes a log at a time (Spark allows one query per checkpoint); readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8
END = "end of manifest"      # last line of a complete manifest


class PartLog:
    """``root`` holds the folders and, in ``_manifest``, the manifests."""

    def __init__(self, spark: SparkSession, root: str, schema, merge: Callable[[DataFrame], DataFrame],
                 partition_by: list[str] | None = None, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.merge = spark, root.rstrip("/"), schema, merge
        self.partition_by, self.fanout = partition_by or [], fanout
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join(names))

    def _versions(self) -> list[int]:
        folder = self._path(self.root, "_manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> list[dict] | None:
        stream = self._fs.open(self._path(self.root, "_manifest", str(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        lines = text.split("\n")
        return [json.loads(x) for x in lines[:-1]] if lines[-1] == END else None

    def entries(self) -> list[dict]:
        """Live folders (name, level, first and last batch), oldest first; [] before the first batch."""
        for version in reversed(self._versions()):
            found = self._manifest(version)
            if found is not None:
                return found
        return []

    def _switch(self, entries: list[dict]) -> None:
        """The next manifest; what the last two do not name is removed."""
        versions = self._versions()
        before = self.entries()
        version = (versions[-1] if versions else 0) + 1
        beside = self._path(self.root, "_manifest", f"_{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray("\n".join([*(json.dumps(e, sort_keys=True) for e in entries), END]).encode()))
        out.close()
        if not self._fs.rename(beside, self._path(self.root, "_manifest", str(version))):
            raise RuntimeError(f"another job writes {self.root}")
        live = {e["name"] for e in [*before, *entries]}
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name.startswith("part-") and name not in live:
                self._fs.delete(f.getPath(), True)
        for old in versions[:-1]:
            self._fs.delete(self._path(self.root, "_manifest", str(old)), False)

    # ------------------------------------------------------------ batches

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.write.mode("overwrite").partitionBy(*self.partition_by) if self.partition_by
         else rows.write.mode("overwrite")).parquet(f"{self.root}/{name}")

    def has(self, batch_id: int) -> bool:
        return any(e["first"] <= batch_id <= e["last"] for e in self.entries())

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """The parts of a batch; a batch that is known already changes nothing."""
        if self.has(batch_id):
            return
        name = f"part-0-{batch_id}-{uuid.uuid4().hex[:8]}"
        self._write(rows, name)
        self._switch([*self.entries(), {"name": name, "level": 0, "first": batch_id, "last": batch_id}])
        self.compact()

    def compact(self) -> None:
        """Merge every level that is full, from the lowest up."""
        while True:
            entries = self.entries()
            levels = [e["level"] for e in entries]
            full = next((k for k in sorted(set(levels)) if levels.count(k) >= self.fanout), None)
            if full is None:
                return
            some = [e for e in entries if e["level"] == full][:self.fanout]
            name = f"part-{full + 1}-{some[0]['first']}-{uuid.uuid4().hex[:8]}"
            self._write(self.merge(self._load(some)), name)
            merged = {"name": name, "level": full + 1, "first": some[0]["first"], "last": some[-1]["last"]}
            self._switch(sorted([merged, *(e for e in entries if e not in some)], key=lambda e: e["first"]))

    def _load(self, entries: list[dict]) -> DataFrame:
        """Rows of some folders. One scan a folder, so that each folder's own partitions are read as such."""
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        if not self.partition_by:
            return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{e['name']}" for e in entries])
        out = None
        for e in entries:
            one = self.spark.read.schema(self.schema).parquet(f"{self.root}/{e['name']}")
            out = one if out is None else out.unionByName(one)
        return out

    def read(self) -> DataFrame:
        """All parts, as they are (``merge`` adds them up)."""
        return self._load(self.entries())
