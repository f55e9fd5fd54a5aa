"""Registered queries of this subpackage: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import (archives, decontaminate, divergence, extract, language, licences, near_dedup, neighbours, packing,
               prefix_bpe, repair, repeats, token_files)
from .encode import public_tokenizer
from .oracle import ORACLE_SQL  # noqa: F401  (read by the entry module)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that tasks can
    import it wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="ledger-package-")) / "ledger_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licences(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("places")


def op2_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op3_archives(spark, sf_dir):
    return archives.archive_digest(spark, table(spark, sf_dir, "pages"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "distance")


def op5_extract(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return token_files.token_digest(spark, table(spark, sf_dir, "documents"),
                                    public_tokenizer("byte_bpe_50k.json"), end_id=2)


def op8_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op9_repeats(spark, sf_dir):
    return repeats.repeat_digest(spark, table(spark, sf_dir, "documents"))


def op10_pack(spark, sf_dir):
    return packing.pack_digest(packing.pack_documents(
        spark, table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1))


def op11_repair(spark, sf_dir):
    return repair.repair(spark, repair.damage(table(spark, sf_dir, "conversations")))


def op12_divergence(spark, sf_dir):
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_bpe(spark, sf_dir):
    return prefix_bpe.encoding_digest(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licences, op2_language, op3_archives, op4_decontaminate, op5_extract, op6_near_dedup, op7_token_files, op8_neighbours, op9_repeats, op10_pack,
                              op11_repair, op12_divergence, op13_bpe)
}
