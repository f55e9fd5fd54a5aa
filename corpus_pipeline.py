"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are applied in order; each stage's result is written as Parquet in the
shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inference_ledger.llm import decontaminate, language, near_dedup, packing, repeats
from inference_ledger.llm.encode import public_tokenizer
from inference_ledger.llm.queries import table
from inference_ledger.session import scratch_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a language (no text, no letter) go."""
    return language.known_language(docs)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near copies, the document with the smallest doc_id stays."""
    return near_dedup.one_per_group(spark, docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of 200 bytes that stand anywhere else are cut out of the texts."""
    return repeats.without_repeats(spark, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: what is left, as pieces of sequences of 2048 ids."""
    return packing.pack_digest(packing.pack_documents(
        spark, docs, public_tokenizer("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("language identification", known_language),
    ("near-duplicate removal", near_deduplicated),
    ("repeated-substring removal", repeats_removed),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Language identification, packing and the tokenizers have no SQL form; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        folder = scratch_path(spark, f"pipeline-{k}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
