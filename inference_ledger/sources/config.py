"""Routing configuration -> dimension DataFrames.

A configuration is a mapping with ``backends`` (id, url, context_size?,
api_key?) and ``model_mappings`` (model_id, backend_ids), both required, plus
optional ``default_model_id``, ``default_embedding_model_id`` and
``untracked_models``. It is read once on the driver (it is a small file) and
turned into dimension tables; credentials are dropped on load.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BACKENDS, MODEL_MAPPINGS, UNTRACKED

# fixed values: the demo routing configuration used by the routing queries.
# b1 has a trailing slash, b3 a /v1 suffix; chat-medium is mapped twice (the
# first mapping wins); orphan-model points at a backend that does not exist.
DEMO_CONFIG: dict[str, Any] = {
    "backends": [
        {"id": "b1", "url": "http://h1:8080/", "context_size": 64},
        {"id": "b2", "url": "http://h2:8080", "context_size": 100},
        {"id": "b3", "url": "http://h3:8080/v1"},
        {"id": "b4", "url": "http://h4:8080", "context_size": 50, "api_key": "secret"},
    ],
    "model_mappings": [
        {"model_id": "chat-large", "backend_ids": ["b1", "b2"]},
        {"model_id": "chat-medium", "backend_ids": ["b1"]},
        {"model_id": "chat-small", "backend_ids": ["b2", "b3"]},
        {"model_id": "embed-text", "backend_ids": ["b4"]},
        {"model_id": "orphan-model", "backend_ids": ["missing"]},
        {"model_id": "chat-medium", "backend_ids": ["b3"]},
    ],
    "default_model_id": "chat-large",
    "default_embedding_model_id": None,
    "untracked_models": ["orphan-model", "unmapped-model"],
}


class ConfigError(ValueError):
    pass


def load_config(source: str | Path | dict) -> dict[str, Any]:
    """Parse and validate a configuration (dict, or a JSON/YAML file)."""
    if isinstance(source, dict):
        data = source
    else:
        path = Path(source)
        if not path.exists():
            raise FileNotFoundError(f"Configuration file not found: {path}")
        text = path.read_text()
        if path.suffix in (".yaml", ".yml"):
            try:
                import yaml  # optional
            except ImportError as e:  # pragma: no cover
                raise ConfigError("YAML configuration needs PyYAML; use JSON") from e
            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
    if not isinstance(data, dict):
        raise ConfigError("configuration must be a mapping")
    for key in ("backends", "model_mappings"):
        if key not in data or not isinstance(data[key], list):
            raise ConfigError(f"missing required field {key!r}")
    for b in data["backends"]:
        if not isinstance(b, dict) or not isinstance(b.get("id"), str) or not isinstance(b.get("url"), str):
            raise ConfigError(f"backend record lacks id/url: {b!r}")
        cs = b.get("context_size")
        if cs is not None and not isinstance(cs, int):
            raise ConfigError(f"context_size must be an integer: {b!r}")
    for m in data["model_mappings"]:
        if (not isinstance(m, dict) or not isinstance(m.get("model_id"), str)
                or not isinstance(m.get("backend_ids"), list)):
            raise ConfigError(f"model mapping lacks model_id/backend_ids: {m!r}")
    return data


def _local(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A small dimension as literal rows (``inline`` of an array of structs):
    its row count is a literal in the plan, so size-checked broadcasts can
    trust it whatever the session's Arrow setting (a plain
    ``createDataFrame(list)`` is an RDD scan of unknown size)."""
    from ..functions.sqltext import rows_relation
    return rows_relation(spark, rows, schema)


def backends_df(spark: SparkSession, cfg: dict) -> DataFrame:
    cfg = load_config(cfg)
    rows = [(i, b["id"], b["url"], b.get("context_size")) for i, b in enumerate(cfg["backends"])]
    return _local(spark, rows, BACKENDS)


def mappings_df(spark: SparkSession, cfg: dict) -> DataFrame:
    cfg = load_config(cfg)
    rows = [(i, m["model_id"], list(m["backend_ids"])) for i, m in enumerate(cfg["model_mappings"])]
    return _local(spark, rows, MODEL_MAPPINGS)


def untracked_df(spark: SparkSession, cfg: dict) -> DataFrame:
    cfg = load_config(cfg)
    return _local(spark, [(m,) for m in (cfg.get("untracked_models") or [])], UNTRACKED)


#: a catalogue too large for one document: JSON lines, each a backend or a mapping with its position
RECORD = "kind string, pos bigint, id string, url string, context_size variant, model_id string, backend_ids variant"


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S7 for a large catalogue: (backends, mappings, rejected lines) of a folder of JSON lines, in the
    ``BACKENDS`` and ``MODEL_MAPPINGS`` schemas. The rules of ``load_config`` hold per record: a position, a
    backend's id and url, an integer context size or none, a mapping's model id and a list of backend ids.
    Rejected lines keep their text and the reason; credentials are never read."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(
        "value", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r")).select("value", "r.*")
    size, ids = "coalesce(schema_of_variant(context_size), 'VOID')", "coalesce(schema_of_variant(backend_ids), 'VOID')"
    rows = rows.withColumn("reason", F.expr(f"""CASE
        WHEN kind IS NULL OR kind NOT IN ('backend', 'mapping') OR pos IS NULL THEN 'no record'
        WHEN kind = 'backend' AND (id IS NULL OR url IS NULL) THEN 'id or url missing'
        WHEN kind = 'backend' AND {size} NOT IN ('VOID', 'BIGINT') THEN 'context size no integer'
        WHEN kind = 'mapping' AND model_id IS NULL THEN 'model id missing'
        WHEN kind = 'mapping' AND {ids} NOT IN ('ARRAY<STRING>', 'ARRAY<VOID>') THEN 'backend ids no list' END"""))
    good = F.col("reason").isNull()
    backends = rows.filter(good & (F.col("kind") == "backend")).selectExpr(
        "pos", "id", "url", "try_variant_get(context_size, '$', 'int') AS context_size")
    mappings = rows.filter(good & (F.col("kind") == "mapping")).selectExpr(
        "pos", "model_id", "variant_get(backend_ids, '$', 'array<string>') AS backend_ids")
    return backends, mappings, rows.filter(~good).select("value", "reason")
