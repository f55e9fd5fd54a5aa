"""SQL literal text for building select lists (one parse on the driver
instead of one round trip per Column operator)."""

from __future__ import annotations

from pyspark.sql import types as T


def literal(v, dtype: T.DataType | None = None) -> str:
    """Spark SQL literal of a Python value, typed when ``dtype`` is given."""
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})" if dtype is not None else "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        elem = dtype.elementType if isinstance(dtype, T.ArrayType) else None
        inner = ", ".join(literal(x, elem) for x in v)
        arr = f"array({inner})"
        return f"CAST({arr} AS {dtype.simpleString()})" if dtype is not None else arr
    if isinstance(v, int) and dtype is not None:
        return f"CAST({v} AS {dtype.simpleString()})"
    return repr(v)


def case(key: str, mapping: dict, default=None) -> str:
    """``CASE WHEN key = k THEN v ... [ELSE default] END``."""
    arms = " ".join(f"WHEN {key} = {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    tail = f" ELSE {literal(default)}" if default is not None else ""
    return f"CASE {arms}{tail} END"


def rows_relation(spark, rows: list[tuple], schema: T.StructType):
    """Literal rows as a ``VALUES`` relation, whose rows the planner counts."""
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    if not rows:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
        return spark.sql(f"SELECT {nulls} WHERE false")
    values = ", ".join("(" + ", ".join(literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")" for r in rows)
    casts = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")
