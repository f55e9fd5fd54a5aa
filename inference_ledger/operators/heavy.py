"""Joins to a table of one row per key whose cost does not depend on how often a key occurs.

Keys that hold at least one in ``HEAVY`` of all rows are few by arithmetic (their rows add up to no more
than the total, so there are ``HEAVY`` at most at every size of the input). Their rows of the table are broadcast and their own rows
spread over all tasks; every other key is hashed as in any join. No row is copied and none is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 1024


def heavy_keys(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """Keys of ``counts`` (one row per key, ``n`` rows each) that hold at least 1/HEAVY of ``total`` rows:
    at most HEAVY keys, given that all ``n`` add up to no more than ``total``."""
    return counts.filter(F.col(n) * HEAVY >= F.lit(total)).drop(n)


def light_salt(keys: list[str]) -> Column:
    """Salt of keys that are not dealt. It has two values, so that it adds next to nothing to what a join shuffles,
    and is no constant, which the optimizer would take out of the join's keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(2))


def heavy_join(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame, spread: list[str],
               how: str = "inner", hint: str | None = None) -> DataFrame:
    """``rows`` joined (inner or left) to ``table``, which has one row per key, by ``keys``.

    ``heavy`` are the keys from ``heavy_keys`` that occur often in ``rows``, whether or not ``table`` has them. Their rows, and rows
    with a null key, which match nothing, are dealt by the hash of the columns ``spread``. ``hint`` is for the
    join of the other keys. The columns of ``rows`` come first, then the other columns of ``table``."""
    values = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*values).alias("_light"))
    named = F.broadcast(heavy.select(*keys))
    # a semi join would be moved below the aggregate that makes ``table``, onto all rows it was made from
    hot = packed.join(named, keys).withColumnRenamed("_light", "_hot")
    known = heavy.select(*keys, F.lit(True).alias("_heavy")).join(F.broadcast(hot), keys, "left")
    own = light_salt(keys)
    light = packed.withColumn("_salt", own)
    unkeyed = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    out = (rows.join(F.broadcast(known), keys, "left")
           .withColumn("_salt", F.when(F.col("_heavy") | unkeyed, F.xxhash64(*spread)).otherwise(own))
           .join(light.hint(hint) if hint else light, [*keys, "_salt"], "left")
           .withColumn("_found", F.coalesce("_hot", "_light")))
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    return out.select(*rows.columns, *[F.col("_found").getField(v).alias(v) for v in values])
