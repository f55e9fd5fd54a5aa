"""Usage normalisation across API dialects: P8-P12 (+ T4, T6).

Works on a VARIANT holding the usage object so that key *presence* can be told
apart from an explicit JSON null: ``variant_get(u, path, 'variant') IS NULL``
is true only for a missing path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vget(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def has(v: Column, path: str) -> Column:
    return vget(v, path).isNotNull()


def as_int(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def whole(v: Column, path: str) -> Column:
    """The integer at ``path``: an integral number or a text of digits, else NULL (5.5 is no integer)."""
    i, d = as_int(v, path), F.try_variant_get(v, path, "double")
    return F.when(d.isNull() | (d == i.cast("double")), i)


def extras_valid(u: Column) -> Column:
    """The optional fields of a usage record: counters are integers or null, details are
    objects of integers (no nulls inside) or null."""
    def absent(path: str) -> Column:
        return vkind(vget(u, path)).isin("", "VOID")

    ok = F.lit(True)
    for name in ("cache_creation_input_tokens", "cache_read_input_tokens"):
        ok = ok & (absent(f"$.{name}") | whole(u, f"$.{name}").isNotNull())
    for name in ("prompt_tokens_details", "completion_tokens_details"):
        inside = F.map_values(F.try_variant_get(u, f"$.{name}", "map<string,variant>"))
        ok = ok & (absent(f"$.{name}") | F.coalesce(F.forall(inside, lambda x: whole(x, "$").isNotNull()), F.lit(False)))
    return ok


def vkind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def truthy_object(u: Column) -> Column:
    """An object with at least one key (``{}`` and NULL are absent)."""
    k = vkind(u)
    return k.startswith("OBJECT") & (k != "OBJECT<>")


def truthy(u: Column) -> Column:
    """Python truthiness of a JSON value: absent/null/false/0/""/[]/{} are falsy."""
    k = vkind(u)
    s = F.try_variant_get(u, "$", "string")
    d = F.try_variant_get(u, "$", "double")
    return (F.when(k.isin("", "VOID", "OBJECT<>"), F.lit(False))
            .when(k.startswith("OBJECT"), F.lit(True))
            .when(k.startswith("ARRAY"), s != "[]")
            .when(k == "STRING", s != "")
            .when(k == "BOOLEAN", s == "true")
            .otherwise(F.coalesce(d, F.lit(0.0)) != 0.0))


def usage_fields(u: Column, fallback_prompt: Column) -> dict[str, Column]:
    """prompt = prompt_tokens, else input_tokens, else the fallback;
    completion = completion_tokens, else output_tokens, else 0; total = given,
    else prompt + completion. Presence decides, not value (T4): an explicit
    null makes the record invalid rather than falling through. Cached-token
    details (P12) and the two cache counters are carried; the responses
    dialect's ``input_tokens_details`` is not read (T5)."""
    p_has, i_has = has(u, "$.prompt_tokens"), has(u, "$.input_tokens")
    c_has, o_has = has(u, "$.completion_tokens"), has(u, "$.output_tokens")
    t_has = has(u, "$.total_tokens")
    prompt = (F.when(p_has, whole(u, "$.prompt_tokens"))
              .when(i_has, whole(u, "$.input_tokens")).otherwise(fallback_prompt.cast("bigint")))
    completion = (F.when(c_has, whole(u, "$.completion_tokens"))
                  .when(o_has, whole(u, "$.output_tokens")).otherwise(F.lit(0).cast("bigint")))
    total = F.when(t_has, whole(u, "$.total_tokens")).otherwise(prompt + completion)
    valid = prompt.isNotNull() & completion.isNotNull() & total.isNotNull() & extras_valid(u)
    return {
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "total_tokens": total,
        "prompt_cached_tokens": as_int(u, "$.prompt_tokens_details.cached_tokens"),
        "cache_creation_input_tokens": as_int(u, "$.cache_creation_input_tokens"),
        "cache_read_input_tokens": as_int(u, "$.cache_read_input_tokens"),
        "usage_valid": valid,
    }


def openai_usage(data: Column, estimate: Column) -> dict[str, Column]:
    """P10: a truthy ``usage`` object is normalised; otherwise (estimate, 0, estimate)."""
    u = vget(data, "$.usage")
    f = usage_fields(u, estimate)
    present = truthy_object(u)
    non_object = truthy(u) & ~present   # e.g. "usage": 5 -> the reference raises
    est = estimate.cast("bigint")
    out = {
        "prompt_tokens": F.when(present, f["prompt_tokens"]).otherwise(est),
        "completion_tokens": F.when(present, f["completion_tokens"]).otherwise(F.lit(0).cast("bigint")),
        "total_tokens": F.when(present, f["total_tokens"]).otherwise(est),
        "prompt_cached_tokens": F.when(present, f["prompt_cached_tokens"]),
        "cache_creation_input_tokens": F.when(present, f["cache_creation_input_tokens"]),
        "cache_read_input_tokens": F.when(present, f["cache_read_input_tokens"]),
        "usage_valid": F.when(present, f["usage_valid"]).otherwise(~non_object),
    }
    return out


def native_embed_usage(data: Column) -> dict[str, Column]:
    """``prompt_eval_count`` (missing, null or 0 -> 0); completion 0."""
    pt = F.coalesce(as_int(data, "$.prompt_eval_count"), F.lit(0).cast("bigint"))
    return {
        "prompt_tokens": pt, "completion_tokens": F.lit(0).cast("bigint"), "total_tokens": pt,
        "prompt_cached_tokens": F.lit(None).cast("bigint"),
        "cache_creation_input_tokens": F.lit(None).cast("bigint"),
        "cache_read_input_tokens": F.lit(None).cast("bigint"),
        "usage_valid": F.lit(True),
    }


def timings(data: Column) -> tuple[Column, Column]:
    """``timings.prompt_ms`` -> ttft, ``timings.predicted_per_second`` -> speed."""
    return (F.try_variant_get(data, "$.timings.prompt_ms", "double"),
            F.try_variant_get(data, "$.timings.predicted_per_second", "double"))


def timings_fail(data: Column) -> Column:
    """``timings`` that is there but no object (null, too) is an internal failure."""
    return has(data, "$.timings") & ~vkind(vget(data, "$.timings")).startswith("OBJECT")
