"""Routing and catalog: J1-J7, F7, A6-A10, P19-P22, P28-P30, S8.

Dimensions (backends, model mappings) come from configuration and are joined
to the request stream with hash joins. Literal ones are broadcast behind their known size, the
table of available backends behind its measured size; a large derived catalog is joined by
shuffle, where adaptive execution splits a hot model id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NATIVE_PROTOCOLS
from ..session import BROADCAST_MAX_ROWS, checked_broadcast, is_small, measured_broadcast

EMBEDDING_PROTOCOLS = ("embeddings", *NATIVE_PROTOCOLS)

# fixed values: the request path per protocol, the limit-error types and the
# catalog's substitute context length
PATH_BY_PROTOCOL = {"chat": "/v1/chat/completions", "responses": "/v1/responses",
                    "messages": "/v1/messages", "embeddings": "/v1/embeddings",
                    "embed_native": "/api/embed", "embeddings_native": "/api/embeddings"}
LIMIT_ERROR_TYPE = "exceed_context_size_error"
LIMIT_ERROR_TYPE_MESSAGES = "invalid_request_error"
LIST_DEFAULT_CONTEXT = 4096
OWNER = "proxy"   # owner label of catalog entries (configurable per deployment)


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def target_url(url: Column, protocol: Column) -> Column:
    """Backend URL without trailing slashes + protocol path."""
    path = None
    for p, suffix in PATH_BY_PROTOCOL.items():
        path = F.when(protocol == p, F.lit(suffix)) if path is None else path.when(protocol == p, F.lit(suffix))
    return F.concat(strip_slashes(url), path)


def props_url(url: Column) -> Column:
    """P20: strip trailing slashes, then one ``/v1`` suffix, append ``/props``."""
    return F.concat(F.regexp_replace(strip_slashes(url), "/v1$", ""), F.lit("/props"))


def backend_limits(backends: DataFrame, props: DataFrame | None = None) -> DataFrame:
    """limit = configured context_size, else ``default_generation_settings.n_ctx``
    of the captured properties document for the backend's props URL, else NULL."""
    b = backends.withColumn("props_url", props_url(F.col("url")))
    if props is None:
        return b.select("pos", "id", "url", F.col("context_size").cast("bigint").alias("context_limit"))
    p = props.select(
        "props_url",
        F.try_variant_get(F.try_parse_json("json"), "$.default_generation_settings.n_ctx", "bigint").alias("n_ctx"))
    p = p.groupBy("props_url").agg(F.max("n_ctx").alias("n_ctx"))
    j = b.join(checked_broadcast(p), "props_url", "left")
    return j.select("pos", "id", "url",
                    F.coalesce(F.col("context_size").cast("bigint"), F.col("n_ctx")).alias("context_limit"))


def first_mappings(mappings: DataFrame) -> DataFrame:
    """One mapping per model id, the first in configuration order (one shuffle, no self-join)."""
    return mappings.groupBy("model_id").agg(F.min("pos").alias("map_pos"),
                                            F.min_by("backend_ids", "pos").alias("backend_ids"))


def first_positions(heads: DataFrame) -> DataFrame:
    """J1/A7 on mappings without their backends (pos, model_id): the mappings that win. A catalogue
    whose backends are rows of their own collects them for these only."""
    return heads.groupBy("model_id").agg(F.min("pos").alias("pos")).select("pos", "model_id")


def available_backends(mappings: DataFrame, limits: DataFrame) -> DataFrame:
    """Per first mapping, the configured backends it names, in *backend*
    configuration order (ids without a backend vanish). Columns: model_id,
    map_pos, backends ARRAY<STRUCT<pos,id,url,context_limit>>, max_limit (A6)."""
    fm = first_mappings(mappings)
    bridge = fm.select("model_id", F.explode(F.array_distinct("backend_ids")).alias("id"))
    joined = bridge.join(checked_broadcast(limits.select("pos", "id", "url", "context_limit")), "id", "inner")
    per_model = joined.groupBy("model_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "url", "context_limit"))).alias("backends"),
        F.max("context_limit").alias("max_limit"))
    return (fm.join(per_model, "model_id", "left")
              .select("model_id", "map_pos",
                      F.coalesce(F.col("backends"), F.array().cast(
                          "array<struct<pos:bigint,id:string,url:string,context_limit:bigint>>")).alias("backends"),
                      "max_limit"))


def _backend_lookup(mappings: DataFrame, limits: DataFrame) -> DataFrame:
    """``available_backends`` to be joined to requests. Literal dimensions are counted where they stand,
    without a job: a mapping's id can name as many backends as share it, which bounds the entries.
    Within the bound the lookup is broadcast as part of the query's own plan; other
    dimensions are written once and measured."""
    avail = available_backends(mappings, limits)
    if is_small(mappings) and is_small(limits):
        named = sum(r[0] for r in mappings.select(F.size("backend_ids")).collect())     # literal rows
        if named * len(limits.select("id").collect()) <= BROADCAST_MAX_ROWS:
            return F.broadcast(avail)
    return measured_broadcast(avail)


def route(requests: DataFrame, mappings: DataFrame, limits: DataFrame,
          default_model_id: str | None, default_embedding_model_id: str | None,
          pick: str = "round_robin") -> DataFrame:
    """J1 + J2 + J3 + J5 + J6 + P28.

    ``requests`` needs request_id, protocol, requested_model and optionally
    reject_reason/reject_status (invalid requests keep their reject status and
    are not routed). Adds
    default_id, resolved_model, route_status (200 / 404 / 503), n_backends,
    backend_id, backend_root_url, backend_limit, target_url, logged_model.

    ``pick`` chooses one backend among the available ones: ``round_robin``
    (``request_id mod n``) or ``hash`` (the first 32 bits of md5(request_id) mod n).
    """
    avail = _backend_lookup(mappings, limits)
    default_id = F.when(F.col("protocol").isin(*EMBEDDING_PROTOCOLS), F.lit(default_embedding_model_id)) \
        .otherwise(F.lit(default_model_id)).cast("string")
    req = requests.withColumn("default_id", default_id)
    direct = avail.select(F.col("model_id").alias("_m1"), F.col("backends").alias("_b1"))
    fallback = avail.select(F.col("model_id").alias("_m2"), F.col("backends").alias("_b2"))
    j = (req.join(direct, F.col("requested_model") == F.col("_m1"), "left")
            .join(fallback, F.col("_m1").isNull() & (F.col("default_id") == F.col("_m2")), "left"))
    mapped = F.col("_m1").isNotNull()
    found = mapped | F.col("_m2").isNotNull()
    backends = F.when(mapped, F.col("_b1")).otherwise(F.col("_b2"))
    n = F.size(backends)
    key = F.col("request_id") if pick == "round_robin" else F.expr("CAST(conv(substr(md5(CAST(request_id AS STRING)), 1, 8), 16, 10) AS BIGINT)")
    chosen = F.when(found & (n > 0), F.element_at(backends, (F.pmod(key, n) + 1).cast("int")))
    if "reject_status" in requests.columns:
        chosen = F.when(F.col("reject_status").isNull(), chosen)
    status = F.when(~found, F.lit(404)).when(n == 0, F.lit(503)).otherwise(F.lit(200))
    if "reject_status" in requests.columns:
        status = F.when(F.col("reject_status").isNotNull(), F.col("reject_status")).otherwise(status)
    status = status.cast("int")
    resolved = F.when(mapped, F.col("requested_model")).when(found, F.col("_m2"))
    out = j.select(
        *[c for c in req.columns],
        resolved.alias("resolved_model"),
        status.alias("route_status"),
        F.when(found, n).otherwise(F.lit(0)).alias("n_backends"),
        chosen.getField("id").alias("backend_id"),
        chosen.getField("url").alias("backend_root_url"),
        chosen.getField("context_limit").alias("backend_limit"),
    )
    ok = F.col("route_status") == 200
    return out.select(
        "*",
        F.when(ok, target_url(F.col("backend_root_url"), F.col("protocol"))).alias("target_url"),
        # A fallback hit logs the default id; 404/503 log the requested id
        F.when(ok, F.col("resolved_model")).otherwise(F.col("requested_model")).alias("logged_model"),
    )


# fixed value: the text of a limit error
LIMIT_MESSAGE = "request (%d tokens) exceeds the available context size (%d tokens), try increasing it"


def limit_message(prompt_tokens: Column, limit: Column) -> Column:
    """P21."""
    return F.format_string(LIMIT_MESSAGE, prompt_tokens, limit)


def limit_error_json(protocol: Column, message: Column) -> Column:
    """Messages dialect: type invalid_request_error, no code; others carry code 400."""
    openai = F.to_json(F.struct(F.struct(message.alias("message"), F.lit(LIMIT_ERROR_TYPE).alias("type"),
                                         F.lit(400).alias("code")).alias("error")))
    anthropic = F.to_json(F.struct(F.struct(message.alias("message"),
                                            F.lit(LIMIT_ERROR_TYPE_MESSAGES).alias("type")).alias("error")))
    return F.when(protocol == "messages", anthropic).otherwise(openai)


def check_limit(routed: DataFrame, prompt_tokens: str = "prompt_tokens") -> DataFrame:
    """J4 + F7: reject iff the picked backend's limit is known and the prompt
    estimate is strictly above it. The native embedding passthrough is never
    checked (T20). Adds limit_exceeded, limit_status, limit_error."""
    pt = F.col(prompt_tokens)
    lim = F.col("backend_limit")
    exceeded = ((F.col("route_status") == 200) & ~F.col("protocol").isin(*NATIVE_PROTOCOLS)
                & lim.isNotNull() & (pt > lim))
    msg = limit_message(pt, lim)
    return routed.select(
        "*",
        exceeded.alias("limit_exceeded"),
        F.when(exceeded, F.lit(400)).otherwise(F.col("route_status")).cast("int").alias("limit_status"),
        F.when(exceeded, msg).alias("limit_message"),
        F.when(exceeded, limit_error_json(F.col("protocol"), msg)).alias("limit_error"),
    )


def model_list(mappings: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct models in configuration order with the max known limit of
    their named backends (unknown or 0 -> 4096, P30)."""
    fm = first_mappings(mappings)
    bridge = fm.select("model_id", "map_pos", F.explode(F.array_distinct("backend_ids")).alias("id"))
    lim = bridge.join(checked_broadcast(limits.select("id", "context_limit")), "id", "left") \
        .groupBy("model_id").agg(F.max("context_limit").alias("max_limit"))
    return (fm.join(lim, "model_id", "left")
              .select(F.col("model_id").alias("id"), F.col("map_pos").alias("pos"),
                      F.lit("model").alias("object"), F.lit(OWNER).alias("owned_by"),
                      F.coalesce(F.nullif(F.col("max_limit"), F.lit(0)), F.lit(LIST_DEFAULT_CONTEXT))
                       .cast("bigint").alias("context_length"))
              .orderBy("pos"))


def model_browser(mappings: DataFrame, backends: DataFrame, limits: DataFrame,
                  default_model_id: str | None, default_embedding_model_id: str | None) -> DataFrame:
    """A10 (+ A6, A8, J7, P29): one row per distinct model, first mapping wins,
    with a nested, ordered list of backend entries. Entries name every id of the
    mapping, configured or not (orphans: url NULL, configured false); on a
    duplicate backend id the last configuration entry wins."""
    fm = first_mappings(mappings)
    entries = fm.select("model_id", "map_pos", F.posexplode("backend_ids").alias("entry_pos", "id"))
    w = Window.partitionBy("id").orderBy(F.desc("pos"))
    last_backend = (backends.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
                    .select("id", "url"))
    lim = limits.groupBy("id").agg(F.max_by("context_limit", "pos").alias("context_limit"))
    e = (entries.join(checked_broadcast(last_backend), "id", "left")
                .join(checked_broadcast(lim), "id", "left"))
    per_model = e.groupBy("model_id").agg(
        F.max("context_limit").alias("context_length"),
        F.array_sort(F.collect_list(F.struct(
            "entry_pos", "id", "url", F.col("url").isNotNull().alias("configured"),
            "context_limit"))).alias("_entries"))
    backends_col = F.transform("_entries", lambda x: F.struct(
        x.getField("id").alias("id"), x.getField("url").alias("url"),
        x.getField("configured").alias("configured"),
        x.getField("context_limit").alias("context_length")))
    return (fm.join(per_model, "model_id", "left")
              .select(F.col("model_id").alias("id"), F.col("map_pos").alias("pos"),
                      F.lit("model").alias("object"), F.lit(OWNER).alias("owned_by"),
                      "context_length",
                      F.col("model_id").eqNullSafe(F.lit(default_model_id)).alias("is_default"),
                      F.col("model_id").eqNullSafe(F.lit(default_embedding_model_id)).alias("is_default_embedding"),
                      backends_col.alias("backends"))
              .orderBy("pos"))


def flatten_browser(browser: DataFrame) -> DataFrame:
    """One row per (model, backend entry) for tabular comparison."""
    return browser.select(
        "id", "pos", "context_length", "is_default", "is_default_embedding",
        F.posexplode_outer("backends").alias("entry_pos", "entry"),
    ).select("id", "pos", "context_length", "is_default", "is_default_embedding", "entry_pos",
             F.col("entry.id").alias("backend_id"), F.col("entry.url").alias("backend_url"),
             F.col("entry.configured").alias("configured"),
             F.col("entry.context_length").alias("backend_context_length"))
