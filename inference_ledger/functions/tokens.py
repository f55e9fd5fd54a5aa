"""Token estimate of a text column.

``estimate_tokens`` is a native (JVM, codegen) piece count: special tokens, runs of letters,
runs of up to three digits, runs of other non-space characters. BPE merges never
cross these pieces, so on ordinary text this is a lower bound of the exact count.
Returned under the name ``*_estimate``, never as exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the piece pattern (Java regex; RE2-compatible so the DuckDB
# oracle can run the same pattern) and the special-token form it keeps whole.
SPECIAL_TOKEN_PATTERN = r"<\|[A-Za-z0-9_]+\|>"
PIECE_PATTERN = SPECIAL_TOKEN_PATTERN + r"|\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
# the same pattern with possessive quantifiers for Java's engine: the
# alternatives are disjoint character classes, so no match ever needs to give
# characters back and the matches are identical; it only skips backtracking.
PIECE_PATTERN_JVM = r"<\|[A-Za-z0-9_]++\|>|\p{L}++|\p{N}{1,3}+|[^\s\p{L}\p{N}]++"


def estimate_tokens(text: Column) -> Column:
    """Native estimate; NULL or empty text counts 0. ``text`` is referenced
    once: Spark does not share a sub-expression between a conditional's
    branches, so a guard like ``when(text == '', 0)`` would build it twice."""
    return F.coalesce(F.regexp_count(text, F.lit(PIECE_PATTERN_JVM)), F.lit(0)).cast("bigint")


# A boundary that no piece crosses, whatever stands further off: beside white space, or between characters of
# two kinds of which one cannot stand in a special token.
_OWN = r"[\p{L}&&[^A-Za-z]]", r"[\p{N}&&[^0-9]]"
_MARK = r"[^\s\p{L}\p{N}_<|>]"
SURE_BOUNDARY = (r"(?<=\s)|(?=\s)"
                 + "".join(rf"|(?<={own})(?={other})|(?<={other})(?={own})"
                           for own, other in zip(_OWN, (r"[^\p{L}]", r"[^\p{N}]")))
                 + rf"|(?<={_MARK})(?=[\p{{L}}\p{{N}}])|(?<=[\p{{L}}\p{{N}}])(?={_MARK})")
SEGMENT = "struct<head: string, n: bigint, tail: string>"


def text_segment(text: Column) -> Column:
    """Mergeable count of a text that may go on at both ends: the open piece at its start, the pieces counted
    between sure boundaries, the open piece at its end (NULL where the text has no sure boundary and
    is one open piece). Only runs without sure boundary are kept as text: a word at each end, or a
    blob of ASCII letters, digits, ``_<|>``."""
    head = F.split(text, SURE_BOUNDARY, 2).getItem(0)
    tail = F.regexp_extract(text, rf"(?s)^.*(?:{SURE_BOUNDARY})(.*)$", 1)
    closed = F.length(head) < F.length(text)
    inner = F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))
    return F.struct(
        head.alias("head"), F.when(closed, estimate_tokens(inner)).otherwise(F.lit(0).cast("bigint")).alias("n"),
        F.when(closed, tail).alias("tail"))


def merged_segments(segments: Column) -> Column:
    """One segment from an array of consecutive ones."""
    def add(s: Column, x: Column) -> Column:
        joined = text_segment(F.concat(F.coalesce(s["tail"], s["head"]), x["head"]))
        # what stood open is closed by the next segment's own boundary, or by one that its first characters make
        inside = F.when(joined["tail"].isNull(), estimate_tokens(joined["head"])).otherwise(
            estimate_tokens(joined["head"]) + joined["n"] + estimate_tokens(joined["tail"]))
        both = s["tail"].isNotNull() & x["tail"].isNotNull()
        left = s["tail"].isNotNull()
        right = x["tail"].isNotNull()
        return F.when(both, F.struct(s["head"].alias("head"), (s["n"] + inside + x["n"]).alias("n"), x["tail"].alias("tail"))) \
            .when(left, F.struct(
                s["head"].alias("head"),
                (s["n"] + F.when(joined["tail"].isNull(), F.lit(0).cast("bigint")).otherwise(
                    estimate_tokens(joined["head"]) + joined["n"])).alias("n"),
                F.coalesce(joined["tail"], joined["head"]).alias("tail"))) \
            .when(right, F.struct(
                joined["head"].alias("head"),
                (F.when(joined["tail"].isNull(), F.lit(0).cast("bigint")).otherwise(
                    joined["n"] + estimate_tokens(joined["tail"])) + x["n"]).alias("n"), x["tail"].alias("tail"))) \
            .otherwise(joined)
    zero = F.expr(f"CAST(named_struct('head', '', 'n', 0L, 'tail', NULL) AS {SEGMENT})")
    return F.aggregate(segments, zero, lambda s, x: add(s, x).cast(SEGMENT))


def segment_tokens(segment: Column) -> Column:
    """Count of a whole text from its segment."""
    return (estimate_tokens(segment["head"]) + segment["n"] + estimate_tokens(segment["tail"])).cast("bigint")


def flatten_content(content_json: Column) -> Column:
    """P13 over a JSON content value: a string as-is; a list -> concatenation of
    every item's ``text`` with no separator; anything else -> empty."""
    v = F.try_parse_json(content_json)
    kind = F.schema_of_variant(v)
    items = F.from_json(content_json, "array<map<string,variant>>")
    texts = F.transform(items, lambda m: F.coalesce(F.try_variant_get(m.getItem("text"), "$", "string"), F.lit("")))
    return (F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind.startswith("ARRAY"), F.array_join(texts, ""))
            .otherwise(F.lit("")))
