"""JSON text as column expressions: repeated keys (the last wins), nulls of records dropped, and the
spelling of Python's ``json.dumps``.

VARIANT refuses repeated keys and sorts the keys it holds; a ``MAP`` loses order too. ``members`` therefore folds the
tokens of a document over a stack of open arrays and objects, whose texts are written when they are
closed, with the last value of each key at the place of its first. Its input is
``get_json_object(text, '$')``: compact, escapes in one spelling, NULL if the text is no JSON (what stands after a
complete document is not looked at, by VARIANT neither). All is SQL
text, so that the driver parses one expression instead of building it node by node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# one string, one mark, or one number or word
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]++'
_TOKENS = "regexp_extract_all({text}, '" + TOKEN.replace("\\", "\\\\") + "', 0)"
_NONE = "CAST(array() AS array<string>)"
_TOP = "element_at(s, -1)"


def _frame(obj: str, keys: str = _NONE, vals: str = _NONE, key: str = "CAST(NULL AS string)") -> str:
    return f"named_struct('obj', {obj}, 'keys', {keys}, 'vals', {vals}, 'key', {key})"


def _put(stack: str, value: str) -> str:
    """The stack with a value added to its top; ``b`` binds both, so that each is written once."""
    top = "element_at(b.stack, -1)"
    frame = _frame(f"{top}.obj", f"IF({top}.obj, concat({top}.keys, array({top}.key)), {top}.keys)",
                   f"concat({top}.vals, array(b.value))")
    return (f"transform(array(named_struct('stack', {stack}, 'value', {value})), "
            f"b -> concat(slice(b.stack, 1, size(b.stack) - 1), array({frame})))[0]")


def members(text: str, records: str = "false", messages: str = "false") -> str:
    """SQL of struct(keys, vals): the members of the object that ``text`` (SQL of canonical JSON) holds, keys quoted,
    values as JSON text; NULL for anything else. Where ``records`` holds, null members of the object itself are
    dropped; where ``messages`` holds, also those of the objects in its array ``messages``, whose role and content come
    first. Objects further in are data: they keep their nulls."""
    in_messages = ("size(s) = 4 AND try_element_at(s, 2).key = '\"messages\"' AND NOT try_element_at(s, 3).obj")
    of = f"element_at({_TOP}.vals, -CAST(array_position(reverse({_TOP}.keys), k) AS INT))"
    first = f"filter(array('\"role\"', '\"content\"'), k -> array_contains({_TOP}.keys, k))"
    keys = f"array_distinct(IF(({messages}) AND {in_messages}, concat({first}, {_TOP}.keys), {_TOP}.keys))"
    drop = f"((({records}) AND size(s) = 2) OR (({messages}) AND {in_messages}))"
    kept = f"filter({keys}, k -> NOT ({drop} AND {of} = 'null'))"
    closed = (f"IF({_TOP}.obj, concat('{{', array_join(transform({kept}, k -> concat(k, ':', {of})), ','), '}}'), "
              f"concat('[', array_join({_TOP}.vals, ','), ']'))")
    whole = _frame("false", kept, f"transform({kept}, k -> {of})", "'object'")
    step = f"""CASE
      WHEN t IN (',', ':') THEN s
      WHEN t IN ('{{', '[') THEN concat(s, array({_frame("t = '{'")}))
      WHEN t = '}}' AND size(s) = 2 AND s[0].key IS NULL AND size(s[0].vals) = 0 THEN array({whole})
      WHEN t IN ('}}', ']') THEN IF(size(s) < 2, s, {_put("slice(s, 1, size(s) - 1)", closed)})
      WHEN {_TOP}.obj AND {_TOP}.key IS NULL
        THEN concat(slice(s, 1, size(s) - 1), array({_frame("true", f"{_TOP}.keys", f"{_TOP}.vals", "t")}))
      ELSE {_put("s", "t")} END"""
    end = "IF(size(s) = 1 AND s[0].key = 'object', named_struct('keys', s[0].keys, 'vals', s[0].vals), NULL)"
    return f"aggregate({_TOKENS.replace("{text}", text)}, array({_frame('false')}), (s, t) -> {step}, s -> {end})"


def written(m: str) -> str:
    """SQL: the object whose members are ``m`` (a struct column of ``members``)."""
    return f"concat('{{', array_join(zip_with({m}.keys, {m}.vals, (k, v) -> concat(k, ':', v)), ','), '}}')"


def canonical(text: str) -> str:
    """SQL: compact JSON with escapes in one spelling; NULL for what is no JSON."""
    return f"get_json_object({text}, '$')"


def last_wins(df, body: str, parsed: str, text: str):
    """``df`` with ``body`` parsed once (VARIANT, column ``parsed``) and its text (column ``text``). A body
    that VARIANT refuses for repeated keys is written again with the last value of each key; only such
    bodies, and those that are no JSON, take the second way."""
    first = df.withColumn("_plain", F.try_parse_json(F.col(body)))
    again = first.withColumn("_members", F.expr(f"IF(_plain IS NULL, {members(canonical(body))}, NULL)"))
    out = again.withColumn(text, F.expr(f"IF(_members IS NULL, {body}, {written('_members')})"))
    return out.withColumn(parsed, F.coalesce(F.col("_plain"), F.when(F.col("_members").isNotNull(), F.try_parse_json(F.col(text))))).drop(
        "_plain", "_members")


# ------------------------------------------------------------------ Python's spelling

_PLAIN = r'^"[ !#-\[\]-~]*+"$'        # a string that Python writes as it stands
# fixed values: the short escapes of JSON
_SHORT = {'"': r"\"", "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}


def _hex4(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))


def _escaped(c: Column) -> Column:
    """One character as ``json.dumps`` writes it (ASCII only)."""
    n = F.ascii(c)
    out = None
    for plain, short in _SHORT.items():
        out = F.when(c == plain, F.lit(short)) if out is None else out.when(c == plain, F.lit(short))
    over = n - 0x10000
    return (out.when((n >= 32) & (n < 127), c).when(n < 0x10000, _hex4(n))
            .otherwise(F.concat(_hex4(F.shiftright(over, 10) + 0xD800), _hex4(over.bitwiseAND(0x3FF) + 0xDC00))))


def _python_string(t: Column) -> Column:
    text = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>").getItem(0)
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(t.rlike(_PLAIN), t).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(chars, _escaped), ""), F.lit('"')))


def _python_number(t: Column) -> Column:
    """A fraction or exponent as Python's ``repr`` of the double, where its digits are few enough (17 before and
    17 after the point) to be shifted as a decimal: no spare zeros, an exponent only below 0.0001 or from 10^16
    on. Others stay as they are."""
    size = F.abs(t.try_cast("double"))
    exact = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,20)").cast("string"), "0+$", ""), "\\.$", ".0")
    return F.when(t.rlike("[.eE]") & t.rlike("^-?[0-9]") & ((size >= 1e-4) & (size < 1e16) | (size == 0)),
                  F.coalesce(F.when(size == 0, F.when(t.startswith("-"), "-0.0").otherwise("0.0")), exact, t)).otherwise(t)


def python_json(text: Column) -> Column:
    """``json.dumps(json.loads(text))`` of compact JSON: ``", "`` and ``": "`` between tokens, ASCII escapes."""
    def spelled(t: Column) -> Column:
        return (F.when(t == ",", F.lit(", ")).when(t == ":", F.lit(": "))
                .when(t.startswith('"'), _python_string(t)).when(t.rlike("[.eE]"), _python_number(t)).otherwise(t))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), spelled), "")
