"""Operator 11: conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows, in order of turn, are edited at least cost so that its role initials read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate
rows), Insert an empty user or assistant row 5; a truncated row that stays adds 5. The costs to the end
form a vector over four states (nothing yet, after s, after u, after a), which a row maps to the vector
before it. A conversation is cut into chunks; every chunk but the last starts from a
speculative vector. Fix-up passes give a chunk the vector that its successor really has and run it
again until the vectors differ from the earlier ones only by a constant, which changes
no choice. The chunks' state maps are then stitched, and each chunk traces its cheapest edits, the
least letter first among equals.

Spark's shape: rows are dealt by range and sorted once, with their texts. A conversation that
lies inside one part and fits one chunk is solved there. The others (two a part, and long ones) are
written as chunks; duplicates across parts, passes and stitching move slim rows keyed by chunk,
so that one long conversation spreads over all tasks. Its SHA-256 alone is a chain by
definition and is streamed, chunk by chunk, by one task in bounded memory.

Cases: a null role or text counts as one space. Rows of a null conv_id are one conversation. Null
turns come first. Rows that share a turn are taken by role, then text (beyond 64 characters by a hash).
A conversation without rows has zeros, an empty audit and the empty string's hash.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_ROWS = 4096
CHUNK_CHARS = 4 << 20
BLOCK = 1024                 # chunks whose state maps are stitched at once
# states: nothing yet, after s, after u, after a
START, S, U, A = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
AFTER = (U, U, A, U)         # state after the next user or assistant row that fits
KEEPS = ({START: S}, {START: U, S: U, A: U}, {U: A}, {})     # by initial s, u, a, other
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")   # inserts that a conversation's end still needs
GUESS = (0, 0, 0, 0)
MUST_GO = 0                  # code of a row that has to be deleted; else 1 + 2 * initial + truncated
LEGAL = {(0, 1), (1, 2), (2, 1)}


# ------------------------------------------------------------------ one row

def _direct(code: int, after: tuple) -> list[dict[str, tuple[int, int]]]:
    """For every state, the edits of a row: letter -> (cost to the end, state after)."""
    out = []
    for state in range(4):
        edits = {"D": (DELETE + after[state], state)}
        if code != MUST_GO:
            initial, truncated = divmod(code - 1, 2)
            extra = TRUNCATED * truncated
            to = KEEPS[initial].get(state)
            if to is not None:
                edits["K"] = (extra + after[to], to)
            edits["R"] = (REROLE + extra + after[AFTER[state]], AFTER[state])
        out.append(edits)
    return out


def _full(direct: list[dict]) -> tuple:
    """Cost to the end of every state, with up to two inserts before the row."""
    least = [min(c for c, _ in e.values()) for e in direct]
    return tuple(min(least[q], INSERT + least[AFTER[q]], 2 * INSERT + least[AFTER[AFTER[q]]]) for q in range(4))


@functools.lru_cache(maxsize=1 << 16)
def back(code: int, after: tuple) -> tuple:
    """Vector before a row from the one after it, both less their last entry."""
    full = _full(_direct(code, after))
    return tuple(x - full[3] for x in full)


@functools.lru_cache(maxsize=1 << 16)
def edits(code: int, after: tuple, state: int) -> tuple[str, int]:
    """(letters, state after): the ASCII-least cheapest edits of a row, inserts before it included."""
    direct, letters = _direct(code, after), ""
    full = _full(direct)
    while True:
        options = dict(direct[state])
        options["I"] = (INSERT + full[AFTER[state]], AFTER[state])
        letter = min(x for x, (c, _) in options.items() if c == full[state])
        letters, state = letters + letter, options[letter][1]
        if letter != "I":
            return letters, state


# ------------------------------------------------------------------ one chunk

def vectors(codes: bytes, end: tuple) -> list[tuple]:
    """The vector after each row; [0] is the one before the first."""
    out = [end] * (len(codes) + 1)
    for k in range(len(codes) - 1, -1, -1):
        out[k] = end = back(codes[k], end)
    return out


def rerun(codes: bytes, was: tuple, was_out: tuple, end: tuple) -> tuple:
    """The chunk's outcome from ``end``: run again until parallel to the earlier run from ``was``."""
    for code in reversed(codes):
        if was == end:
            return was_out
        was, end = back(code, was), back(code, end)
    return end


def trace(codes: bytes, after: list[tuple], state: int) -> tuple[list[str], int]:
    """(letters of each row, state after the chunk)."""
    out = []
    for k, code in enumerate(codes):
        letters, state = edits(code, after[k + 1], state)
        out.append(letters)
    return out, state


def moves(codes: bytes, after: list[tuple]) -> list[int]:
    """State after the chunk for each state before it."""
    states = list(range(4))
    for k, code in enumerate(codes):
        states = [edits(code, after[k + 1], q)[1] for q in states]
    return states


def rebuilt(steps: list[str], tail: str, state: int, codes: bytes, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """(``role:text`` of every row of the result, cost)."""
    out, cost, names = [], 0, ("user", "user", "assistant", "user")      # the next role from a state
    for k, letters in enumerate([*steps, tail]):
        for x in letters:
            if x == "D":
                cost += DELETE
                continue
            if x == "I":
                cost += INSERT
                out.append(names[state] + ":")
                state = AFTER[state]
                continue
            initial, truncated = divmod(codes[k] - 1, 2)
            cost += TRUNCATED * truncated + (REROLE if x == "R" else 0)
            out.append(f"{names[state] if x == 'R' else roles[k]}:{texts[k]}")
            state = AFTER[state] if x == "R" else KEEPS[initial][state]
    return out, cost


# ------------------------------------------------------------------ rows to chunks

COUNTS = ("blank", "duplicate", "truncated", "illegal")
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
CHUNK = (RESULT + ", closed boolean, part int, chunk int, codes binary, digests binary, roles array<string>, "
         "texts array<string>, turns long, first_turn long, last_turn long, first_role int, last_role int")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _arrow(schema))


class _Conversation:
    """What is known of the conversation that is being read: its current chunk, and what its earlier rows
    of this part leave behind (the roles and texts met, the last turn and role)."""

    def __init__(self, conv_id, part: int, first: bool):
        self.conv_id, self.part, self.first, self.chunk = conv_id, part, first, 0
        self.met: set[bytes] = set()
        self.turn = self.role = None
        self._fresh()

    def _fresh(self):
        self.codes, self.digests, self.roles, self.texts, self.chars = bytearray(), [], [], [], 0
        self.count = dict.fromkeys(COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.first_role = 0, None, None, None

    def add(self, turn, initial, truncated, blank, digest, role, text):
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.turn = self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.role is not None and (self.role, initial) not in LEGAL:
            self.count["illegal"] += 1
        self.first_role = initial if self.first_role is None else self.first_role
        self.role = initial
        code = MUST_GO
        if blank:
            self.count["blank"] += 1
        elif digest in self.met:
            self.count["duplicate"] += 1
        else:
            code = 1 + 2 * initial + truncated
            self.count["truncated"] += truncated
        self.met.add(digest)
        self.codes.append(code)
        self.digests.append(digest)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def open_chunk(self) -> dict:
        row = {"conv_id": self.conv_id, **self.count, "closed": False, "part": self.part, "chunk": self.chunk,
               "codes": bytes(self.codes), "digests": b"".join(self.digests), "roles": self.roles, "texts": self.texts,
               "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
               "first_role": self.first_role, "last_role": self.role if self.codes else None}
        self.chunk += 1
        self._fresh()
        return row

    def solved(self) -> dict:
        """The whole result, where the conversation is one chunk."""
        codes = bytes(self.codes)
        steps, state = trace(codes, vectors(codes, END), START)
        lines, cost = rebuilt(steps, TAIL[state], START, codes, self.roles, self.texts)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.count, "cost": cost, "audit": "".join(steps) + TAIL[state],
                "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(), "closed": True}


def _chunks(chunk_rows: int, chunk_chars: int):
    def read(batches):
        part, now, rows, chars = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for conv_id, turn, gone, initial, truncated, blank, digest, role, text in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        rows.append(now.open_chunk() if now.first or now.chunk else now.solved())
                    now = _Conversation(conv_id, part, now is None)
                if gone:
                    continue
                if len(now.codes) >= chunk_rows or now.chars >= chunk_chars:
                    chars += now.chars
                    rows.append(now.open_chunk())
                now.add(turn, initial, truncated, blank, digest, role, text)
                if len(rows) >= 4096 or chars >= chunk_chars:
                    yield _batch(rows, CHUNK)
                    rows, chars = [], 0
        if now is not None:
            yield _batch([*rows, now.open_chunk()], CHUNK)
    return read


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    """Classified rows, dealt by range and sorted. The last key tells equal rows apart, so that any
    number of them can be dealt to several parts."""
    blanks = " \t\n\x0b\x0c\r"
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        gone.alias("gone"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    slim = slim.withColumn("_end", F.rtrim("text", F.lit(blanks))).select(
        "conv_id", "turn", "gone",
        F.expr("CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END").alias("initial"),
        F.expr("CAST(right(_end, 1) NOT IN ('.', '!', '?') AS INT)").alias("truncated"),
        F.expr("_end = ''").alias("blank"),
        F.expr("unhex(md5(concat(length(role), ':', role, text)))").alias("digest"), "role", "text")
    keyed = slim.withColumn("_head", F.expr("left(text, 64)")).withColumn("_id", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_head", "digest", "_id"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_head", "_id")


# ------------------------------------------------------------------ chunks that need their neighbours

def _same(*pairs):
    """Join condition that counts nulls as equal."""
    on = None
    for a, b in pairs:
        on = a.eqNullSafe(b) if on is None else on & a.eqNullSafe(b)
    return on


def _later_copies(chunks: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, again): rows that an earlier part of their conversation holds too. A part names
    a role and text once, so that a group has at most one row a part."""
    rows = (chunks.filter("length(codes) > 0").select(
        "conv_id", "part", "chunk", "codes", "digests", F.explode(F.expr("sequence(0, length(codes) - 1)")).alias("k"))
        .filter("substring(codes, k + 1, 1) <> X'00'")
        .select("conv_id", F.struct("part", "chunk", "k").alias("at"), F.expr("substring(digests, 16 * k + 1, 16)").alias("digest")))
    return (rows.groupBy("conv_id", "digest").agg(F.sort_array(F.collect_list("at")).alias("at"))
            .filter("size(at) > 1").select("conv_id", F.explode(F.expr("slice(at, 2, size(at) - 1)")).alias("at"))
            .groupBy("conv_id", F.col("at.part").alias("part"), F.col("at.chunk").alias("chunk"))
            .agg(F.collect_list("at.k").alias("again")))


UNIT = ("conv_id long, part int, chunk int, seq long, last boolean, codes binary, duplicate_more long, truncated_less long, "
        "start array<int>, out array<int>")


def _speculate(batches):
    """First run of every chunk: from the end's vector, or from a guess."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            codes, again = bytearray(r["codes"]), r.pop("again") or []
            less = sum((codes[k] - 1) % 2 for k in again)
            for k in again:
                codes[k] = MUST_GO
            start = END if r["last"] else GUESS
            rows.append({**r, "codes": bytes(codes), "duplicate_more": len(again), "truncated_less": less,
                         "start": start, "out": vectors(codes, start)[0]})
        yield _batch(rows, UNIT)


STATE = "conv_id long, seq long, start array<int>, out array<int>"


def _fix(batches):
    for batch in batches:
        yield _batch([{"conv_id": r["conv_id"], "seq": r["seq"], "start": r["actual"], "out": rerun(
            r["codes"], tuple(r["start"]), tuple(r["out"]), tuple(r["actual"]))} for r in batch.to_pylist()], STATE)


def _converged(spark: SparkSession, units: DataFrame) -> DataFrame:
    """(conv_id, seq, start, out) in which every chunk started from its successor's outcome. A pass runs
    only the chunks whose successor's outcome is not parallel to what they started from."""
    state = units.select("conv_id", "seq", "start", "out")
    codes = units.select("conv_id", "seq", "codes")
    while True:
        folder = scratch_path(spark, "repair-pending")
        b = state.select(F.col("conv_id").alias("c"), (F.col("seq") - 1).alias("s"), F.col("out").alias("actual"))
        (state.join(b, _same((F.col("conv_id"), F.col("c")), (F.col("seq"), F.col("s"))))
         .filter("start <> actual").select("conv_id", "seq", "start", "out", "actual").write.parquet(folder))
        pending = spark.read.parquet(folder)
        if pending.isEmpty():
            return state
        keys = codes.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "codes")
        fixed = pending.join(keys, _same((F.col("conv_id"), F.col("c")), (F.col("seq"), F.col("s")))).select(
            "conv_id", "seq", "start", "out", "actual", "codes").mapInArrow(_fix, STATE)
        rest = state.join(pending.select(F.col("conv_id").alias("c"), F.col("seq").alias("s")),
                          _same((F.col("conv_id"), F.col("c")), (F.col("seq"), F.col("s"))), "left_anti")
        folder = scratch_path(spark, "repair-state")
        rest.unionByName(fixed).write.parquet(folder)
        state = spark.read.parquet(folder)


def _moved(batches):
    for batch in batches:
        yield _batch([{"conv_id": r["conv_id"], "seq": r["seq"], "moves": moves(
            r["codes"], vectors(r["codes"], tuple(r["start"])))} for r in batch.to_pylist()], MOVES)


MOVES = "conv_id long, seq long, moves array<int>"
ENTRY = "conv_id long, seq long, entry int"


def _walk(batches):
    """Entry state of every chunk of a block from the block's own."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            state = r["entry"]
            for one in r["chunks"]:
                rows.append({"conv_id": r["conv_id"], "seq": one["seq"], "entry": state})
                state = one["moves"][state]
        yield _batch(rows, ENTRY)


def _entries(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(conv_id, seq, entry) from (conv_id, seq, moves): blocks of chunks are composed to one map each,
    level by level until a conversation is one block, and walked on the way back."""
    blocks = (table.groupBy("conv_id", F.expr(f"seq div {BLOCK}").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("seq", "moves"))).alias("chunks")))
    folder = scratch_path(spark, "repair-blocks")
    blocks.write.parquet(folder)
    blocks = spark.read.parquet(folder)
    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        return blocks.select("conv_id", F.lit(START).alias("entry"), "chunks").mapInArrow(_walk, ENTRY)
    whole = blocks.select("conv_id", F.col("block").alias("seq"), F.aggregate(
        "chunks", F.array(*map(F.lit, range(4))),
        lambda acc, x: F.transform(acc, lambda q: F.element_at(x["moves"], q + 1))).alias("moves"))
    above = _entries(spark, whole).select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "entry")
    return blocks.join(above, _same((F.col("conv_id"), F.col("c")), (F.col("block"), F.col("s")))).select(
        "conv_id", "entry", "chunks").mapInArrow(_walk, ENTRY)


PIECE = "conv_id long, seq long, audit string, cost long, body binary"


def _traced(batches):
    """Edits and result of a chunk; ``body`` is null where nothing is left."""
    for batch in batches:
        for r in batch.to_pylist():
            codes, state = r["codes"], r["entry"]
            steps, end = trace(codes, vectors(codes, tuple(r["start"])), state)
            tail = TAIL[end] if r["last"] else ""
            lines, cost = rebuilt(steps, tail, state, codes, r["roles"], r["texts"])
            yield _batch([{"conv_id": r["conv_id"], "seq": r["seq"], "audit": "".join(steps) + tail, "cost": cost,
                           "body": "\n".join(lines).encode() if lines else None}], PIECE)


WHOLE = "conv_id long, cost long, audit string, repaired_sha256 string"


def _stitched(batches):
    """Chunks in order to whole conversations; a body is hashed and let go."""
    now, rows = None, []

    def done():
        return {"conv_id": now[0], "cost": now[1], "audit": "".join(now[2]), "repaired_sha256": now[3].hexdigest()}
    for batch in batches:
        for conv_id, _, audit, cost, body in zip(*batch.columns):
            if now is None or conv_id.as_py() != now[0]:
                if now is not None:
                    rows.append(done())
                now = [conv_id.as_py(), 0, [], hashlib.sha256(), False]
            now[1] += cost.as_py()
            now[2].append(audit.as_py())
            if body.is_valid:
                now[3].update(b"\n" if now[4] else b"")
                now[3].update(body.as_buffer())
                now[4] = True
        if rows:
            yield _batch(rows, WHOLE)
            rows = []
    if now is not None:
        yield _batch([done()], WHOLE)


def _open_conversations(spark: SparkSession, chunks: DataFrame, parts: int) -> DataFrame:
    by_conv = Window.partitionBy("conv_id")
    before = by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per conversation and part
    spans = chunks.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"),
        F.sum("turns").alias("turns"),
        F.expr("min_by(first_role, CASE WHEN first_role IS NOT NULL THEN chunk END)").alias("first_role"),
        F.expr("max_by(last_role, CASE WHEN last_role IS NOT NULL THEN chunk END)").alias("last_role"))
    folder = scratch_path(spark, "repair-spans")
    spans.select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(by_conv).alias("total"),
        F.last("last_turn", ignorenulls=True).over(before).alias("turn_before"),
        F.last("last_role", ignorenulls=True).over(before).alias("role_before")).write.parquet(folder)
    spans = spark.read.parquet(folder)
    place = spans.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "base", "total")
    copies = _later_copies(chunks).select(
        F.col("conv_id").alias("cc"), F.col("part").alias("cp"), F.col("chunk").alias("ck"), "again")
    folder = scratch_path(spark, "repair-units")
    (chunks.select("conv_id", "part", "chunk", "codes")
     .join(place, _same((F.col("conv_id"), F.col("c")), (F.col("part"), F.col("p"))))
     .join(copies, _same((F.col("conv_id"), F.col("cc")), (F.col("part"), F.col("cp")), (F.col("chunk"), F.col("ck"))), "left")
     .select("conv_id", "part", "chunk", (F.col("base") + F.col("chunk")).alias("seq"),
             F.expr("base + chunk = total - 1").alias("last"), "codes", "again")
     .mapInArrow(_speculate, UNIT).write.parquet(folder))
    units = spark.read.parquet(folder)
    state = _converged(spark, units).select(F.col("conv_id").alias("sc"), F.col("seq").alias("sq"), F.col("start").alias("settled"))
    settled = units.join(state, _same((F.col("conv_id"), F.col("sc")), (F.col("seq"), F.col("sq")))).select(
        "conv_id", "part", "chunk", "seq", "last", "codes", F.col("settled").alias("start"))
    entry = _entries(spark, settled.select("conv_id", "seq", "codes", "start").mapInArrow(_moved, MOVES)).select(
        F.col("conv_id").alias("ec"), F.col("seq").alias("es"), "entry")
    texts = chunks.select(F.col("conv_id").alias("tc"), F.col("part").alias("tp"), F.col("chunk").alias("tk"), "roles", "texts")
    pieces = (settled.join(entry, _same((F.col("conv_id"), F.col("ec")), (F.col("seq"), F.col("es"))))
              .join(texts, _same((F.col("conv_id"), F.col("tc")), (F.col("part"), F.col("tp")), (F.col("chunk"), F.col("tk"))))
              .select("conv_id", "seq", "last", "codes", "start", "entry", "roles", "texts").mapInArrow(_traced, PIECE))
    whole = pieces.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_stitched, WHOLE)

    more = units.groupBy("conv_id").agg(F.sum("duplicate_more").alias("more"), F.sum("truncated_less").alias("less"))
    turns = spans.groupBy("conv_id").agg(
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns")
         + F.sum(F.expr("CAST(first_turn <=> turn_before AND first_turn IS NOT NULL AS INT)"))).alias("gaps"),
        F.sum(F.expr("CAST(first_role IS NOT NULL AND role_before IS NOT NULL AND struct(role_before, first_role) NOT IN "
                     "(struct(0, 1), struct(1, 2), struct(2, 1)) AS INT)")).alias("crossing"))
    counts = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    for k, other in enumerate((more, turns, counts)):
        whole = whole.join(other.withColumnRenamed("conv_id", f"o{k}"), F.col("conv_id").eqNullSafe(F.col(f"o{k}")))
    return whole.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank",
        (F.col("duplicate") + F.col("more")).alias("duplicate"), (F.col("truncated") - F.col("less")).alias("truncated"),
        (F.col("illegal") + F.col("crossing")).alias("illegal"), "cost", "audit", "repaired_sha256")


def repair(spark: SparkSession, rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, and optionally a boolean ``gone``
    for rows that only name their conversation): conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "repair-chunks")
    _sorted(rows, parts).select("conv_id", "turn", "gone", "initial", "truncated", "blank", "digest", "role", "text").mapInArrow(
        _chunks(chunk_rows, chunk_chars), CHUNK).write.parquet(folder)
    table = spark.read.parquet(folder)
    columns = [x.split()[0] for x in RESULT.split(", ")]
    solved = table.filter("closed").select(columns)
    return solved.unionByName(_open_conversations(spark, table.filter("NOT closed"), parts).select(columns))


def damage(rows: DataFrame) -> DataFrame:
    """The damaged table of the contract: by crc32(``conv_id:turn``) modulo 20, 0 marks a row as gone, 1
    empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it a user's."""
    slim = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    kind = F.expr("crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20")
    return slim.withColumn("kind", kind).select(
        "conv_id", "turn", F.expr("kind = 0").alias("gone"), F.expr("IF(kind = 4, 'user', role)").alias("role"),
        F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("IF(kind = 3, array(0, 1), array(0))")).alias("copy")).drop("copy")
