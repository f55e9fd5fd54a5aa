"""Operator 11 against a plain dynamic programme that keeps whole audits."""

import hashlib
import random
import zlib

import pytest

from inference_ledger.llm import queries, repair

from .conftest import SF

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_edits(rows):
    """(cost, audit, repaired rows) by (cost, audit) of the best way to every state, row by row."""
    def closed(best):
        for _ in range(3):
            for q, (c, audit, out) in list(best.items()):
                for x in NEXT[q]:
                    if x != "s":
                        new = (c + 5, audit + "I", [*out, ({"u": "user", "a": "assistant"}[x], "")])
                        if x not in best or new[:2] < best[x][:2]:
                            best[x] = new
        return best
    best = closed({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def offer(q, way):
            if q not in new or way[:2] < new[q][:2]:
                new[q] = way
        for q, (c, audit, out) in best.items():
            offer(q, (c + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in NEXT[q]:
                offer(role[:1], (c + extra, audit + "K", [*out, (role, text)]))
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in NEXT[q]:
                    offer(x, (c + extra + 1, audit + "R", [*out, (name, text)]))
        best = closed(new)
    return min((best[q] for q in ("", "a") if q in best), key=lambda w: w[:2])


def brute(table):
    groups = {}
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kept = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(),
                                 hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, rows, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else \
                "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            rows.append((role, text, fault))
            if fault:
                n[fault] += 1
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, fixed = brute_edits(rows)
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                    illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def random_table(seed, convs, longest):
    rng = random.Random(seed)
    table = []
    for conv in [*range(convs), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, longest])):
            table.append((conv, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]),
                          rng.choice(["Yes.", "No", "Why?", " \t", "", None, "Go on!  ", "a" * 70 + ".", "a" * 70 + "b."])))
    return table


def test_op11_on_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_repair(spark, SF)) == brute(table)


@pytest.mark.parametrize("chunk_rows,longest", [(2, 30), (4096, 40)])
def test_chunks_of_any_size_give_the_same(spark, chunk_rows, longest):
    table = random_table(chunk_rows, 25, longest)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("*", "1 AS part", "2 AS gone", "3 AS codes")
    assert result(repair.repair(spark, repair.damage(df), chunk_rows)) == brute(table)


def test_one_conversation_over_all_parts(spark):
    rng = random.Random(9)
    table = [(7, k // 2 if k % 5 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", f"t{k}."]))
             for k in range(400)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    assert result(repair.repair(spark, repair.damage(df), 16)) == brute(table)
    assert result(repair.repair(spark, repair.damage(df))) == brute(table)


def test_many_chunks_are_stitched_by_levels(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 3)
    table = [(c, k, "system" if k % 7 == 0 else "user" if k % 2 else "assistant", f"t{k}" + "." * (k % 3)) for c in (1, 2) for k in range(60)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert result(repair.repair(spark, repair.damage(df), 2)) == brute(table)


def test_empty_table_and_conversations_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(spark, repair.damage(df)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], df.schema)
    assert result(repair.repair(spark, repair.damage(df))) == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_speculative_run_is_cut_short_where_vectors_are_parallel():
    codes = bytes([3, 5] * 50)                 # user, assistant, ...
    guess = repair.vectors(codes, repair.GUESS)
    true = repair.vectors(codes, repair.END)
    assert guess[0] == true[0] and guess[90] == true[90]
    assert repair.rerun(codes, repair.GUESS, guess[0], repair.END) == true[0]
    assert repair.rerun(codes[:1], repair.GUESS, repair.vectors(codes[:1], repair.GUESS)[0], repair.END) == repair.vectors(codes[:1], repair.END)[0]
