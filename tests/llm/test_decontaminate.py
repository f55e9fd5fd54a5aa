"""Operator 4 against brute force over all windows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inference_ledger.llm import decontaminate, queries

from .conftest import SF

WORD = re.compile(r"[^\W_]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return [" ".join(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []


def brute(docs, items):
    out = {}
    for d, t in docs:
        s = shingles(t)
        for i, item in items:
            mine = shingles(item)
            if not mine or not set(s) & set(mine):
                continue
            m, want, best = min(len(mine), len(s)), Counter(mine), None
            for a in range(len(s) - m + 1):
                common = sum((Counter(s[a:a + m]) & want).values())
                j = common / (m + len(mine) - common)
                if j >= 0.8 and (best is None or j > best[1]):
                    best = (a, j)
            if best:
                out[d, i] = best
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.first_word, r.similarity) for r in df.collect()}


def test_op4_on_table(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(documents, items)
    assert want and found(queries.op4_decontaminate(spark, SF)) == want


def fixture(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]

    def mk(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(0, mk(60)), (1, mk(3)), (2, None), (3, ""), (4, mk(30)), (5, "a b " * 8), (6, mk(20))]
    items.append((9, items[0][1]))
    long, short = items[0][1], items[1][1]
    docs = [(0, None), (1, ""), (2, long), (3, mk(50) + " " + long.upper() + " " + mk(20)), (4, short),
            (5, "x " + "a b " * 8 + " z"), (None, mk(9) + " " + items[4][1]), (7, " ".join(long.split()[:56])),
            (7, " ".join(long.split()[:56])), (8, " ".join([*long.split()[:30], "zz", *long.split()[30:]])),
            (10, items[4][1] + " " + mk(5) + " " + items[4][1]), (11, mk(3000))]
    for k in range(30):
        w = long.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "q"
        docs.append((100 + k, mk(10) + " " + " ".join(w) + " " + mk(10)))
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS fp"), \
        spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows(spark):
    docs, items, d, i = fixture(spark)
    want = brute(docs, items)
    assert found(decontaminate.contamination(spark, d, i)) == want
    clean = decontaminate.clean_documents(spark, d, i)
    assert clean.columns == d.columns
    bad = {k[0] for k in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(x for x, _ in docs if x not in bad)
    assert decontaminate.contamination(spark, d.limit(0), i).count() == 0
    assert decontaminate.clean_documents(spark, d, i.limit(0)).count() == len(docs)


def test_no_window_is_lost_by_its_fingerprint(spark):
    rng = random.Random(4)
    items, docs = [(0, " ".join("ab"[k % 2] for k in range(13)))], [(0, " ".join("ba"[k % 2] for k in range(13)))]
    for k in range(1, 400):                 # 4 of 5 shingles: similarity 0.8, at any distance
        w = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(w[:8])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) == 400
    assert found(decontaminate.contamination(spark, d, i)) == want


def test_large_item_side_is_not_broadcast(spark, monkeypatch):
    docs, items, d, i = fixture(spark)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert found(decontaminate.contamination(spark, d, i)) == brute(docs, items)


def test_main_path_runs_no_python(spark):
    df = queries.op4_decontaminate(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_exact_way_finds_the_same(spark):
    docs, items, d, i = fixture(spark)
    assert found(decontaminate.contamination(spark, d, i, exact=True)) == brute(docs, items)


def test_one_common_shingle_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    phrase = "this is the common phrase"
    words = lambda n: " ".join(f"z{rng.randrange(10**9)}" for _ in range(n))
    d = spark.createDataFrame([(k, f"{words(20)} {phrase} {words(20)}") for k in range(60)], "doc_id long, text string")
    i = spark.createDataFrame([(k, f"{words(10)} {phrase} {words(10)}") for k in range(40)], "item_id long, text string")
    sizes = []
    real = decontaminate._few
    monkeypatch.setattr(decontaminate, "_few", lambda df: sizes.append(df.count()) or real(df))
    assert decontaminate.contamination(spark, d, i).count() == 0
    assert sizes[-1] == 0                    # no hit of the index


def test_index_finds_all_within_the_radius(spark):
    rng = random.Random(7)
    signed = lambda x: x - 2 ** 64 if x >= 2 ** 63 else x
    items = [(k, 5 + k % 2, rng.getrandbits(64)) for k in range(60)]
    prints = []
    for k, size, fp in items:
        for n in (0, 1, 9, 16, 22, 23, 24, 30):
            x = fp
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            prints.append((size, x))
    i = spark.createDataFrame([(k, s, signed(f)) for k, s, f in items], "item long, size int, fp long")
    p = spark.createDataFrame([(s, signed(f)) for s, f in set(prints)], "size int, fp long")
    got = sorted(tuple(r) for r in decontaminate._within_radius(p, i, len(items)).collect())
    assert got == sorted((s, signed(f), k, (f ^ g).bit_count()) for s, f in set(prints) for k, t, g in items
                         if s == t and (f ^ g).bit_count() <= decontaminate.RADIUS)


def test_shingles_of_documents_are_hashed_in_compiled_code(spark):
    d = spark.createDataFrame([(0, "a b c d e f")], "doc_id long, text string")
    shingles = F.broadcast(spark.createDataFrame([(5, 1)], "size int, hash long"))
    plan = decontaminate._starts(decontaminate._documents(d), shingles, ["size"], 0.8)._jdf.queryExecution()
    plan = plan.executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin"):]
    assert "Generate" in below and "transform(sequence" not in below     # no lambda over all places of a text


def test_hashes_in_compiled_code_are_those_of_the_items(spark):
    texts = [None, "", " .,- ", "a", "A b", "a b c d", "a b c d e", "\u00c4 \u00e9 x3 \u4e2d\u6587 y,z  q-r", " ".join("ab"[k % 2] for k in range(40))]
    d = decontaminate._documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    hashes = decontaminate._word_hashes(d, "doc_id").select("doc_id", F.expr(decontaminate.HASHES).alias("hashes"))
    want = hashes.select("doc_id", F.size("hashes"), F.posexplode("hashes")).collect()
    got = decontaminate._exploded(d).select("doc_id", "n", "at", "hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert Counter(r.doc_id for r in got) == {k: len(shingles(t)) for k, t in enumerate(texts) if shingles(t)}


def test_rows_of_windows_hold_their_own_words(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: " ".join(f"z{rng.randrange(10**9)}" for _ in range(n))
    item = words(30)
    docs = [(k, f"{words(2000)} {item} {words(2000)}") for k in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(0, item)], "item_id long, text string")
    most, real = [], decontaminate._set_of
    monkeypatch.setattr(decontaminate, "_set_of", lambda df: most.append(df.select(F.max(F.size("words"))).first()[0]) or real(df))
    assert found(decontaminate.contamination(spark, d, i)) == brute(docs, [(0, item)])
    assert most == [30, 30]                  # of the item and of the windows
