"""Operator 12 against sums over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inference_ledger.llm import divergence, queries

from .conftest import SF

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = [w.translate(LOWER) for w in WORD.findall(text)]
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= 3}
        sources = sorted(s for g, s in groups if g == lang)

        def ps(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: ps(counts[lang, s]) for s in sources}
        whole = ps(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b      # noqa: E731
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_op12_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert result(queries.op12_divergence(spark, SF)) == brute(rows)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abÄ大" for b in "xYzé"] + ["the", "The", "of"]
    return [(rng.choice([None, "", "1 2 !"] + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(8)]),
             rng.choice(["en", "de", None, "lone"][:3 if k else 4]), rng.choice(["s0"] * 5 + ["s1", "s2", "", None, "s 3"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed):
    rows = random_rows(seed) + [("only one", "fr", "a"), (None, "fr", "b"), ("x x x", "it", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).selectExpr("*", "1 AS value", "2 AS sid", "'t' AS term")
    assert result(divergence.audit(spark, df)) == brute(rows)
    assert result(divergence.audit(spark, df, top=2)) == brute(rows, top=2)


def test_large_counts_are_exact(spark):
    got = spark.sql(f"SELECT {divergence.probability('c', 'n', 'v')} AS p FROM VALUES (900000000000000000L, 1000000000000000001L, 7L) t(c, n, v)")
    assert got.first().p == 1 + 10 ** 9 * (900000000000000001) // 1000000000000000008


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(spark, df).count() == 0


def test_the_tree_meets_each_node_and_ancestor_once(monkeypatch):
    import pyarrow as pa
    met = []
    whole = divergence.quotient
    monkeypatch.setattr(divergence, "quotient", lambda p, q: (met.append(len(p)), whole(p, q))[1])
    rows = [("en", [0, 1, 2], [5, 6, 7], [1, 1, 1], 10), ("en", [0, 1, 2], [5, 6, 8], [1, 1, 1], 3), ("en", [0, 1, 3], [5, 6, 9], [1, 1, 1], 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "sid", "p", "zero", "terms"])
    out = list(divergence.tree_corrections([batch]))
    assert met[0] == 2 + 2 + 2 + 1         # three leaves with two ancestors, one shared node with one
    got = {(s, o): v for b in out for s, o, v in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))}
    g = lambda p, q: (p - q) ** 2 // q - (p - 1) ** 2 - (1 - q) ** 2 // q      # noqa: E731
    assert got[1, 0] == 14 * g(6, 5) and got[0, 1] == 14 * g(5, 6) and got[2, 1] == 10 * g(7, 6) + 3 * g(8, 6)
    assert np.all([k in got for k in ((3, 0), (0, 3), (3, 1))])
