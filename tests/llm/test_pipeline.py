"""The corpus pipeline: stage order, columns, effect of each stage, odd rows, and results on the small table."""

import re
from collections import Counter

import corpus_pipeline
from inference_ledger.llm import queries

from .conftest import SF
from .test_decontaminate import brute as contaminated
from .test_near_dedup import least_reachable, simhash
from .test_repeats import brute as repeated
from .test_tokens import check_packing


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language identification", "near-duplicate removal", "repeated-substring removal",
                            "benchmark decontamination", "packing"]

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    def run(name, df):
        out = stages[name](spark, df, SF)
        if name != "packing":
            assert out.columns == columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        return out

    one = run("language identification", docs)
    assert rows(one) == rows(docs.filter("text RLIKE '\\\\p{L}'"))
    two = run("near-duplicate removal", one)
    had = rows(one)
    least = least_reachable([simhash(t) for _, t in had], [d for d, _ in had])
    assert rows(two) == [x for x, c in zip(had, least) if x[0] == c]
    three = run("repeated-substring removal", two)
    had = rows(two)
    for (d, t), (e, before), (_, removed, _, _) in zip(rows(three), had, repeated([t for _, t in had])):
        assert d == e and len(before.encode()) - removed - 6 <= len(t.encode()) <= len(before.encode()) - removed
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = run("benchmark decontamination", three)
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {d for d, _ in contaminated(rows(three), items)}
    assert rows(four) == [x for x in rows(three) if x[0] not in bad]
    check_packing(rows(four), run("packing", four).collect(), 2048)


def test_run_equals_the_stages(spark):
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))


def test_odd_rows(spark):
    text = "Hello World to all the people of the town"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, text, "en", None, 5), (3, text, "en", None, 5),
            (3, text.upper(), "en", None, 5), (None, text, None, None, None), (7, "Etwas anderes über alles", None, None, 1),
            (8, "é" * 500, "x", None, 1), (9, "é" * 500 + "q", "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", "1 AS fp", "1 AS did", "'x' AS row", "2 AS list", "'z' AS lang_pred", "3 AS bad_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        if name != "packing":
            assert out.columns == df.columns and not Counter(r.doc_id for r in got) - Counter(r[0] for r in rows)
        assert stage(spark, df.limit(0), SF).count() == 0


def test_nothing_else_imports_llm():
    from pathlib import Path
    root = Path(__file__).resolve().parents[2]
    for f in (root / "inference_ledger").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text().split('"""')[-1]) or "import" not in f.read_text().split("llm")[0][-20:]
