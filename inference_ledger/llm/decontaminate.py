"""Operator 4: benchmark decontamination with item-sized windows (DataFrame functions only).

A document is contaminated by an item if a window of it, as many five-word shingles long as
the item (the whole document, if that is shorter), has a weighted (multiset) Jaccard
similarity of shingles of at least ``similarity`` with it.

1. Windows. Words that no item holds rule out most places: of each document, those windows of an
   item's size remain that hold as many shingles of any items of that size as the similarity
   asks of one item. No item stands in the key, and no window of the similarity is lost.
2. Fingerprints. A repeated shingle is numbered by its occurrence, so that a window is a set whose
   Jaccard similarity is the weighted one. Its SimHash is looked up in a multi-index of the items
   of that size: two fingerprints within ``RADIUS`` bits differ by at most ``RADIUS // BLOCKS`` bits
   in one of ``BLOCKS`` blocks, and the items stand in the index under every block value so
   near. All items within the radius are found, and the distance is checked.
3. The exact weighted similarity of the shingles' words decides.

A radius bounds fingerprints, not similarities. At a similarity of just 0.8 the distance of two sets is
10 bits on average and 12 for the shortest items (five shingles, of which four are shared);
README has the measured share beyond the radius. ``exact=True`` finds the windows of
every item by a join of shingles instead, without fingerprints, and loses nothing at any similarity.

Words are maximal runs of letters and digits of the lower-cased text. Fewer than five words
make one shingle; none, no shingle. The items' shingles and index are broadcast only if they
have at most ``BROADCAST_ROWS`` rows, else the joins shuffle.

Cases: null and empty texts match nothing. Rows with equal doc_id and text give the result once; rows with
null doc_id take part. Equal items each match. Of equally similar windows the first
counts. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BROADCAST_ROWS = 1_000_000

WORDS = r"array_remove(split(lower(text), '[^\\p{L}\\p{N}]+'), '')"
_FIVE = "xxhash64(" + ", ".join(f"word_hashes[i + {k}]" for k in range(SHINGLE)) + ")"
_ALL = "coalesce(aggregate(word_hashes, 0L, (a, h) -> xxhash64(a, h)), 0L)"
HASHES = f"""CASE WHEN size(word_hashes) = 0 THEN array()
    WHEN size(word_hashes) < {SHINGLE} THEN array({_ALL})
    ELSE transform(sequence(0, size(word_hashes) - {SHINGLE}), i -> {_FIVE}) END"""
STRINGS = f"""CASE WHEN size(words) < {SHINGLE} THEN array(array_join(words, ' '))
    ELSE transform(sequence(0, size(words) - {SHINGLE}), i -> array_join(slice(words, i + 1, {SHINGLE}), ' ')) END"""
#: repeated shingles numbered: the second 'a' is 'a #1' (a shingle's words hold no '#')
NUMBERED = """CASE WHEN size(array_distinct(strings)) = size(strings) THEN strings
    ELSE transform(strings, (s, i) -> IF(array_position(strings, s) = i + 1, s,
        concat(s, ' #', size(filter(slice(strings, 1, i), y -> y = s))))) END"""

def simhash(shingles: str) -> str:
    """SQL expression: a bit is set if over half of the shingle hashes set it."""
    return f"""aggregate(sequence(0, 63), 0L, (fp, b) -> fp | IF(
        2 * size(filter({shingles}, h -> shiftrightunsigned(h, b) & 1L = 1L)) > size({shingles}),
        shiftleft(1L, b), 0L))"""


def _word_hashes(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the hashes of text's words."""
    return df.select(*keep, F.expr(f"transform({WORDS}, w -> xxhash64(w))").alias("word_hashes"))


def _exploded(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (shingles of the text), at, hash: a row for each shingle. Its hash is taken behind the
    explode, in compiled code, from the words' hashes: a lambda over all places of a text leaves some hundred bytes
    of boxed numbers a word to the garbage collector. The lambda of short texts stands in a projection of its own, since
    one that holds a lambda is not compiled. The outer explode keeps the planner from testing the array
    for emptiness below the projection that builds it, where each inner reference would compute it again."""
    short = f"IF(size(word_hashes) < {SHINGLE}, {_ALL}, 0L)"
    return (_word_hashes(docs, "doc_id", "text_hash")
            .select("doc_id", "text_hash", "word_hashes", F.expr(short).alias("short"))
            .select("doc_id", "text_hash", "word_hashes", "short", F.posexplode_outer("word_hashes").alias("i", "word"))
            .withColumn("n", F.expr(f"greatest(size(word_hashes) - {SHINGLE - 1}, least(size(word_hashes), 1))"))
            .filter("i < n")
            .select("doc_id", "text_hash", "n", F.col("i").alias("at"),
                    F.expr(f"IF(size(word_hashes) < {SHINGLE}, short, {_FIVE})").alias("hash")))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("text_hash", F.xxhash64("text"))


def _set_of(df: DataFrame) -> DataFrame:
    """With ``shingles``, the numbered shingles of ``words``, and their SimHash ``fp``."""
    return (df.withColumn("strings", F.expr(STRINGS)).withColumn("shingles", F.expr(NUMBERED)).drop("strings")
            .withColumn("element_hashes", F.expr("transform(shingles, s -> xxhash64(s))"))
            .withColumn("fp", F.expr(simhash("element_hashes"))).drop("element_hashes"))


def _starts(docs: DataFrame, shingles: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """doc_id, text_hash, the key, width and the starts of all windows that hold as many of the key's shingles
    as the similarity needs."""
    need = f"CAST(ceil({similarity} * (size + width) / (1 + {similarity}) - 1e-9) AS INT)"
    return (_exploded(docs)
            .join(shingles, "hash")
            .groupBy("doc_id", "text_hash", "n", *key)
            .agg(F.sort_array(F.collect_set("at")).alias("hits"))
            .withColumn("width", F.least("size", "n")).withColumn("need", F.expr(need))
            .filter("size(hits) >= need")
            .withColumn("starts", F.expr("""array_distinct(flatten(transform(
                filter(sequence(0, size(hits) - need), k -> hits[k + need - 1] - hits[k] < width),
                k -> sequence(greatest(hits[k + need - 1] - width + 1, 0), least(hits[k], n - width)))))"""))
            .filter("size(starts) > 0").select("doc_id", "text_hash", *key, "width", "starts"))


def _within_radius(prints: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """size, fp, item, distance of all items of that size whose fingerprint differs by ``RADIUS`` bits at most."""
    bits, flips = 64 // BLOCKS, RADIUS // BLOCKS
    block = f"shiftrightunsigned({{}}, {bits} * {{}}) & {2 ** bits - 1}L"
    near = f"filter(sequence(0, {2 ** bits - 1}), m -> bit_count(m) <= {flips})"
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index = (items.select("item", "size", F.col("fp").alias("item_fp"), blocks)
             .withColumn("mask", F.explode(F.expr(near)))
             .selectExpr("item", "size", "item_fp", "block", f"({block.format('item_fp', 'block')}) ^ mask AS value"))
    masks = sum(1 for m in range(2 ** bits) if m.bit_count() <= flips)
    index = F.broadcast(index) if n_items * BLOCKS * masks <= BROADCAST_ROWS else index
    first = block.format("fp ^ item_fp", "b")
    return (prints.select("size", "fp", blocks)
            .selectExpr("size", "fp", "block", f"{block.format('fp', 'block')} AS value")
            .join(index, ["size", "block", "value"])
            .withColumn("distance", F.expr("bit_count(fp ^ item_fp)")).filter(F.col("distance") <= RADIUS)
            # a pair that agrees in several blocks counts in the first of them
            .filter(f"block = element_at(filter(sequence(0, {BLOCKS - 1}), b -> bit_count({first}) <= {flips}), 1)")
            .select("size", "fp", "item", "distance"))


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame,
                  similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """doc_id, text_hash, item_id, first_word, n_words, distance, similarity of the most
    similar window of each contaminated (document, item). ``exact``: see the module."""
    def written(df: DataFrame, name: str) -> DataFrame:
        folder = scratch_path(spark, name)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    docs = _documents(docs)
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct() \
        .withColumn("item", F.xxhash64("item_id", "text"))
    items = (_word_hashes(items, "item_id", "item", "text")
             .select("item_id", "item", "text", F.expr(HASHES).alias("hashes")).filter("size(hashes) > 0")
             .select("item_id", "item", F.size("hashes").alias("size"), "hashes", F.expr(WORDS).alias("words")))
    items = written(_set_of(items).drop("words"), "benchmark-items")

    # 1. windows; docs without any are not read again
    key = ["item", "size"] if exact else ["size"]
    shingles = written(items.select("item", "size", F.explode("hashes").alias("hash"))
                       .select(*key, "hash").distinct(), "benchmark-shingles")
    starts = written(_starts(docs, _few(shingles), key, similarity), "benchmark-starts")
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.text_hash == b.text_hash)
    marked = starts.select("doc_id", "text_hash").distinct()
    marked = F.broadcast(marked) if starts.count() <= BROADCAST_ROWS else marked
    found = docs.join(marked, same(docs, marked), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    # texts move as texts (their words as an array take several times the room), and each window's row holds its own words only
    cut = (found.join(starts, same(found, starts))
           .select(found.doc_id, found.text_hash, *key, "width", "starts", F.expr(WORDS).alias("words"))
           .select("doc_id", "text_hash", *key, "width", "words", F.explode("starts").alias("first"))
           .withColumn("words", F.expr(f"slice(words, first + 1, width + {SHINGLE - 1})")).drop("width"))
    windows = _set_of(cut.withColumn("n_words", F.size("words"))).drop("words")

    # 2. items within the radius of each different fingerprint
    near = items.select("item_id", "item", F.col("fp").alias("item_fp"), F.col("shingles").alias("item_shingles"))
    if exact:
        pairs = windows.join(near, "item").withColumn("distance", F.expr("bit_count(fp ^ item_fp)"))
    else:
        windows = written(windows, "benchmark-windows")
        hits = written(_within_radius(windows.select("size", "fp").distinct(), items, items.count()), "benchmark-hits")
        pairs = windows.join(_few(hits), ["size", "fp"]).join(near, "item")

    # 3. exact similarity of every candidate
    both = (pairs.withColumn("common", F.expr("size(array_intersect(shingles, item_shingles))"))
            .withColumn("similarity", F.expr("common / (size(shingles) + size(item_shingles) - common)"))
            .filter(F.col("similarity") >= similarity))
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "first", "n_words", "distance")).alias("best")
    return both.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", F.col("best.first").cast("long").alias("first_word"),
        F.col("best.n_words").cast("long").alias("n_words"), F.col("best.distance").cast("int").alias("distance"),
        (-F.col("best.less")).alias("similarity"))


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that no item contaminates."""
    found = contamination(spark, docs, items)
    folder = scratch_path(spark, "contaminated")
    found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct().write.parquet(folder)
    bad = spark.read.parquet(folder)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    # the columns travel in one struct, so that none can clash with the keys
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad_id"))
                     & (F.xxhash64(F.col("row.text").cast("string")) == F.col("bad_hash")), "left_anti").select("row.*")
