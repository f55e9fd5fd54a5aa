"""DuckDB SQL for the operators that SQL can express: each statement computes its result
plainly, over whole tables, without the operator's method."""

ARCHIVES = """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY sha, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(sha, 5 * (j // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) + 1, 1)
    FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM g"""

_SHINGLES = """
  SELECT {id}, len(w) AS n_words, greatest(len(w) - 4, 1) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS pos, w
  FROM (SELECT {id}, [x FOR x IN string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''] AS w FROM {table})
  WHERE len(w) > 0"""

CONTAMINATION = f"""
WITH d0 AS ({_SHINGLES.format(id='doc_id', table='documents')}),
ds AS (SELECT doc_id, n_words, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM d0),
i0 AS ({_SHINGLES.format(id='item_id', table='benchmark')}),
it AS (SELECT item_id, n AS size, array_to_string(w[pos + 1:pos + 5], ' ') AS s, count(*) AS c FROM i0 GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n_words, n, size, pos, least(n, size) AS width FROM ds JOIN it USING (s)),
starts AS (
  SELECT DISTINCT doc_id, item_id, n_words, size, width,
    unnest(range(greatest(pos - width + 1, 0), least(pos, n - width) + 1)) AS a FROM hits),
common AS (
  SELECT doc_id, item_id, n_words, size, width, a, sum(least(k, c)) AS common FROM (
    SELECT st.*, ds.s, it.c, count(*) AS k
    FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.pos BETWEEN st.a AND st.a + st.width - 1
    JOIN it ON it.item_id = st.item_id AND it.s = ds.s GROUP BY ALL) GROUP BY ALL),
scored AS (SELECT *, CAST(common AS DOUBLE) / CAST(width + size - common AS DOUBLE) AS similarity FROM common)
SELECT doc_id, item_id, CAST(a AS BIGINT) AS first_word, CAST(least(width + 4, n_words) AS BIGINT) AS n_words, similarity
FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) = 1"""

REPEATS = """
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1:i + 200]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM d)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM often)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span, i FROM m),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM s GROUP BY doc_id, span),
gaps AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS from_, lo AS to_ FROM spans),
tails AS (SELECT d.doc_id, n AS lo, coalesce(max(hi), 0) AS from_, n AS to_ FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, n),
kept AS (
  SELECT p.doc_id, string_agg(CASE WHEN to_ > from_ THEN hex(d.b[from_ + 1:to_]) ELSE '' END, '' ORDER BY lo) AS hx
  FROM (SELECT * FROM gaps UNION ALL SELECT * FROM tails) p JOIN d USING (doc_id) GROUP BY p.doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.hx, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op3_archives": ARCHIVES, "op4_decontaminate": CONTAMINATION, "op9_repeats": REPEATS}

ORACLE_SQL["op12_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p
  FROM grid WINDOW s AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS q
  FROM whole WINDOW s AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0) AS value
  FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM items)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""
