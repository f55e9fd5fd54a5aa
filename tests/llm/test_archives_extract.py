"""Operators 3 (round trip) and 5 (pages with every kind of boilerplate)."""

import base64
import hashlib
import html
import re

import pytest

from inference_ledger.llm import archives, extract, queries
from inference_ledger.session import scratch_path

from .conftest import SF


def expected(rows, least=0):
    groups = {}
    for page, _, text in rows:
        groups.setdefault((text or "").encode(), []).append(page)
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        top = max((p for p in groups[data] if p is not None), default=None)
        revisit = len(data) >= least and top is not None and (page is None or page < top)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_op3_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert digests(queries.op3_archives(spark, SF)) == expected(rows)


@pytest.mark.parametrize("least", [0, 2])
def test_op3_odd_rows(spark, least):
    big = "é" * 100_000
    rows = [(1, "u", "a"), (2, None, "a"), (3, "u", "b"), (3, "u", "b"), (None, "x", "b"), (None, "y", None), (4, "u", ""),
            (5, "u v\nw", big), (5, "q", big), (6, "w", big), (None, None, "zz"), (8, "", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS answer")
    folder = scratch_path(spark, "test-archives")
    archives.write_archives(df, folder, least)
    got = archives.read_archives(spark, folder)
    assert digests(got) == expected(rows, least)
    payloads = {(r.page_id, r.payload) for r in got.collect() if r.record_type == "response"}
    assert {(p, (t or "").encode()) for p, _, t in rows if p in (6, 8)} <= payloads
    assert archives.archive_digest(spark, df.limit(0)).count() == 0


def test_reader_checks_records():
    import zstandard
    good = archives.build_record(7, "http://a.example/", b"<p>x</p>", None, False)
    fields, block = archives.parse_record(good)
    assert block == b"<p>x</p>" and fields["WARC-Type"] == "response"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"<p>x", b"<p>y"),
                good.replace(b"Content-Length: 8", b"Content-Length: 9"), good.replace(b"WARC-Date", b"Date"),
                good.replace(b"\r\n\r\n", b"", 1)):
        with pytest.raises(ValueError):
            archives.parse_record(bad)
    frame, trained = archives.dictionary_frame([good.replace(b"x", str(i).encode() * 9) for i in range(500)])
    data = frame + zstandard.ZstdCompressor(dict_data=trained).compress(good) + archives.SEPARATOR
    assert trained and list(archives.frames(data)) == [good]
    with pytest.raises(ValueError):
        list(archives.frames(data[:-20]))


def test_op5_on_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op5_extract(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", pages[r.page_id].html)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = ("The {} paragraph of the article is long and it has many words in it, so that it is seen as good by the rules of "
        "the two passes in the method, is it not.")
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="no-sidebar">
<header><h1>Site</h1><p>{LONG.format('site')}</p></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div id="cookie-notice">{LONG.format('cookie')}</div>
<main><article><header><h1>Title &amp; more</h1></header><p>{LONG.format('first')}<p>Short.</p>
<form><label>Name</label><p>{LONG.format('form')}</p></form><div class="ad">Buy</div><script>if (a < b) "</p>"</script>
<p>{LONG.format('second')}<br>and&nbsp;on</p><section class="comments"><p>{LONG.format('comment')}</p></section>
</article></main><aside>{LONG.format('side')}</aside><p><a href=y>{LONG.format('linked')}</a></p><footer>&copy; x</footer>"""


def test_op5_boilerplate():
    assert extract.main_text(PAGE) == "\n\n".join(
        ["Title & more", LONG.format("first"), "Short.", LONG.format("second") + " and on"])
    plain = f"<div class=menu><a href=a>A</a></div><div>{LONG.format('first')}</div><div>Of it.</div><div>{LONG.format('last')}"
    assert extract.main_text(plain) == "\n\n".join([LONG.format("first"), LONG.format("last")]) or \
        extract.main_text(plain) == "\n\n".join([LONG.format("first"), "Of it.", LONG.format("last")])
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<p>" * 2000, "a" * 300_000):
        extract.main_text(odd)


TWO = f"<article><h1>T</h1><p>{LONG.format('a')}</p><p>{LONG.format('b')}</p></article>"
BOTH = "\n\n".join(["T", LONG.format("a"), LONG.format("b")])


@pytest.mark.parametrize("wrapper", [
    '<form action=x><input name=q>{}</form>', '<form><p>Search</p>{}</form>', '<div class="layout with-sidebar">{}</div>',
    '<div class="single-post comments-open">{}</div>', '<section class="no-sidebar">{}</section>', '<div class="search-results">{}</div>',
    '<div class="sidebar">{}</div>', '<div class="content has-sidebar"><div class="sidebar"><p>Menu</p></div>{}</div>',
    '<a name=x>{}', '<aside><article class="teaser">Read on</article></aside>{}'])
def test_a_wrapper_does_not_drop_the_article(wrapper):
    assert extract.main_text("<body>" + wrapper.format(TWO) + "<footer>F</footer>") == BOTH


def test_parts_within_an_article_are_dropped_still():
    inner = TWO.replace("</h1>", f"</h1><div class=sidebar><p>{LONG.format('s')}</p></div><form><p>{LONG.format('f')}</p></form>")
    comments = f"<div class=comments><p>{LONG.format('c')}</p><p>{LONG.format('d')}</p><p>{LONG.format('e')}</p></div>"
    assert extract.main_text(inner + comments) == BOTH
    assert extract.main_text(f"<div style='display:none'>{TWO}</div>") == ""


def test_a_link_ends_with_its_block_and_needs_a_target():
    assert extract.main_text(f"<p><a name=x>{LONG.format('a')}</p><p>{LONG.format('b')}</p>") == "\n\n".join(BOTH.split("\n\n")[1:])
    assert extract.main_text(f"<p><a href=x>More</p><p>{LONG.format('a')}</p><p>{LONG.format('b')}</p>").endswith("\n\n".join(BOTH.split("\n\n")[1:]))
    assert extract.main_text(f"<a href=x><div>{LONG.format('a')}</div></a><a href=y><div>{LONG.format('b')}</div></a>") == ""


# a long paragraph of the writers' own in five scripts; pages without article element
SCRIPTS = [
    "Каждое утро дворник сметает листья у старой мельницы, и каждое утро ветер приносит новые. Он не сердится. Он говорит, что без листьев двор был бы совсем пуст, а метла скучала бы в сарае.",
    "每天早上看门人都把老磨坊门前的落叶扫成一堆，可是每天早上风又吹来新的叶子。他从不生气。他说没有落叶的院子太空了，扫帚放在棚子里也会寂寞的。孩子们喜欢听他讲这些话。",
    "كل صباح يكنس الحارس أوراق الشجر أمام الطاحونة القديمة، وكل صباح تحمل الريح أوراقا جديدة. لا يغضب أبدا. يقول إن الساحة بلا أوراق تكون فارغة جدا، وإن المكنسة تشتاق إلى العمل؟",
    "Κάθε πρωί ο φύλακας σκουπίζει τα φύλλα μπροστά στον παλιό μύλο, και κάθε πρωί ο αέρας φέρνει καινούρια. Δεν θυμώνει ποτέ. Λέει πως χωρίς φύλλα η αυλή θα ήταν άδεια και η σκούπα θα βαριόταν.",
    "हर सुबह चौकीदार पुरानी चक्की के सामने पत्ते झाड़ता है, और हर सुबह हवा नए पत्ते ले आती है। वह कभी नाराज़ नहीं होता। वह कहता है कि पत्तों के बिना आँगन बहुत सूना होता और झाड़ू भी ऊब जाती।",
]


@pytest.mark.parametrize("text", SCRIPTS)
def test_pages_without_article_in_other_scripts(text):
    page = (f"<html><body><div class=menu><a href=a>1</a> <a href=b>2</a></div><div><p>{text}</p><p>{text[::-1][:5]}{text}</p></div>"
            f"<div class=footer><p>{text}</p></div><ul><li><a href=c>{text}</a></ul></body>")
    assert extract.main_text(page) == f"{text}\n\n{text[::-1][:5]}{text}"


@pytest.mark.parametrize("bit", ['<a "', "<a '", "<script", '<a ="', "<p x='", "<!--", "<", "</ ", "<a href=", '<a b="c" ', "<svg><p"])
def test_markup_is_read_in_linear_time(bit):
    import time
    start = time.perf_counter()
    extract.main_text(bit * 100_000)
    extract.main_text(bit * 100_000 + ">")
    assert time.perf_counter() - start < 5


def test_a_tag_that_never_ends_drops_the_rest_only():
    assert extract.main_text(TWO + '<p class="x') == BOTH
    assert extract.main_text('<p title="5" tall" class=y>' + TWO) == BOTH
    assert extract.main_text("1 < 2 " + TWO).endswith(BOTH)


def test_op5_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, PAGE), (None, None, PAGE), (2, "v", "")],
                               "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = [tuple(r) for r in extract.extract(df).collect()]
    assert len(got) == 4 and sum(x[3] > 0 for x in got) == 2
    assert extract.extract(df.limit(0)).count() == 0
