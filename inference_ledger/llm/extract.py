"""Operator 5: main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags; a block knows its text, the share of it
inside links, its stop-word density and the elements it stands in.

Pass one decides each block by itself: blocks in a part of the page that its element or
its class, id or role names as a menu, header, footer, sidebar, notice, advert, form or
reader comment are bad, and so are link lists; long blocks with stop words are good, and
in an article element long blocks are good anyway; short blocks stay open ("near good" if
they have stop words or stand in the article, else "short"). A name does not count on a wrapper: a part that
holds the page's main article, or, for names that also describe a page's layout and for forms, more
than half of the page's text outside links. On pages whose words are hardly ever in the
stop-word list (other languages), sentence marks take the place of stop words; a character of a script
without word gaps counts as three.
Pass two gives open blocks the label of the nearest decided neighbours: both good, good;
both bad, bad; different, good for near-good blocks only. The page's edges count as bad.
Open blocks of an article element with good blocks are good, and so are those of any article on a page
where no article has one.

The markup is read once from left to right: a tag that never ends drops the rest of the page, as browsers do.

Cases: null and empty pages give empty text. Markup cut off at the end is dropped, an unclosed block ends
with the page. Null page_id and url pass through; repeated rows are extracted each. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import texts

MAX_LINKS = 0.3                 # share of a block's characters inside links beyond which it is a link list
LONG, SHORT = 140, 60           # characters
STOPS_HIGH, STOPS_LOW = 0.30, 0.15

# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can for from had has have he her his i if in into is it its
more no not of on one or our she so that the their there they this to up was we were what when which who will
with would you your
aber als am an auch auf aus bei bin das dem den der des die durch ein eine einem einen einer er es für hat ich
im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden
wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on
ou par pas plus pour qu que qui sa se ses son sur ta te tu un une vous y à été
al como con de del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos o para pero por
que se si sin sobre su sus también te un una y ya
""".split())

BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main
menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
DROPPED = frozenset("""aside button datalist dialog fieldset footer form head label legend menu nav option select
textarea title""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# names of parts: those that say what a part is, and those that are also said of a whole page's layout
STRONG = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"topbar|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscri\w+|signup|login|comments?|"
    r"replies|respond|disqus|share|sharing|related|recommend\w*|pagination|pager|toolbar|skip|contentinfo)(?:$|[_-])", re.I)
WEAK = re.compile(r"(?:^|[_-])(?:sidebar|side|banner|overlay|social|widget|search|complementary|hidden)(?:$|[_-])", re.I)
# a name that says whether the page has such a part, not that this is one
LAYOUT = re.compile(r"^(?:no|non|with|without|has|have|is|layout)[_-]|[_-](?:open|closed|on|off|enabled|disabled|layout|results)$", re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
RAW = frozenset("script style noscript template svg math object iframe canvas audio video".split())
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
_HREF = re.compile(r"\bhref\b", re.I)
_SENTENCE = re.compile(r"[.!?…。！？؟।։።](?:\s|$|[^\w\s])|[。！？]")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(r"[^\W\d_]+")
# an open element of the key ends where one of these begins
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
             "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


class Part:
    """An element that its tag or its name marks as no main text. ``kind``: 1 by a name that layouts share or
    as a form, 2 by a name, 3 always. ``inside`` is the article that it stands in; ``text`` and ``articles`` are what
    stands in it."""
    __slots__ = ("kind", "inside", "text", "articles")

    def __init__(self, kind: int, inside: int):
        self.kind, self.inside, self.text, self.articles = kind, inside, 0, set()


class Block:
    __slots__ = ("text", "links", "parts", "bad", "article", "heading", "label")

    def __init__(self, text: str, links: int, parts: tuple, article: int, heading: bool):
        self.text, self.links, self.parts, self.article, self.heading = text, links, parts, article, heading
        self.bad, self.label = False, ""


def markup(page: str):
    """(text before, tag or None, whether it closes, attributes) of every tag, in one pass; at last the
    text behind the last tag."""
    at = look = 0
    while (m := _OPEN.search(page, look)) is not None:
        start = m.start()
        piece = page[at:start]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = look = len(page) if end < 0 else end + 3
            yield piece, None, False, ""
            continue
        tag = _TAG.match(page, start)
        if tag is None:
            if page[start + 1] in "!?" or (page[start + 1] == "/" and not page[start + 2:start + 3].isalpha()):
                end = page.find(">", start)
                at = look = len(page) if end < 0 else end + 1
                yield piece, None, False, ""
                continue
            yield piece, None, False, ""       # a tag that never ends
            return
        close, name, rest = tag[1], tag[2].lower(), tag[3]
        at = look = tag.end()
        if name in RAW and not close and not rest.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = look = len(page) if end is None else end.end()
            yield piece, None, False, ""
            continue
        yield piece, name, bool(close), rest
    yield page[at:], None, False, ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. ``article`` is the number of the article they stand in, or 0."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []         # open elements: tag, marked parts, article number
    parts: list[str] = []
    link = -1                                        # open elements when the link began
    links = articles = 0

    def end_block():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                within, article = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
                out.append(Block(text, min(links, len(text)), within, article, any(t[0] in _HEADINGS for t in stack[-2:])))
        parts, links = [], 0

    def opened(tag: str, kind: int):
        nonlocal articles
        within, article = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
        if kind:
            within = (*within, Part(kind, article))
        if tag in ("article", "main") and not article:
            articles += 1
            article = articles
        stack.append((tag, within, article))

    for piece, tag, close, rest in markup(page):
        if piece:
            parts.append(piece)
            if link >= 0:
                links += len(piece)
        if tag is None:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = -1 if close or not _HREF.search(rest) else len(stack)
        if tag not in BLOCKS:
            if tag not in VOID and not close and (kind := _marked(tag, rest)):
                end_block()
                opened(tag, kind)
            elif close and any(t[0] == tag for t in stack):
                end_block()
                _close(stack, tag)
        else:
            end_block()
            if tag in VOID:
                continue
            if close:
                _close(stack, tag)
            else:
                while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                within_article = bool(stack and stack[-1][2])
                kind = 3 if tag in DROPPED and tag not in WRAPPERS else 1 if tag in WRAPPERS else 0
                if tag == "header" and not within_article:
                    kind = 2
                opened(tag, max(kind, _marked(tag, rest)))
        if link > len(stack):                        # the element that the link began in has ended
            link = -1
    end_block()
    _weigh(out)
    return out


def _weigh(found: list[Block]) -> None:
    """Which blocks stand in a marked part; a part that wraps the page's main text does not count."""
    article_text: dict[int, int] = {}
    total = 0
    for b in found:
        size = len(b.text) - b.links
        total += size
        article_text[b.article] = article_text.get(b.article, 0) + size
        for p in b.parts:
            p.text += size
            p.articles.add(b.article)
    main, size = max(((a, n) for a, n in article_text.items() if a), key=lambda x: x[1], default=(0, 0))
    if size < LONG:
        main = 0

    def wraps(p: Part) -> bool:
        if main:
            return main in p.articles and p.inside != main
        return p.kind == 1 and 2 * p.text > total
    for b in found:
        b.bad = any(p.kind == 3 or not wraps(p) for p in b.parts)


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
WRAPPERS = frozenset(("form", "fieldset"))


def _marked(tag: str, rest: str) -> int:
    """Kind of part that an element's attributes name: 0 none, 1 or 2 by its class, id or role, 3 hidden."""
    if not rest.strip() or tag in ("html", "body", "main"):
        return 0
    if _HIDDEN.search(rest):
        return 3
    if tag == "article":
        return 0
    names = [x for a, b, c in _ATTRIBUTE.findall(rest) for x in (a or b or c).split() if not LAYOUT.search(x)]
    return 2 if any(map(STRONG.search, names)) else 1 if any(map(WEAK.search, names)) else 0


def _close(stack: list, tag: str) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return


def _width(text: str) -> int:
    return len(text) + 2 * len(_WIDE.findall(text))


def classify(found: list[Block]) -> None:
    """Both passes; sets ``label`` to good or bad."""
    words_of = [_WORD.findall(b.text.lower()) for b in found]
    stops_of = [sum(w in STOP_WORDS for w in words) for words in words_of]
    plain = [i for i, b in enumerate(found) if not b.bad and _width(b.text) >= SHORT]
    listed = sum(stops_of[i] for i in plain) >= STOPS_LOW / 2 * sum(len(words_of[i]) for i in plain)
    for i, b in enumerate(found):
        size = _width(b.text)
        if listed:
            stops = stops_of[i] / len(words_of[i]) if words_of[i] else 0.0
        else:                                       # a language without list
            stops = STOPS_HIGH if _SENTENCE.search(b.text) else 0.0
        if b.bad or b.links > MAX_LINKS * len(b.text):
            b.label = "bad"
        elif b.heading:
            b.label = "neargood" if b.article or size > SHORT else "short"
        elif size >= LONG and (stops >= STOPS_HIGH or b.article):
            b.label = "good"
        elif size >= SHORT and (stops >= STOPS_LOW or b.article):
            b.label = "neargood"
        elif size >= LONG:
            b.label = "bad"
        else:
            b.label = "neargood" if b.article or stops >= STOPS_HIGH else "short"
    first = [b.label for b in found]
    n = len(found)
    after, label = [""] * n, "bad"
    for i in range(n - 1, -1, -1):
        after[i] = label
        if first[i] in ("good", "bad"):
            label = first[i]
    good_articles = {b.article for b in found if b.article and b.label == "good"}
    before = "bad"
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            before = first[i]
            continue
        left, right = before, after[i]
        if left == right:
            b.label = left
        else:
            b.label = "good" if first[i] == "neargood" else "bad"
        if b.article and (b.article in good_articles or b.label == "bad" and not good_articles):
            b.label = "good"


def main_text(page: str | None) -> str:
    """Good blocks of a page, joined by blank lines."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch, column in texts(batches, "html"):
            got = [main_text(x) for x in column]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    # parsing costs far more than moving a page, and a file may be one split
    return rows.repartition(F.xxhash64("page_id", "url")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
