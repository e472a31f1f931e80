"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element in page order. A line's
weight is the length of its own text; lines of menus, forms, sidebars, adverts
and the like weigh nothing. Where a page marks its article, the lines inside weigh
MARK more and those outside nothing. The block at a line is the sum of weights
over a sliding window of WINDOW lines. Text surges where a block reaches SURGE and
dives where the block falls to nothing; the lines with weight between a surge and
its dive are kept; if nothing surges, the heaviest run is kept. So short lines
count where a window joins them to long ones, and a mark is worth a surge.

Defined cases: null or empty html, or html without main text, gives an empty
text; character references are decoded; white space, line ends and <br> inside a
block become one space; a < that begins no tag is text; comments and scripts end
where the first of them to open ends; unclosed elements end with their container
or the page, unclosed or self-closed ones that would be set aside at their own
tag; after a quote that never closes, tags end at the first >; repeated rows each
get their text; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import table

WINDOW = 3
SURGE = 80
MARK = SURGE
LINKED = 0.5  # share of a line's text inside links from which it is a menu line

#: Fixed values of HTML.
SIDE = frozenset("nav footer aside form menu dialog noscript template svg math object canvas select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names for what stands beside an article; those in SURE say so anywhere in a name outside articles.
SURE = frozenset("ads adsense advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead disqus cookie cookies consent gdpr newsletter pagination pager copyright".split())
SIDE_WORDS = SURE | frozenset("ad banner promo promos promotion side header comment comments commentlist respond notice alert popup modal overlay subscribe signup share sharing social related recommended widget widgets toolbar skip".split())
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
#: Words that add nothing to such a name: comment-list, share-buttons, site-header.
PLAIN = frozenset("list box wrap wrapper container area section block bar button buttons link links post posts form inner outer slot unit item items panel group row col column site page global main top bottom left right primary secondary sticky fixed mobile desktop icon icons text body title".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())

#: Comments, declarations and raw text as a whole, else a tag; whichever opens first.
_NEXT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style|title|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)"
_QUOTED = re.compile(_NEXT + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_PLAIN = re.compile(_NEXT + r"([^>]*+)>", re.S | re.I)
_OPENS = re.compile(r"<(?=/?[a-z])", re.I)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)


#: What a class says its element has beside it, not what it is: with-sidebar, no-ads.
_WITHOUT = re.compile(r"\b(?:with|has|have|no|not|is|without)[-_]\S+", re.I)


def _beside(name: str, in_article: bool) -> bool:
    """Whether a class or id says that its element stands beside the article: all words of the name do, or add nothing; outside articles one sure word is enough."""
    parts = [p for p in re.split(r"[-_\d]+", name.lower()) if p]
    said = SIDE_WORDS - {"header"} if in_article else SIDE_WORDS
    if not in_article and any(p in SURE for p in parts):
        return True
    return any(p in said for p in parts) and all(p in said or p in PLAIN for p in parts)


def _aside(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SIDE or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in _NAMES.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.lower() in SIDE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag != "header":
            names = _WITHOUT.sub("", value).split()
            # an article is set aside only as a reader's comment
            if any(n.lower() in COMMENTS for n in names) if tag == "article" else any(_beside(n, in_article) for n in names):
                return True
    return False


def tokens(page: str) -> list[tuple[str, str, str | None, str]]:
    """(text before, / of a closing tag, tag, attributes) in page order; comments have the tag "", raw text "#raw"; the rest of the page has None."""
    out, at, pattern = [], 0, _QUOTED
    while True:
        m = pattern.search(page, at)
        if pattern is _QUOTED:
            # A tag that stands before the match has a quote that never closes.
            left = _OPENS.search(page, at, m.start() if m else len(page))
            if left and page.find(">", left.start()) >= 0:
                pattern = _PLAIN
                continue
        if not m:
            out.append((page[at:], "", None, ""))
            return out
        out.append((page[at : m.start()], m[2] or "", "#raw" if m[1] else (m[3] or "").lower(), m[4] or ""))
        at = m.end()


def lines(page: str) -> tuple[list[tuple[str, int]], bool]:
    """(text, weight) of each block in page order, and whether an article is marked."""
    out: list[tuple[str, bool, bool, int]] = []  # text, set aside, inside the article, characters in links
    part: list[str] = []
    linked = link = 0
    side, depth = "", 0  # the element that is set aside and how often it is open
    unclosed = False  # whether it never closes, so that it ends where an article begins
    article = 0
    marked = False
    found = tokens(page)
    last_close = {tag: i for i, (_, closing, tag, _) in enumerate(found) if closing}

    def end() -> None:
        nonlocal part, linked
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            if text:
                out.append((text, bool(side), article > 0, linked))
        part, linked = [], 0

    for i, (piece, closing, tag, attributes) in enumerate(found):
        if piece:
            part.append(piece)
            if link:
                linked += len(piece.strip())
        if tag is None:
            break
        if tag == "":
            continue
        if tag in ("br", "#raw"):
            part.append(" ")
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in BLOCKS:
            end()
            link = 0 if tag != "li" else link
        if side and unclosed and tag in ("article", "main"):
            side, depth, unclosed = "", 0, False
        if side:
            if tag == side and not attributes.endswith("/"):
                depth += -1 if closing else 1
                if depth <= 0:
                    end()
                    side, depth = "", 0
        elif not closing and tag not in VOID and not attributes.endswith("/") and _aside(tag, attributes, article > 0):
            unclosed = last_close.get(tag, -1) < i
            if not unclosed or tag in BLOCKS:
                end()
                side, depth = tag, 1
        elif tag in ("article", "main"):
            article = max(0, article - 1) if closing else article + 1
            marked = True
    end()
    marked = marked and any(inside and not aside for _, aside, inside, _ in out)
    weighed = []
    for text, aside, inside, in_links in out:
        if aside or marked and not inside or not marked and in_links >= LINKED * len(text):
            weighed.append((text, 0))
        else:
            weighed.append((text, len(text) + MARK * inside))
    return weighed, marked


def main_text(page: str) -> str:
    found, _ = lines(page)
    weights = [w for _, w in found]
    blocks = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    runs: list[tuple[int, int, bool]] = []  # first line, line after the last, whether it surges
    start = None
    for i, block in enumerate([*blocks, 0]):
        if block and start is None:
            start = i
        elif not block and start is not None:
            runs.append((start, i, max(blocks[start:i]) >= SURGE))
            start = None
    kept = [r for r in runs if r[2]] or sorted(runs, key=lambda r: (-sum(weights[r[0] : r[1]]), r[0]))[:1]
    return "\n".join(found[i][0] for a, b, _ in kept for i in range(a, b) if found[i][1])


@arrow_udf(T.StringType())
def main_text_udf(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of the whole html."""
    return pages.withColumn(out_col, main_text_udf(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
