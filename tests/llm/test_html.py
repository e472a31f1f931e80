import html
import re
import time

from reckoner.llm import html as H


def plain(page):
    """The article of the given tables' pages, read with their one layout in mind."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " , re.sub("</?b>", "", x))).split()) for x in parts]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    rows = H.op3_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


LONG = "A sentence of the story that goes on for quite a while, with commas, and ends here. " * 2


def test_layouts():
    page = f"""<html><head><title>T</title></head><body><div id="header">Site name</div><div class="top menu"><a href=1>One</a></div>
    <div class="content"><h2>Head &amp; line</h2><p>{LONG}<br>next&nbsp;line</p><p>Short.</p><div class="share">Share this now</div><p>{LONG}</p></div>
    <div class="comments"><p>{LONG} says a reader</p></div><form><p>{LONG}</p></form><div>Copyright</div><footer>End</footer></body></html>"""
    want = ["Head & line", f"{LONG.strip()} next line", "Short.", LONG.strip()]
    got = H.main_text(page).split("\n")
    assert got[:4] == want and "reader" not in got[-1]
    page = f"<body><aside>{LONG}</aside><main><header><h1>Title</h1></header><p>One &lt;b&gt; two<section class='comment-list'><p>no</p></section></main><p>{LONG}</p>"
    assert H.main_text(page) == "Title\nOne <b> two"
    page = f"<article><h1>Title</h1><p>Text</p></article><aside><article><p>{LONG}</p></article></aside><section id='comments'><article class='comment'><p>{LONG}</p></article></section><article class='comment'><p>{LONG}</p></article>"
    assert H.main_text(page) == "Title\nText"
    page = f"<div class='page with-sidebar'><div class='entry'><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><div role='alert'>{LONG}</div></div>"
    assert H.main_text(page) == LONG.strip()
    page = f"<nav><ul><li>open menu<article><p>Body text</p></article>"
    assert H.main_text(page) == "Body text"


def test_names_are_judged_as_wholes():
    assert H.main_text("<article class='post comments-open'><p>Story</p></article><div>x</div>") == "Story"
    assert H.main_text("<article><header class='entry-header'><h1>Title</h1></header><p>Text</p></article>") == "Title\nText"
    assert H.main_text("<article><header class='header'><h1>Title</h1></header><p>Text</p></article>") == "Title\nText"
    assert H.main_text("<article><p class='social-history'>One</p><div class='side-by-side'>Two</div><div class='related-work no-comments'>Three</div></article>") == "One\nTwo\nThree"
    for name in ("comments", "comment-list", "share-buttons", "social", "ad-slot-3", "related_posts", "newsletter-form", "notice", "widget-area"):
        assert H.main_text(f"<article><p>Story</p><div class='x {name}'>beside</div></article>") == "Story"
    for name in ("site-footer", "global-nav", "cookie-banner", "td-menu-wrap", "header", "comments"):
        assert H.main_text(f"<div class='entry'><p>{LONG}</p></div><div id='{name}'>{LONG} beside</div>") == LONG.strip()
    assert H.main_text(f"<div class='post comments-open'><p>{LONG}</p></div>") == LONG.strip()


def test_cases(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<nav>a</nav>", "x"), (4, "u", "plain words", "x"), (5, "u", "<article>" + "<p>w" * 50_000, "x"), (4, "u", "plain words", "x"), (6, "u", "<script>var a='<p>no</p>'", "x")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in H.extract(pages).collect()]
    assert sorted(got)[:6] == [(1, ""), (2, ""), (3, ""), (4, "plain words"), (4, "plain words"), (5, "\n".join(["w"] * 50_000))]
    assert sorted(got)[6] == (6, "")
    assert H.extract(pages.limit(0)).collect() == []


def test_no_text_is_lost():
    assert H.main_text("<article><p>x < y and more text here") == "x < y and more text here"
    assert H.main_text("<p>first</p>tail a < b tail words") == "first\ntail a < b tail words"
    assert H.main_text('<script>var s="<!--";</script><article><p>Body text</p></article>') == "Body text"
    assert H.main_text("<!-- <script> --><article><p>Body</p><script>a='</p><p>x'</script><p>End</p></article>") == "Body\nEnd"
    assert H.main_text("<article><p>One <svg/> two</p><p>Three <button> four</p></article>") == "One two\nThree four"
    assert H.main_text("<article><p title=\"x > y\">a</p><p title=\"open>b</p><p>c</p></article>").endswith("b\nc")
    assert H.main_text("<article><p>a</p><svg><text>no</text></svg><p>b <!-- c --> d</p></article>") == "a\nb d"


def test_windows_decide(monkeypatch):
    """On pages without a marked article, surges and dives choose the lines."""
    menu = "".join(f"<div><a href='/{i}'>menu {i}</a></div>" for i in range(2))
    page = f"<body><div>Site</div>{menu * 2}<p>{LONG}</p>{menu}<p>Short.</p>{menu * 2}<p>Tiny.</p></body>"
    assert H.main_text(page) == f"{LONG.strip()}\nShort."
    monkeypatch.setattr(H, "WINDOW", 1)
    assert H.main_text(page) == LONG.strip()
    monkeypatch.setattr(H, "WINDOW", 5)
    assert H.main_text(page) == f"Site\n{LONG.strip()}\nShort.\nTiny."
    monkeypatch.setattr(H, "WINDOW", 3)
    monkeypatch.setattr(H, "SURGE", 3)
    assert H.main_text(page) == f"Site\n{LONG.strip()}\nShort.\nTiny."


def test_large_pages_take_linear_time():
    for unit in ("<a title=\"x>word ", "<nav>menu ", "<p>word < ", "<select>x "):
        start = time.monotonic()
        H.main_text(unit * (5_000_000 // len(unit)))
        assert time.monotonic() - start < 30
