import html as entities
import re

from shelfmark.llm import html_text as h
from shelfmark.llm.base import QUERIES

SCHEMA = "page_id long, url string, html string, text string"

BLOG = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><div>";</script><style>p{}</style></head>
<body class="has-sidebar menu-open"><header class="site"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
<div class="cookie-notice">We use cookies a lot, accept all of them please</div>
<div id="wrap"><div class="post-%d content"><header><h1>The&nbsp;title</h1><p>by me</p></header>
<p>First <b>bold</b>
  text &amp; more.<p>Second<br>line &lt;tag&gt; &#233;<ul><li>one<li>two</ul><div class="ad">Buy now</div>
<form><p>Your mail</p><input></form><table><tr><td>a<td>b</table><blockquote>Quoted</blockquote></div>
<div class="sidebar"><p>%s</p></div><section id="comments"><p>%s</p></section></div>
<footer>&copy; me</footer><!-- <p>hidden</p> --></body></html>"""
BLOG_TEXT = "First bold text & more.\nSecond line <tag> é\none\ntwo\na\nb\nQuoted"


def test_boilerplate_blocks_and_entities(spark):
    pages = [(i, f"https://Blog.example.com:80/{i}", BLOG % (i, "side " * 90, "I say " * 200), "clash") for i in range(12)]
    short = "<body><div id=wrap><div class='post-77 content'><p>Short.</p></div><div class=other>" + "<p>longer filler text here</p>" * 9 + "</div></div>"
    pages.append((50, "http://user@blog.example.com/s", short, "clash"))
    out = {r.page_id: r for r in h.main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    for i in range(12):
        assert out[i].text == BLOG_TEXT.replace("First", "First", 1)
        assert out[i].n_chars == len(out[i].text)
    # Alone, this page would pick the filler; the host's path finds its article.
    assert out[50].text == "Short."
    alone = h.main_text(spark.createDataFrame([pages[-1]], SCHEMA)).collect()[0]
    assert alone.text.startswith("longer")


def test_article_head_keeps_titles():
    page = "<body><article><header><h1>Title</h1><p>by me, today</p></header><p>Body text.</p><footer>end</footer></article></body>"
    assert h.extract(page, []) == "Title\nBody text."


def test_names_of_wrappers_do_not_empty_the_page():
    body = "<h1>Title</h1><p>" + "The article itself. " * 10 + "</p>"
    text = "Title\n" + ("The article itself. " * 10).strip()
    around = "<div class=sidebar><p>" + "side text " * 8 + "</p></div>"
    for name in ("layout has-sidebar", "no-sidebar", "with-nav", "widget-content", "post share-enabled", "page--hasSidebar", "overflow-hidden", "sidebar"):
        for tag in ("article", "main", "div class=text"):
            page = f"<body><div class='{name}'><{tag}>{body}</{tag.split()[0]}>{around}</div><div class=legal>all rights</div></body>"
            assert h.extract(page, []) == text, (name, tag)
    # Nothing but named elements: the names do not count.
    assert h.extract("<body><div class=comments><p>Only this.</p></div></body>", []) == "Only this."
    # Other articles in a named list, and comments longer than the article, stay out.
    more = "<div class=related-posts><article><p>teaser</p></article></div><div class=comments><article><p>" + "I say " * 99 + "</p></article></div>"
    assert h.extract(f"<body><div>{body}{more}</div></body>", []) == text


def test_split_articles_are_whole(spark):
    lead, text, end = ("lead words " * 27).strip(), ("text words " * 91).strip(), ("last words " * 40).strip()
    split = f"<h1>T</h1><div class=lead>{lead}</div><div class=text>{text}</div>"
    whole = f"T\n{lead}\n{text}"
    for box in ("article", "main", "div class=post"):
        page = f"<body><div id=wrap><{box}>{split}</{box.split()[0]}><div class=more>other</div></div><div class=legal>{'all rights ' * 9}</div></body>"
        assert h.extract(page, []) == whole, box
    two = f"<section class=a><p>{text}</p></section><section class=b><p>{end}</p></section>"
    for box in ("body", "article", "main", "div class=post"):
        assert h.extract(f"<{box}>{two}</{box.split()[0]}>", []) == f"{text}\n{end}", box
    # The host's usual page has no lead: the pages with one are read whole too.
    plain = f"<body><div class=post><div class=text><h1>T</h1>{text}</div></div></body>"
    more = f"<body><div class=post>{split}</div></body>"
    rows = [(i, f"https://a.example/{i}", more if i < 4 else plain, "clash") for i in range(12)]
    out = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: whole if i < 4 else f"T\n{text}" for i in range(12)}


def test_broken_pages():
    assert h.extract("", []) == "" and h.extract("<", []) == "<" and h.extract("<div", []) == ""
    assert h.extract("just text &amp; no tags", []) == "just text & no tags"
    assert h.extract("<p>a<p>b<script>x", []) == "a\nb"
    assert h.extract("<p class=\"x>y\">a</p><p title='1>2'>b</p><p a=\"un>c</p>", []) == "a\nb\nc"
    assert h.extract("<!-- open <p>a", []) == "" and h.extract("<div></p></div></div>x", []) == "x"
    assert h.extract("a < b and 3<4 <p>c", []) == "a < b and 3<4\nc"
    assert h.extract("<article><p><b>One<br><p>Two</p></article><footer>f</footer>", []) == "One\nTwo"
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert h.extract(deep, []) == "text"
    assert len(h.extract("<article>" + "<p>word &eacute;</p>" * 50_000, [])) == 50_000 * 7 - 1


def test_edges(spark):
    assert h.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, None), (2, "", "", None), (None, "x", "<p>a", None), (None, "x", "<p>a", None)]
    out = h.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in out) == [(0, "x", "a"), (0, "x", "a"), (1, "", ""), (2, "", "")]


def test_query(spark):
    """Every page of the tables has one article, whose title and paragraphs are wanted."""
    where = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    out = QUERIES["op8_html_text"](spark, where).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|table|tr|td|div)\b[^>]*>|<br>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
