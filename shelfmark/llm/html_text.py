"""Main text of web pages by the consensus of their host.

Each page scores its containers by the text they hold and votes for the path of the best one: tags
and classes from the body down, with digits generalised. The best container stands for the article
around it, whose title and other sections may lie beside it. Spark counts the votes of each host. Every
page is then read again through the paths that won on its host; a page that has none of them
falls back on its own best container.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.base import or_empty, query, table

#: Share of a host's votes with which a path counts as one of its layouts (so ten at most).
LAYOUT_SHARE = 0.1
#: Pieces that the pages of a host are spread over while they meet its layouts.
SALTS = 32

# HTML's element kinds, and names that sites give to parts around the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map math menu nav noscript object option select style svg "
    "template textarea title video script".split()
)
#: Elements that an opening tag closes, and those beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
PARAGRAPH_ENDS = BLOCKS - {"caption", "dd", "dt", "html", "body", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SCOPE = frozenset("article aside body button div footer header html main section table td th".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense alert banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies "
    "dialog disqus discussion dropdown footer footnav gdpr hidden leaderboard login masthead menu menubar modal nav navbar navigation navi newsletter notice "
    "notification offcanvas overlay pager paginate pagination paywall popup promo promotion recommended related respond rail search share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Names whose text may exceed the article's own, and names of lists of other articles.
DISCUSSION = frozenset("captcha comment comments consent cookie cookies discussion disqus gdpr login respond".split())
ELSEWHERE = frozenset("promo promotion recommended related sponsor sponsored".split())
#: A class such as has-sidebar, no-nav or share-enabled speaks of the layout, not of the element.
MODIFIERS = frozenset("has no non not with without".split())
STATES = frozenset("closed disabled enabled off on open opened".split())
#: Share of a page's unlinked text above which an element counts whatever its name: where the name is a part of a class, and where it is all of one.
PART_SHARE, WHOLE_SHARE = 0.5, 0.8
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Unlinked text from this length on is prose; beside the best container, this share of its text makes a section of the article.
PROSE, SECTION_SHARE = 80, 0.1

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "parent", "left_out", "container", "score", "names", "whole", "chars")

    def __init__(self, tag: str, path: str, parent: Element | None, left_out: bool, container: Element | None):
        self.tag, self.path, self.parent, self.left_out, self.score = tag, path, parent, left_out, 0.0
        self.names, self.whole, self.chars = frozenset(), False, 0
        self.container = self if parent is None or tag in CONTAINERS else container


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def around_the_article(tag: str, values: dict[str, str]) -> bool:
    if tag in LEFT_OUT or "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    return values.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none", values.get("style", ""), re.IGNORECASE))


def names_around(tag: str, values: dict[str, str]) -> tuple[frozenset[str], bool]:
    """The names of parts around the article that an element has in its classes and id, and
    whether one of them is a whole class or id."""
    found, whole = frozenset(), False
    if tag in ("html", "body", "main"):
        return found, whole
    wanted = NAMES if tag != "article" else frozenset({"comment", "comments"})
    for token in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(_CAMEL.sub(" ", token))]
        if not words or words[-1] in STATES:
            continue
        words = words[: next((k for k, w in enumerate(words) if w in MODIFIERS), None)]
        if hit := wanted.intersection(words):
            found, whole = found | hit, whole or len(words) == 1
    return found, whole


def leave_out_named(elements: list[Element], blocks: list[tuple[str, Element, int]]) -> None:
    """Leave out the named elements, except those that hold the article: a main element, the
    largest article, or most of the page's unlinked text. Where nothing would be left, names do
    not count."""
    unlinked = [(max(0, len(text) - linked), e) for text, e, linked in blocks if not e.left_out]
    inherited: dict[int, frozenset[str]] = {}
    for e in elements:
        inherited[id(e)] = e.names | (inherited[id(e.parent)] if e.parent is not None else frozenset())
    total = sum(n for n, _ in unlinked)
    without = sum(n for n, e in unlinked if not inherited[id(e)] & DISCUSSION)
    outside = sum(n for n, e in unlinked if not inherited[id(e)])

    def add_up():
        for e in elements:
            e.chars = 0
        for n, e in unlinked:
            e.chars += n

    add_up()
    for e in reversed(elements):  # children before parents
        if e.parent is not None:
            e.parent.chars += e.chars
    whole = {id(e): e.chars for e in elements if e.names}
    articles = [e for e in elements if e.tag == "article" and not e.left_out and not inherited[id(e)] & DISCUSSION]
    largest = max(articles, key=lambda e: e.chars, default=None)
    article_chars = largest.chars if largest is not None else 0
    holds_main, holds_article = set(), set()
    for found, start in [(holds_main, e) for e in elements if e.tag == "main" and not e.left_out] + ([(holds_article, largest)] if article_chars else []):
        above = start
        while above is not None and id(above) not in found:
            found.add(id(above))
            above = above.parent
    add_up()
    named: set[int] = set()
    for e in reversed(elements):
        if e.names:
            holds = id(e) in holds_main
            if not e.names & DISCUSSION:
                sure = not e.whole and not e.names & ELSEWHERE
                holds = holds or id(e) in holds_article and (sure or article_chars > outside)
                holds = holds or e.chars > (WHOLE_SHARE * (total - whole[id(e)] + e.chars) if e.whole else PART_SHARE * without)
            if not holds:
                named.add(id(e))
                continue
        if e.parent is not None:
            e.parent.chars += e.chars
    before = [e.left_out for e in elements]
    for e in elements:
        e.left_out = e.left_out or id(e) in named or (e.parent is not None and e.parent.left_out)
    if all(e.left_out for _, e, _ in blocks):
        for e, out in zip(elements, before):
            e.left_out = out


def step(tag: str, values: dict[str, str]) -> str:
    """An element in a generalised path: the tag and its classes, digits as 0. The classes of
    the body differ from page to page and are left away."""
    if tag == "body":
        return tag
    classes = sorted({_DIGITS.sub("0", c) for c in values.get("class", "").split()})
    return ".".join([tag, *classes[:3]])


def read_blocks(page: str) -> list[tuple[str, Element, int]]:
    """The page's text blocks in order: text, innermost element, characters inside links."""
    root = Element("html", "", None, False, None)
    stack, blocks, buffer, elements = [root], [], [], [root]
    linked = [0]

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            blocks.append((text, stack[-1], linked[0]))
        buffer.clear()
        linked[0] = 0

    def close(index: int):
        while len(stack) > index:
            stack.pop()

    at, links = 0, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
            if links:
                linked[0] += m.start() - at
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:  # a closing tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            links = 1
        ends, limits = ({"p"}, SCOPE) if tag in PARAGRAPH_ENDS else CLOSES.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                close(i)
                break
            if stack[i].tag in limits:
                break
        if tag in ("html", "body") and any(e.tag == tag for e in stack[1:]):
            continue
        if m[4].rstrip().endswith("/") and tag in LEFT_OUT:
            continue
        above = stack[-1]
        values = attributes(m[4])
        out = above.left_out or around_the_article(tag, values)
        if tag == "header" and not out:
            # The head of the page is left out; in the head of an article its titles stay.
            out = not any(e.tag in ("article", "main") for e in stack)
        path = f"{above.path}/{step(tag, values)}" if tag in CONTAINERS and tag != "html" else above.path
        element = Element(tag, path, above, out, above.container)
        if not out and ("class" in values or "id" in values):
            element.names, element.whole = names_around(tag, values)
        stack.append(element)
        elements.append(element)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    if any(e.names for e in elements):
        leave_out_named(elements, blocks)
    return blocks


def in_article_head(element: Element) -> bool:
    """Inside the head of an article, but not in one of its titles."""
    title = False
    while element is not None:
        title = title or element.tag in HEADINGS
        if element.tag == "header":
            return not title
        element = element.parent
    return False


def is_title(element: Element) -> bool:
    while element is not None and element.tag not in CONTAINERS:
        if element.tag in ("h1", "h2"):
            return True
        element = element.parent
    return False


def around_best(best: Element, blocks: list[tuple[str, Element, int]]) -> Element:
    """The container of the whole article: the article or main element around the best container.

    Without one, a box that has no title is lifted below the body to the lowest one that adds
    the title or as prose further sections, and not mostly other text. Sections may be
    parts of the body itself.
    """
    chain: dict[int, int] = {}
    line = []
    above = best
    while above is not None:
        if above.tag in ("article", "main"):
            return above
        chain[id(above)] = len(line)
        line.append(above)
        above = above.parent
    groups: dict[int, list[tuple[str, int, bool, bool]]] = {}
    first = None
    for text, element, linked in blocks:
        if element.left_out or in_article_head(element):
            continue
        above = element
        while id(above) not in chain:
            above = above.parent
        level = chain[id(above.container)] if id(above.container) in chain else 0
        first = first or level == 0
        groups.setdefault(level, []).append((text, linked, is_title(element), bool(first)))
    inside = groups.pop(0, [])
    if any(title for _, _, title, _ in inside):
        return best
    size = sum(len(text) for text, *_ in inside)
    box = best
    for level in sorted(groups):
        above = line[level]
        if above.parent is None or above.tag == "body" and best.tag != "section":
            break
        titles = sum(len(text) for text, _, title, after in groups[level] if title and not after)
        prose = sum(len(text) for text, linked, title, _ in groups[level] if not title and len(text) >= PROSE and 4 * linked < len(text))
        rest = sum(len(text) for text, *_ in groups[level]) - titles - prose
        sections = box is best and prose >= SECTION_SHARE * size
        if not (titles or sections) or rest > max(titles + prose, SECTION_SHARE * size):
            break
        box = above
        size += titles + prose + rest
        if titles:
            break
    return box


def best_path(blocks: list[tuple[str, Element, int]]) -> tuple[str, float] | None:
    """The path of the article around the container with the best score, and the score. Text
    counts in full for its container and by half for each one above; text in links counts
    against it."""
    scored: dict[int, Element] = {}
    for text, element, linked in blocks:
        if element.left_out:
            continue
        credit, box = float(len(text) - 2 * linked), element.container
        while box is not None and abs(credit) >= 0.5:
            box.score += credit
            scored[id(box)] = box
            credit /= 2
            box = box.parent.container if box.parent is not None else None
    best = max(scored.values(), key=lambda e: (e.score, -len(e.path), e.path), default=None)
    return None if best is None else (around_best(best, blocks).path, best.score)


def text_under(blocks: list[tuple[str, Element, int]], path: str) -> str:
    """The kept blocks inside elements of the path."""
    out = []
    for text, element, _ in blocks:
        if element.left_out or in_article_head(element):
            continue
        above = element
        while above is not None and not (above.path == path and above.container is above):
            above = above.parent
        if above is not None:
            out.append(text)
    return "\n".join(out)


def extract(page: str, layouts: list[str]) -> str:
    """The text of the first layout that the page has, else of its own best container. A page
    whose own article is a layout around that one is read through it: it has more sections."""
    blocks = read_blocks(page)
    for path in layouts:
        text = text_under(blocks, path)
        if text:
            around = [p for p in layouts if p.count("/") > 1 and path.startswith(p + "/")]
            if around and (best := best_path(blocks)) and best[0] in around:
                return text_under(blocks, best[0])
            return text
    best = best_path(blocks)
    return text_under(blocks, best[0]) if best else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_layouts(pages: DataFrame, share: float = LAYOUT_SHARE) -> DataFrame:
    """``host`` and ``layouts``, its winning paths by falling votes."""

    def vote(batches):
        for batch in batches:
            votes = [best_path(read_blocks(p)) for p in batch.column("html").to_pylist()]
            paths = pa.array([v[0] if v else None for v in votes], pa.string())
            scores = pa.array([v[1] if v else None for v in votes], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("host"), paths, scores], names=["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, score double").filter("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    winners = counted.join(totals, "host").filter(F.col("votes") >= share * F.col("all_votes"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path")))
    return winners.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("layouts"))


def main_text(pages: DataFrame, share: float = LAYOUT_SHARE) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of ``(page_id, url, html)``.

    A NULL or empty page gives an empty text; a NULL url belongs to the empty host. Repeated
    rows are extracted each. Pages are read whole, whatever their length; tags that are never
    closed end with their surroundings. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), or_empty("html").alias("html"))
    # A host may hold a third of all pages: its few layouts are repeated, its pages dealt out.
    layouts = host_layouts(rows, share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(layouts, ["host", "_salt"], "left").select("page_id", "url", "html", "layouts")

    def read(batches):
        for batch in batches:
            texts = [extract(p, layouts or []) for p, layouts in zip(batch.column("html").to_pylist(), batch.column("layouts").to_pylist())]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
