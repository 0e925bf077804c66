r"""HTML extraction by tag-path ratios.

A page is cut into tags and text; every block of text is a node with the path of
block elements from the root to it.  Per path the text length and punctuation are
summed and set against the number of nodes; the two ratios are smoothed over the
nodes of one container in page order and fused.  Paths whose fused score reaches
LEVEL of the mean one (by text length) are content, and all their nodes are main
text, wherever they stand.  Marks of the page are weighed against the ratios: in an
``article`` (or in ``main``, if no article is there) a score counts more, in an
element whose class or id names boilerplate less; such elements are not smoothed
with others, and are content only where there is little else.

The other nodes go by the nearest element that holds content, unless it is the
whole page or their element is named: in an ``article`` all stay; elsewhere those
between its first and its last content node, and the element's own paragraphs.
Headings stay with what follows them.

Paths and elements are numbers and each is looked at once, so time and memory grow
with the page's length, however deep it is.

Text that a ratio cannot tell, since it reads like an article, goes by its element:
menus, headers, footers, asides, forms, scripts by tag and role, reader comments by
class or id, and what is hidden.

Decoding: character references are decoded; white space inside a block becomes
one space; blocks are joined in page order by one space.

Edge cases: null or empty html gives the empty text; broken markup (unclosed or
crossing tags, stray quotes) is read as browsers do for the elements that matter
here; a page without text gives the empty text; very long pages are read whole; of
equal scores the first element in page order counts; repeated rows give repeated
results; an empty table gives an empty result; only the kept columns and the html
are read, so others may have any name.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import table

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("html body main article section div td th tr tbody table center".split())
#: Elements, roles and name parts that mark boilerplate.
SKIP_TAGS = frozenset("head nav footer aside form button select option script style noscript template iframe svg canvas object dialog menu title textarea input datalist".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer copyright comment comments commentlist discussion disqus replies reply respond share sharing social related recommended "
    "recommendations widget toolbar pagination pager search hidden skip".split()
)
#: Of those, the ones that headings and paragraphs of an article may carry too: they count on containers only.
CONTAINER_NAMES = frozenset("header footer banner search hidden skip reply respond discussion copyright topbar masthead share social related".split())
#: The only ones that count on inline elements.
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre".split())
TEXT_BLOCKS = PARAGRAPHS | frozenset("li dt dd td th figure figcaption".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that hold all of a page, so that being in them says nothing.
OUTERMOST = frozenset(("", "html", "body"))
#: Names of elements with reader comments, whose paths look like those of the article.
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Nodes of the smoothing window on each side; share of the mean fused score that a path must reach.
WINDOW, LEVEL = 1, 0.5
#: Factors of the scores in elements that mark content, and of those whose names mark boilerplate.
MARKED, NAMED = 2.0, 0.25
PUNCTUATION = frozenset(".,;:!?…。，、；：！？।؟،")

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    # a quote opens a string only right after an equals sign
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*+)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Start tags that end an open element of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot")}
SPACE = re.compile(r"\s+")


def boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(the element takes no part, its name marks boilerplate)."""
    if tag in SKIP_TAGS or (tag == "header" and not in_article):
        return True, False
    named = False
    if not attributes:
        return False, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "role" and value.lower() in SKIP_ROLES:
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "main") and (tag != "article" or in_article):
            marks = {p.lower() for p in NAME_PARTS.findall(value)} & SKIP_NAMES
            if tag in INLINE:
                marks &= ADVERT_NAMES
            elif tag in TEXT_BLOCKS:
                marks -= CONTAINER_NAMES
            if marks & COMMENT_NAMES:
                return True, False
            named |= bool(marks)
    return False, named


class Node:
    __slots__ = ("path", "element", "text", "named", "article", "main")

    def __init__(self, path: int, element: int, text: str, named: bool, article: bool, main: bool):
        self.path, self.element, self.text, self.named, self.article, self.main = path, element, text, named, article, main


class Page:
    """Text nodes in page order (one for each block that takes part), and the elements by number, parents first; 0 stands for the page.

    A path is a number too: that of the path above it and the element's kind.
    """

    def __init__(self, html: str):
        self.found: list[Node] = []
        self.tags, self.parents = [""], [0]
        paths: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, int, bool, bool]] = []  # tag, number, path, takes no part, named
        opened, inside = Counter(), Counter()  # open elements by tag; open inline ones from the first one on that takes no part
        inline: list[str] = []
        parts: list[str] = []
        skipped = articles = named = 0

        def flush() -> None:
            nonlocal parts
            if parts:
                text = SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
                parts = []
                if text:
                    self.found.append(Node(stack[-1][2] if stack else 0, stack[-1][1] if stack else 0, text, named > 0, opened["article"] > 0, opened["main"] > 0))

        def pop() -> None:
            nonlocal skipped, articles, named
            tag, _, _, skip, name = stack.pop()
            opened[tag] -= 1
            skipped -= skip
            named -= name
            articles -= tag in ARTICLES

        def pop_to(k: int) -> None:
            while len(stack) > k:
                pop()

        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                if not skipped and not inline:
                    parts.append(html[at:])
                break
            if m.start() > at and not skipped and not inline:
                parts.append(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in INLINE:
                # inline elements make no blocks; in a hidden one or an advert no text counts
                if closing:
                    while inside[tag]:
                        inside[last := inline.pop()] -= 1
                        if last == tag:
                            break
                elif inline or (m[3] and any(boilerplate(tag, m[3], articles > 0))):
                    if tag not in VOID:
                        inline.append(tag)
                        inside[tag] += 1
                continue
            if tag == "br" or tag == "hr":
                if not skipped and not inline:
                    parts.append(" ")
                continue
            if tag in VOID:
                continue
            flush()
            inline.clear()  # a block ends what was left open
            inside.clear()
            if closing:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    pop_to(k)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|$(?![\s\S])", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if stack and stack[-1][0] == "p":  # every block ends an open paragraph
                pop()
            ends = CLOSES.get(tag, ())
            if any(opened[x] for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select") and tag not in ("tr", "td", "th", "tbody"):
                        break
                    if stack[k][0] in ends:
                        pop_to(k)
                        break
                    if stack[k][0] in ("table", "div", "section", "article"):
                        break
            if m[3] and m[3].rstrip().endswith("/") and tag not in CONTAINER:
                continue
            skip, name = boilerplate(tag, m[3], articles > 0)
            above, path = stack[-1][1:3] if stack else (0, 0)
            # elements of different kinds by name have different paths
            path = paths.setdefault((path, f"{tag}!" if name else tag), len(paths) + 1)
            stack.append((tag, len(self.tags), path, skip, name))
            self.tags.append(tag)
            self.parents.append(above)
            opened[tag] += 1
            skipped += skip
            named += name
            articles += tag in ARTICLES
        flush()

    def __len__(self) -> int:
        return len(self.found)

    def container(self, node: Node) -> int:
        """The element that holds the node's block."""
        return self.parents[node.element] if self.tags[node.element] in TEXT_BLOCKS else node.element


def smoothed(x: list[float]) -> list[float]:
    sums = [0.0]
    for v in x:
        sums.append(sums[-1] + v)
    return [(sums[min(len(x), i + WINDOW + 1)] - sums[max(0, i - WINDOW)]) / (min(len(x), i + WINDOW + 1) - max(0, i - WINDOW)) for i in range(len(x))]


def scores(page: Page) -> list[float]:
    """Fused score of each node: smoothed text ratio of its path times smoothed punctuation ratio."""
    length, marks, number = defaultdict(int), defaultdict(int), defaultdict(int)
    groups = defaultdict(list)
    for i, n in enumerate(page.found):
        length[n.path] += len(n.text)
        marks[n.path] += sum(map(n.text.count, PUNCTUATION))
        number[n.path] += 1
        groups[page.container(n), n.named].append(i)
    fused = [0.0] * len(page.found)
    for at in groups.values():
        paths = [page.found[i].path for i in at]
        if len(at) == 1:
            fused[at[0]] = length[paths[0]] / number[paths[0]] * (1 + marks[paths[0]] / number[paths[0]])
            continue
        text, punct = smoothed([length[p] / number[p] for p in paths]), smoothed([1 + marks[p] / number[p] for p in paths])
        for i, a, b in zip(at, text, punct):
            fused[i] = a * b
    return fused


def content(page: Page) -> list[bool]:
    """Whether each node is on a content path."""
    found = page.found
    mark = "article" if any(n.article for n in found) else "main"
    weighed = [f * (NAMED if n.named else MARKED if getattr(n, mark) else 1.0) for f, n in zip(scores(page), found)]
    # what is named boilerplate takes part only where there is little else
    sizes = [sum(len(n.text) for n in found if n.named == named) for named in (False, True)]
    part = [not n.named or sizes[0] < NAMED * sizes[1] for n in found]
    total, number = defaultdict(float), defaultdict(int)
    for n, w in zip(found, weighed):
        total[n.path] += w
        number[n.path] += 1
    size = sum(len(n.text) for n, p in zip(found, part) if p)
    floor = LEVEL * sum(w * len(n.text) for n, w, p in zip(found, weighed, part) if p) / size
    keep = [p and total[n.path] >= floor * number[n.path] * (1 - 1e-9) for n, p in zip(found, part)]
    return keep if any(keep) else part


def extract(html: str | None) -> str:
    """The main text of a page."""
    page = Page(html or "")
    found, tags, parents = page.found, page.tags, page.parents
    if not found:
        return ""
    keep = content(page)
    # first and last content node inside each element; parents have smaller numbers
    first, last = [len(found)] * len(tags), [-1] * len(tags)
    for i, n in enumerate(found):
        if keep[i]:
            first[n.element], last[n.element] = min(first[n.element], i), max(last[n.element], i)
    for e in range(len(tags) - 1, 0, -1):
        up = parents[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    # the nearest element around each one that holds content
    near = [0] * len(tags)
    for e in range(1, len(tags)):
        near[e] = e if last[e] >= 0 else near[parents[e]]
    for i, n in enumerate(found):
        around = near[n.element]
        if keep[i] or n.named or tags[around] in OUTERMOST:
            continue
        own_block = page.container(n) == around and tags[n.element] in PARAGRAPHS
        keep[i] = tags[around] == "article" or first[around] < i < last[around] or own_block
    for i in range(len(found) - 2, -1, -1):  # headings of what follows
        if keep[i + 1] and tags[found[i].element] in HEADINGS and not found[i].named:
            keep[i] = True
    return " ".join(n.text for n, k in zip(found, keep) if k)


def html_extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, the main text and its length in code points; a scan that moves no rows."""
    rows = df.select(*keep, F.col(html_col).alias("_html"))
    kinds = dict(rows.dtypes)
    names = [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string", "n_chars long"]))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
